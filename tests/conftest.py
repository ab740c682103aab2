import pytest

from corvane.session import ensure_worker_path, local_session

ensure_worker_path()


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, partitions=4, memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
