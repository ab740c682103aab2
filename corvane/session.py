"""Session and table helpers shared by every operator."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that tests and the bench rely on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corvane")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables; the path may live in any Hadoop file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where a local session names none (tests), a temporary folder is set once per
    Spark context and reused. On a cluster a folder has to be named.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    made = tempfile.mkdtemp(prefix="corvane-")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, folder: str) -> DataFrame:
    """Written as Parquet and read again.

    A checkpoint would take several times the bytes, and would keep the planner's size
    estimate, whose digits multiply by each round's joins.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the context cleaner delete shuffle files that no live plan reads any more.

    It acts when the driver's JVM collects a plan, which it can only do once
    Python's references to that plan are gone; these are given up by a
    background thread, hence the pauses and the second round. A single local
    JVM (tests) does not wait; the files then go at a later collection.
    """
    pause = 0 if spark.sparkContext.master.split("[")[0] == "local" else 0.4
    for _ in range(2 if pause else 1):
        gc.collect()
        time.sleep(pause)
        spark._jvm.System.gc()
        time.sleep(pause)


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(rows: DataFrame, *by: Column) -> DataFrame:
    """``rows`` dealt by ``by`` over all cores, several tasks each, for work that costs far more than reading them.

    A row group of a Parquet file is one task, and a million short rows are one
    row group. The number is named, so that adaptive execution, which goes by
    bytes, does not join the tasks again.
    """
    spark = rows.sparkSession
    return rows.repartition(max(shuffle_width(spark), 3 * spark.sparkContext.defaultParallelism), *by)


def ensure_worker_path() -> None:
    """Let Python workers that start later import this package by name."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
