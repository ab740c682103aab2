"""Incremental ingest: new rows arrive in micro-batches and the latest row of each key wins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.session import shared_dir


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; partial aggregation, so a key with very many rows is no hot spot."""
    value = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c) for c in rows.columns if c not in keys]).alias("__row"))
    best = rows.groupBy(*keys).agg(F.max(value).alias("__best"))
    return best.select(*keys, "__best.__row.*").select(*rows.columns)


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet file or folder as a stream; the path may be in any Hadoop file system."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    return reader.parquet(f"{sf_dir}/{name}.parquet" if folder else f"{sf_dir}/{name}.parque[t]")


def upsert_latest(stream: DataFrame, target: str, keys: list[str], order: list[str]):
    """Starts a query that keeps the latest row of each key in ``target``; call ``awaitTermination``.

    Each batch writes a new version of the table beside the old one and then
    names it; a batch that runs again writes the same version anew.
    """

    def apply(batch: DataFrame, number: int) -> None:
        before = f"{target}/v{number - 1}"
        rows = batch if number == 0 else batch.unionByName(batch.sparkSession.read.parquet(before))
        latest(rows, keys, order).write.mode("overwrite").parquet(f"{target}/v{number}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{target}/offsets").trigger(availableNow=True).start()


def run_upsert(spark: SparkSession, stream: DataFrame, keys: list[str], order: list[str], target: str | None = None) -> DataFrame:
    """Drains the stream and returns the upserted table."""
    target = target or f"{shared_dir(spark)}/upsert-{uuid.uuid4().hex}"
    query = upsert_latest(stream, target, keys, order)
    query.awaitTermination()
    done = query.lastProgress
    last = done["batchId"] if done and done["numInputRows"] else (done["batchId"] - 1 if done else -1)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v{last}")
    if last < 0 or not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(f"{target}/v{last}")


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str) -> DataFrame:
    """Counts by window with a watermark, for append mode."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))


def first_last(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows numbered inside each key, from both ends."""
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumns({"from_first": F.row_number().over(up), "from_last": F.row_number().over(down)})
