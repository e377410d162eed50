"""The metadata log as a stream: index state that each micro-batch brings up to date.

State is a table of the latest record per key and of deletions, compacted with every batch, in a new folder a version.
A version only counts once it is whole, so a batch that is run again after a failure finds the state it began with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quayside.operators import replay

def compacted(log: DataFrame) -> DataFrame:
    """The records that a replay of log can still depend on: the latest of each operation and key."""
    key = F.to_json(F.struct("tag", "subject", "refs"))
    latest = log.withColumn("_key", key).groupBy("op", "repo", "digest", "_key").agg(F.max_by(F.struct(*log.columns), "seq").alias("r"))
    return latest.select("r.*")


def _version(spark: SparkSession, path: str, batch: int) -> str | None:
    """The newest whole version before batch."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = [int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))]
    older = [v for v in found if v < batch]
    return f"{path}/version={max(older)}" if older else None


def maintain(log: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keeps the compacted log of a stream of records (columns of replay.py) at path, a version a batch."""

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        last = _version(spark, path, n)
        whole = batch if last is None else batch.unionByName(spark.read.schema(batch.schema).parquet(last))
        compacted(whole).write.mode("overwrite").parquet(f"{path}/version={n}")

    writer = log.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest version's records; replay.tags and its kind give the index of it."""
    last = _version(spark, path, 1 << 62)
    if last is None:
        raise ValueError(f"no version at {path}")
    return spark.read.parquet(last)


def live_tags(spark: SparkSession, path: str) -> DataFrame:
    return replay.tags(current(spark, path))
