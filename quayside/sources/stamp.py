"""A snapshot of derived tables with a manifest that says for which log it holds."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

VERSION = 1


@dataclass(frozen=True)
class Stamp:
    config_hash: str
    generation: int
    log_bytes: int
    version: int = VERSION


def write(tables: dict[str, DataFrame], stamp: Stamp, path: str) -> None:
    """The tables first, the manifest last: without it there is no snapshot."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(asdict(stamp) | {"tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_stamp")


def read(spark: SparkSession, path: str, expected: Stamp) -> dict[str, DataFrame] | None:
    """The tables if version, configuration, generation and log length all are as expected, else None. The manifest is
    removed as it is used, so that a snapshot serves one start."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_stamp")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    found = json.loads(spark.read.text(f"{path}/_stamp").first()["value"])
    fs.delete(at, True)
    names = found.pop("tables")
    return {n: spark.read.parquet(f"{path}/{n}") for n in names} if found == asdict(expected) else None
