"""Ordered computations in two levels, for groups of which one may hold most rows.

A running sum or a rank within a group needs all of the group's rows in order. Here all rows are first cut into ranges of
group and ordering value that hold about as many rows each, so that no outlier and no large group crowds one of them; sums
over ranges are small, and only the rows of a range meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quayside.shared import written

BUCKETS = 4096


def placed(rows: DataFrame, by: list[str], value: str, buckets: int = BUCKETS) -> DataFrame:
    """rows, stored, with _bucket: the range of (by, value) that a row is in, at most `buckets` and no more than shuffle
    partitions. A group's buckets follow each other as its values do. Rows equal in by and value share one, so values that
    repeat are to be counted before. Ranges come from a sample: every use must see the same ones, so the rows are written."""
    n = min(buckets, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return written(rows.repartitionByRange(n, *by, value).withColumn("_bucket", F.spark_partition_id()))


def _earlier(by: list[str]):
    """All buckets of the group before this one."""
    return Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)


def _so_far(by: list[str], at: str) -> WindowSpec:
    return Window.partitionBy(*by, "_bucket").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _beside(rows: DataFrame, buckets: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of their bucket. A null group is a group like any other."""
    on = F.col("_r._bucket") == F.col("_b._bucket")
    for c in by:
        on &= F.col(f"_r.{c}").eqNullSafe(F.col(f"_b.{c}"))
    return rows.alias("_r").join(buckets.alias("_b"), on).select("_r.*", *[f"_b.{c}" for c in buckets.columns if c not in (*by, "_bucket")])


def _summed(marked: DataFrame, by: list[str], at: str, value: Column, out: str) -> DataFrame:
    """running_sum of rows that are placed."""
    rows = marked.withColumn("_v", value)
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_v").alias("_own"))
    before = sums.select(*by, "_bucket", F.coalesce(F.sum("_own").over(_earlier(by)), F.lit(0)).alias("_before"))
    upto = rows.withColumn("_upto", F.sum("_v").over(_so_far(by, at)))
    return _beside(upto, before, by).withColumn(out, F.col("_before") + F.col("_upto")).drop("_bucket", "_v", "_upto", "_before")


def running_sum(rows: DataFrame, by: list[str], at: str, value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds out: the sum of value over the group's rows up to and including this one, in order of at (unique in a group)."""
    return _summed(placed(rows, by, at, buckets), by, at, F.col(value), out)


def numbered(rows: DataFrame, by: list[str], at: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds out: the row's place in its group, from 1, in order of at (unique in a group)."""
    return _summed(placed(rows, by, at, buckets), by, at, F.lit(1).cast("long"), out)


def running_floor(rows: DataFrame, by: list[str], at: str, value: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds out: the running sum of value that begins at 0 and is never let under it, in order of at (unique in a group).
    It is the plain running sum over its least value so far, where that is negative."""
    rows = placed(rows, by, at, buckets).withColumn("_upto", F.sum(value).over(_so_far(by, at)))
    own = rows.groupBy(*by, "_bucket").agg(F.max_by("_upto", at).alias("_own"), F.min("_upto").alias("_dip"))
    own = own.withColumn("_before", F.coalesce(F.sum("_own").over(_earlier(by)), F.lit(0)))
    low = F.least(F.lit(0), F.min(F.col("_before") + F.col("_dip")).over(_earlier(by)))
    both = _beside(rows, own.select(*by, "_bucket", "_before", low.alias("_low")), by)
    least = F.least("_low", F.col("_before") + F.min("_upto").over(_so_far(by, at)))
    return both.withColumn(out, F.col("_before") + F.col("_upto") - least).drop("_bucket", "_upto", "_before", "_low")


def without_resets(rows: DataFrame, by: list[str], at: str, raw: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds out: raw and, wherever raw fell before, what it had reached, in order of at (unique in a group)."""
    marked = placed(rows, by, at, buckets)
    last = marked.groupBy(*by, "_bucket").agg(F.max_by(raw, at).alias("_last"))
    follows = Window.partitionBy(*by).orderBy("_bucket")
    both = _beside(marked, last.select(*by, "_bucket", F.lag("_last").over(follows).alias("_left")), by)
    prior = F.coalesce(F.lag(raw).over(Window.partitionBy(*by, "_bucket").orderBy(at)), "_left")
    both = both.withColumn("_prior", prior).drop("_left")
    lost = F.when(F.col(raw) < F.col("_prior"), F.col("_prior")).otherwise(F.lit(0))
    return _summed(both, by, at, lost, "_lost").withColumn(out, F.col(raw) + F.col("_lost")).drop("_prior", "_lost")


def at_places(samples: DataFrame, by: list[str], value: str, places: dict[str, Column], buckets: int = BUCKETS) -> DataFrame:
    """by and a column for each of places: the value at this place (from 0) of the group's sorted ones. A place is an
    expression of n, the group's count. Exact: values are counted where they lie, a histogram of ranges tells the one that
    a place is in, and only the different values of that range are sorted."""
    counted = samples.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_m"))
    marked = placed(counted, by, value, buckets)
    hist = marked.groupBy(*by, "_bucket").agg(F.sum("_m").alias("_c"))
    hist = hist.withColumn("_end", F.sum("_c").over(Window.partitionBy(*by).orderBy("_bucket"))).withColumn("n", F.sum("_c").over(Window.partitionBy(*by)))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), p.cast("long").alias("place")) for k, p in places.items()]))
    hist = hist.select(*by, "_bucket", "_c", "_end", asked.alias("_a"))
    wanted = hist.filter((F.col("_a.place") < F.col("_end")) & (F.col("_a.place") >= F.col("_end") - F.col("_c")))
    wanted = wanted.select(*by, "_bucket", F.col("_a.name").alias("_name"), (F.col("_a.place") - F.col("_end") + F.col("_c")).alias("_rest"))
    upto = F.sum("_m").over(Window.partitionBy(*by, "_bucket").orderBy(value))
    found = _beside(marked.withColumn("_upto", upto), wanted, by).filter(F.col("_upto") > F.col("_rest"))
    found = found.groupBy(*by, "_name").agg(F.min(value).cast("double").alias("_v"))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_name") == k, F.col("_v"))).alias(k) for k in places])
