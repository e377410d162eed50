"""Histograms, counters, gauges and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.operators.ordered import at_places, without_resets

#: Upper bounds of the latency histogram in seconds and of the log's batch sizes.
LATENCY_BOUNDS = [0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0]
BATCH_BOUNDS = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0]


def histogram(samples: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """by, le, n, total, samples: cumulative buckets (upper bounds inclusive, the last one null for +Inf). All buckets are
    counted in one aggregation and then unfolded, a row a bucket, after the shuffle."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(bounds)]
    all_ = samples.groupBy(*by).agg(*counts, F.count(value).alias("samples"), F.sum(value).alias("total"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("n")) for i, b in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("samples").alias("n")))
    return all_.select(*by, "total", "samples", F.explode(F.array(*rows)).alias("_r")).select(*by, "_r.le", "_r.n", "total", "samples")


def counters(events: DataFrame, labels: list[str], amount: Column | None = None) -> DataFrame:
    """labels, n, amount: a counter for each combination of labels that occurs."""
    return events.groupBy(*labels).agg(F.count("*").alias("n"), (F.sum(amount) if amount is not None else F.count("*")).alias("amount"))


def monotone(samples: DataFrame, by: list[str], at: str, raw: str) -> DataFrame:
    """Adds total: the counter without its resets. Where raw falls, what it had reached is added to all that follows."""
    return without_resets(samples, by, at, raw, "total")


def phases(samples: DataFrame, spans: DataFrame) -> DataFrame:
    """samples: series, t, rss, cpu; spans: series, phase, begins, ends (few a series). series, phase, cpu_used, peak_rss:
    last less first cpu and the largest rss in the closed span; null with fewer than two samples."""
    inside = samples.join(spans, "series").filter("t >= begins AND t <= ends").groupBy("series", "phase")
    agg = inside.agg(F.count("*").alias("_n"), (F.max_by("cpu", "t") - F.min_by("cpu", "t")).alias("cpu_used"), F.max("rss").alias("peak_rss"))
    enough = F.col("_n") >= 2
    out = spans.select("series", "phase").join(agg, ["series", "phase"], "left")
    return out.select("series", "phase", F.when(enough, F.col("cpu_used")).alias("cpu_used"), F.when(enough, F.col("peak_rss")).alias("peak_rss"))


def _named(rank: float) -> str:
    return f"p{rank:g}".replace(".", "_")


def nearest_rank(samples: DataFrame, by: list[str], value: str, ranks: list[float]) -> DataFrame:
    """by and p<rank>: the smallest value with at least rank percent of all at or under it. Exact."""
    return at_places(samples, by, value, {_named(r): F.greatest(F.ceil(F.lit(r) * F.col("n") / 100) - 1, F.lit(0)) for r in ranks})


def rounded_rank(samples: DataFrame, by: list[str], value: str, ranks: list[float]) -> DataFrame:
    """by and p<rank>: the value at place round(rank / 100 * (n - 1)) of the sorted ones, from 0; halves round up. Exact,
    and not the same as nearest_rank."""
    return at_places(samples, by, value, {_named(r): F.floor(F.lit(r / 100) * (F.col("n") - 1) + 0.5) for r in ranks})


def metric_name(name: str, unit: str = "") -> Column:
    """A metric's name in the text format: dots become underscores, seconds are named."""
    return F.concat(F.translate(name, ".", "_"), F.lit("_seconds" if unit == "s" else ""))


def _labels(labels: Column) -> Column:
    """{key="value",...} by key, also where there are none; backslash, quote and newline in values are escaped."""
    escape = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    pairs = F.transform(labels, lambda e: F.concat(e["key"], F.lit('="'), escape(e["value"]), F.lit('"')))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def _number(value: Column) -> Column:
    """A number as the format writes it: whole ones without a fraction."""
    return F.when(value == F.floor(value), F.floor(value).cast("string")).otherwise(value.cast("string"))


def _headed(samples: DataFrame, kind: str, help_: str) -> DataFrame:
    """samples: name, _key, _part, line. HELP, unless it is empty, and TYPE come before each name's first sample."""
    said = F.lit(f" {help_}\n") if help_ else F.lit("")
    about = F.concat(F.lit("# HELP "), "name", said) if help_ else said
    heads = samples.select("name").distinct().select("name", F.lit("").alias("_key"), F.struct(F.lit(-1).alias("_kind"), F.lit(0.0).alias("_place")).alias("_part"), F.concat(about, F.lit("# TYPE "), "name", F.lit(f" {kind}")).alias("line"))
    return heads.unionByName(samples).orderBy("name", "_key", "_part").select("name", "line")


def exposition(points: DataFrame, kind: str, help_: str, unit: str = "") -> DataFrame:
    """points: name, labels (map), value. name, line: the text exposition format of counters and gauges, a metric's samples
    by label. Counters are named _total; label keys stay as they are."""
    name = F.concat(metric_name("name", unit), F.lit("_total" if kind == "counter" else ""))
    labels = _labels(F.array_sort(F.map_entries("labels")))
    samples = points.select(name.alias("name"), labels.alias("_key"), F.struct(F.lit(0).alias("_kind"), F.lit(0.0).alias("_place")).alias("_part"), F.concat(name, labels, F.lit(" "), F.col("value").cast("string")).alias("line"))
    return _headed(samples, kind, help_)


def histogram_exposition(points: DataFrame, help_: str, unit: str = "") -> DataFrame:
    """points: name, labels (map) and histogram()'s le, n, total, samples. name, line: a _bucket line for each bound, then
    _sum and _count, for each combination of labels. The last label is le."""
    name, pairs = metric_name("name", unit), F.array_sort(F.map_entries("labels"))
    le = F.coalesce(_number(F.col("le")), F.lit("+Inf"))
    bounded = _labels(F.concat(pairs, F.array(F.struct(F.lit("le").alias("key"), le.alias("value")))))
    line = lambda tail, labels, value: F.concat(name, F.lit(tail), labels, F.lit(" "), value)
    rows = points.withColumn("_key", _labels(pairs)).withColumn("_bucket", line("_bucket", bounded, F.col("n").cast("string")))
    rows = rows.withColumn("_sum", line("_sum", F.col("_key"), _number(F.col("total")))).withColumn("_count", line("_count", F.col("_key"), F.col("samples").cast("string")))
    place = F.when(F.col("le").isNull(), float("inf")).otherwise(F.col("le"))
    buckets = rows.select(name.alias("name"), "_key", F.lit(0).alias("_kind"), place.alias("_place"), F.col("_bucket").alias("line"))
    ends = rows.filter("le IS NULL").select(name.alias("name"), "_key", F.posexplode(F.array("_sum", "_count")).alias("_kind", "line"))
    samples = buckets.unionByName(ends.select("name", "_key", (F.col("_kind") + 1).alias("_kind"), F.lit(0.0).alias("_place"), "line"))
    return _headed(samples.select("name", "_key", F.struct("_kind", "_place").alias("_part"), "line"), "histogram", help_)
