"""Text output of benchmark and profiling tools as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions.headers import duration_ms

_VEGETA = "requests long, rate double, throughput double, success double, duration long, status_codes map<string,long>, latencies struct<mean: double, `50th`: double, `90th`: double, `95th`: double, `99th`: double, max: double>"


def blocks(outputs: DataFrame) -> DataFrame:
    """outputs: id, text. id, name, metric, value: each named block's figures; durations in milliseconds."""
    b = outputs.select("id", F.explode(F.split("text", r"(?m)^=+$")).alias("b")).withColumn("name", F.trim(F.regexp_extract("b", r"(?m)^Test name:\s+(.+?)\s*$", 1))).filter("name <> ''")
    line = b.select("id", "name", F.explode(F.split("b", "\n")).alias("l"))
    key, value = F.trim(F.regexp_extract("l", r"^([^:]+):\s+(\S+)", 1)), F.regexp_extract("l", r"^([^:]+):\s+(\S+)", 2)
    latency = key.rlike(r"^(min|max|p50|p75|p90|p99)$")
    first = key.rlike(r"^(Manifest HEAD|Manifest GET|Config|Layer) TTFB p(50|99)$")
    metric = F.when(latency, F.concat(key, F.lit("_ms"))).when(first, F.translate(F.lower(key), " ", "_")).when(key == "Requests per second", "rps").when(key == "Failed requests", "failed")
    number = F.when(latency | first, F.when(value.isin("0", "0s"), F.lit(0.0)).otherwise(duration_ms(value))).otherwise(value.try_cast("double"))
    return line.select("id", "name", metric.alias("metric"), number.alias("value")).filter("metric IS NOT NULL")


def vegeta(reports: DataFrame) -> DataFrame:
    """reports: id, text (JSON, latencies in nanoseconds). id, rate, success, mean_ms, p50_ms, p99_ms, max_ms."""
    r = reports.select("id", F.from_json("text", _VEGETA).alias("r"))
    ms = lambda c: (F.col(f"r.latencies.{c}") / 1e6)
    return r.select("id", "r.rate", "r.success", ms("mean").alias("mean_ms"), ms("`50th`").alias("p50_ms"), ms("`99th`").alias("p99_ms"), ms("max").alias("max_ms"))


def folded(lines: DataFrame) -> DataFrame:
    """lines: value, `frame;frame count`. frames, n; lines without a count are left out."""
    n = F.regexp_extract("value", r" (\d+)\s*$", 1)
    return lines.filter(n != "").select(F.split(F.regexp_extract("value", r"^(.*) \d+\s*$", 1), ";").alias("frames"), n.cast("long").alias("n"))


def traced(lines: DataFrame) -> DataFrame:
    """lines: value, rows of a per-thread system call table (syscall calls [errors] total min avg max stddev). syscall, calls, ms."""
    w = F.split(F.trim("value"), r"\s+")
    numeric = lambda k: F.coalesce(F.get(w, F.lit(k)).rlike(r"^[0-9.]+%?$"), F.lit(False))
    rows = lines.select(w.alias("w"), (numeric(7)).alias("errors"), (F.size(w) >= 7).alias("long")).filter(F.col("long") & F.col("w")[0].rlike("^[a-z_][a-z0-9_]*$") & F.col("w")[1].rlike(r"^\d+$"))
    return rows.select(F.col("w")[0].alias("syscall"), F.col("w")[1].cast("long").alias("calls"), F.when(F.col("errors"), F.col("w")[3]).otherwise(F.col("w")[2]).try_cast("double").alias("ms"))


def counted(lines: DataFrame) -> DataFrame:
    """lines: value, rows of a summary table (% time, seconds, usecs/call, calls, [errors], syscall). syscall, calls, ms."""
    w = F.split(F.trim("value"), r"\s+")
    rows = lines.select(w.alias("w")).filter(F.size("w").isin(5, 6) & F.col("w")[0].rlike(r"^[0-9.]+$") & (F.element_at("w", -1) != "total"))
    out = rows.select(F.element_at("w", -1).alias("syscall"), F.col("w")[3].try_cast("long").alias("calls"), (F.col("w")[1].try_cast("double") * 1000).alias("ms"))
    return out.filter("calls IS NOT NULL AND ms IS NOT NULL")


def exposition(lines: DataFrame, prefix: str = "") -> DataFrame:
    """lines: value, in the text exposition format. name, labels, value of samples whose name begins with prefix."""
    part = lambda k: F.regexp_extract("value", r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{[^}]*\})?\s+(\S+)", k)
    out = lines.select(part(1).alias("name"), part(2).alias("labels"), part(3).try_cast("double").alias("value"))
    return out.filter((F.col("name") != "") & F.startswith("name", F.lit(prefix)) & F.col("value").isNotNull())


def samples(spark, path: str) -> DataFrame:
    """Resource samples from CSV files: t_s, anon_bytes, file_bytes, usage_usec, tasks."""
    return spark.read.csv(path, header=True, schema="t_s double, anon_bytes long, file_bytes long, usage_usec long, tasks long")


def corpus(spark, images: int, repos: int = 100) -> DataFrame:
    """A deterministic corpus of image rows: repo, tag, digest, subject, media_type."""
    from quayside.plans.fixture import MEDIA_TYPES

    n = F.col("id")
    sha = lambda p, k: F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(p), k.cast("string")), 256))
    repo = F.format_string("org%d/repo-%04d", n % 10, n % repos)
    tag = F.format_string("v%d.%d.%d-build.%d", F.expr("id div 1000"), F.expr("id div 100 % 10"), n % 10, n)
    media = F.element_at(F.array(*map(F.lit, MEDIA_TYPES)), (n % 3 + 1).cast("int"))
    return spark.range(images).select(repo.alias("repo"), tag.alias("tag"), sha("blob-", n).alias("digest"), sha("subject-", F.expr("id div 100")).alias("subject"), media.alias("media_type"))
