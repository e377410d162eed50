"""Statistics of benchmark repetitions, metric snapshots and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of a step that a server sustains, the spread above which a figure counts as unstable, and how much
#: better another must be, in percent, for a gap.
P99_BUDGET_MS, RATE_SHARE, UNSTABLE_CV, GAP_PCT = 20.0, 0.95, 10.0, 10.0

#: The classes of a stack's leaf and their patterns; the first that matches holds. After `runtime` comes `own`,
#: the caller's own code, before the last, std-other; what none matches is `other`.
STACK_CLASSES = [
    ("kernel", r"_\[k\]$"),
    ("hashing", r"sha2|sha256|sha512|blake3|crc32"),
    ("copy/alloc", r"memcpy|memmove|memset|mi_|malloc|free|realloc|alloc::"),
    ("json", r"serde_json|serde::"),
    ("tls", r"rustls|ring::"),
    ("http", r"hyper|h2::|http::|axum|tower"),
    ("runtime", r"tokio::|parking_lot|futures"),
    ("std-other", r"std::|core::"),
]


def summary(samples: DataFrame) -> DataFrame:
    """samples: rep, registry, metric, value. metric, registry, median, least, most, n, cv: cv is the sample deviation in
    percent of the mean, 0 for one repetition or a mean of 0."""
    mean = F.avg("value")
    cv = F.when((F.count("value") > 1) & (mean != 0), F.stddev_samp("value") / F.abs(mean) * 100).otherwise(F.lit(0.0))
    return samples.groupBy("metric", "registry").agg(F.median("value").alias("median"), F.min("value").alias("least"), F.max("value").alias("most"), F.count("value").alias("n"), cv.alias("cv"))


def compare(summaries: DataFrame, baseline: str) -> DataFrame:
    """Adds, to the summaries of all but the baseline: ratio of medians, overlaps (their ranges meet), unstable (either cv
    is above 10)."""
    base = summaries.filter(F.col("registry") == baseline).select("metric", F.col("median").alias("_m"), F.col("least").alias("_l"), F.col("most").alias("_h"), F.col("cv").alias("_cv"))
    out = summaries.filter(F.col("registry") != baseline).join(base, "metric")
    return out.select("metric", "registry", F.when(F.col("_m") != 0, F.col("median") / F.col("_m")).alias("ratio"), ((F.col("least") <= F.col("_h")) & (F.col("_l") <= F.col("most"))).alias("overlaps"), (F.greatest("cv", "_cv") > UNSTABLE_CV).alias("unstable"))


def gaps(summaries: DataFrame, baseline: str, lower_is_better: Column) -> DataFrame:
    """Metrics in which the best other registry beats the baseline by more than GAP_PCT percent: metric, ours, best, competitor
    (of equal ones the first name), ratio (best to ours) and factor (how many times better). A division by 0 is infinite."""
    marked = summaries.withColumn("_low", lower_is_better)
    ours = marked.filter(F.col("registry") == baseline).select("metric", "_low", F.col("median").alias("ours"))
    order = F.struct(F.when(F.col("_low"), F.col("median")).otherwise(-F.col("median")).alias("by"), "registry", "median")
    rest = marked.filter(F.col("registry") != baseline).groupBy("metric").agg(F.min(order).alias("_best"))
    out = ours.join(rest, "metric").select("metric", "_low", "ours", F.col("_best.median").alias("best"), F.col("_best.registry").alias("competitor"))
    beats = F.when(F.col("_low"), F.col("best") < F.col("ours") * (1 - GAP_PCT / 100)).otherwise(F.col("best") > F.col("ours") * (1 + GAP_PCT / 100))
    over = lambda a, b: F.when(F.col(b) == 0, F.lit(float("inf"))).otherwise(F.col(a) / F.col(b))
    ratio, factor = over("best", "ours"), F.when(F.col("_low"), over("ours", "best")).otherwise(over("best", "ours"))
    return out.filter(beats).select("metric", "ours", "best", "competitor", ratio.alias("ratio"), factor.alias("factor"))


def delta(before: DataFrame, after: DataFrame, labels: list[str]) -> DataFrame:
    """labels, n, total: what counters (labels, n, total) gained between two snapshots; those that stood still are left out."""
    old = before.select(*labels, F.col("n").alias("_n"), F.col("total").alias("_t"))
    out = after.join(old, labels, "left")
    return out.select(*labels, (F.col("n") - F.coalesce("_n", F.lit(0))).alias("n"), (F.col("total") - F.coalesce("_t", F.lit(0.0))).alias("total")).filter("n > 0")


def sustained(steps: DataFrame) -> DataFrame:
    """steps: endpoint, rps, rate, p99_ms, status_share. endpoint, max_rps: the highest step before the first that fails;
    0 if the first one does. A step holds with all statuses right, p99 in budget and 95 % of the rate."""
    ok = (F.col("status_share") == 1.0) & (F.col("p99_ms") <= P99_BUDGET_MS) & (F.col("rate") >= RATE_SHARE * F.col("rps"))
    failed = F.min(F.when(~ok, F.col("rps"))).over(Window.partitionBy("endpoint"))
    marked = steps.withColumn("_ok", ok).withColumn("_failed", failed)
    held = F.when(F.col("_ok") & (F.col("_failed").isNull() | (F.col("rps") < F.col("_failed"))), F.col("rps"))
    return marked.groupBy("endpoint").agg(F.coalesce(F.max(held), F.lit(0).cast("long")).alias("max_rps"))


def top_frames(stacks: DataFrame, n: int = 15) -> DataFrame:
    """stacks: frames, n. frame, self, inclusive, self_pct: the n frames with the most samples of their own. A frame counts
    once a stack, however often it recurs in it."""
    total = stacks.agg(F.sum("n").alias("_total"))
    own = stacks.select(F.element_at("frames", -1).alias("frame"), "n").groupBy("frame").agg(F.sum("n").alias("self"))
    all_ = stacks.select(F.explode(F.array_distinct("frames")).alias("frame"), "n").groupBy("frame").agg(F.sum("n").alias("inclusive"))
    out = all_.join(own, "frame", "left").withColumn("self", F.coalesce("self", F.lit(0))).crossJoin(F.broadcast(total))  # one row
    return out.select("frame", "self", "inclusive", (100.0 * F.col("self") / F.col("_total")).alias("self_pct")).orderBy(F.desc("self"), F.desc("inclusive"), "frame").limit(n)


def categories(stacks: DataFrame, own: str | None = None) -> DataFrame:
    """stacks: frames, n. category, n, pct of all samples, by the leaf's class; own: the pattern of the caller's own code."""
    leaf = F.element_at("frames", -1)
    classes = STACK_CLASSES[:-1] + ([("own", own)] if own else []) + STACK_CLASSES[-1:]
    kind = F.coalesce(*[F.when(leaf.rlike(p), F.lit(c)) for c, p in classes], F.lit("other"))
    sums = stacks.select(kind.alias("category"), "n").groupBy("category").agg(F.sum("n").alias("n"))
    return sums.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # a row a class


def findings(shares: DataFrame, limits: dict[str, float]) -> DataFrame:
    """categories whose share is above their limit: category, pct, threshold."""
    out = shares.withColumn("threshold", F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("category")])
    return out.filter(F.col("pct") > F.col("threshold")).select("category", "pct", "threshold")


def syscall_totals(rows: DataFrame) -> DataFrame:
    """rows: thread, syscall, calls, ms. syscall, calls, ms over all threads."""
    return rows.groupBy("syscall").agg(F.sum("calls").alias("calls"), F.sum("ms").alias("ms"))
