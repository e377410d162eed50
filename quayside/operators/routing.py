"""Longest-prefix routing, mounts and cross-repository deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefixes(repo: str) -> Column:
    """All leading runs of a name's components, the whole name included."""
    parts = F.split(F.col(repo), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def longest_prefix(names: DataFrame, routes: DataFrame, default: str = "default") -> DataFrame:
    """names: repo. Adds backend: that of the longest route (prefix, backend) of whole components, or the default.

    The range condition becomes an equi-join on each name's few prefixes, so the routes may be of any number."""
    spread = names.select("repo").distinct().withColumn("prefix", F.explode(prefixes("repo")))
    hit = spread.join(routes, "prefix").groupBy("repo").agg(F.max_by("backend", F.length("prefix")).alias("backend"))
    return names.join(hit, "repo", "left").withColumn("backend", F.coalesce("backend", F.lit(default)))


def same_backend(pairs: DataFrame, routes: DataFrame, default: str = "default") -> DataFrame:
    """pairs: source, target. Adds same: whether both are routed alike."""
    names = pairs.select(F.col("source").alias("repo")).unionAll(pairs.select(F.col("target").alias("repo"))).distinct()
    at = longest_prefix(names, routes, default)
    out = pairs.join(at.select(F.col("repo").alias("source"), F.col("backend").alias("_s")), "source").join(at.select(F.col("repo").alias("target"), F.col("backend").alias("_t")), "target")
    return out.withColumn("same", F.col("_s") == F.col("_t")).drop("_s", "_t")


def mountable(requests: DataFrame, blobs: DataFrame, readable: DataFrame, routes: DataFrame) -> DataFrame:
    """requests: source, target, digest. Adds ok: the source has the blob, may be read, and shares the target's backend."""
    has = blobs.select(F.col("repo").alias("source"), "digest").distinct().withColumn("_has", F.lit(True))
    may = readable.select(F.col("repo").alias("source")).distinct().withColumn("_may", F.lit(True))
    out = same_backend(requests, routes).join(has, ["source", "digest"], "left").join(may, "source", "left")
    return out.withColumn("ok", F.coalesce("_has", F.lit(False)) & F.coalesce("_may", F.lit(False)) & F.col("same")).drop("_has", "_may", "same")


def canonical(writes: DataFrame) -> DataFrame:
    """writes: digest, repo, seq. digest, canonical: the repository that wrote a digest first."""
    return writes.groupBy("digest").agg(F.min_by("repo", F.struct("seq", "repo")).alias("canonical"))


def locate(writes: DataFrame) -> DataFrame:
    """repo, digest, canonical of every holder but the canonical one itself."""
    return writes.select("repo", "digest").distinct().join(canonical(writes), "digest").filter("repo <> canonical")


def savings(writes: DataFrame) -> DataFrame:
    """Extension. Bytes that repositories count and bytes that are stored once a digest."""
    each = writes.select("repo", "digest", "size").distinct().groupBy("digest").agg(F.max("size").alias("size"), F.count("*").alias("n"))
    return each.agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("logical_bytes"), F.sum("size").cast("long").alias("stored_bytes"))


def linked_copies(files: DataFrame) -> DataFrame:
    """files: repo, digest, device, inode. repo, digest, others: the other repositories whose file is the same inode."""
    group = Window.partitionBy("digest", "device", "inode")
    return files.withColumn("_all", F.collect_set("repo").over(group)).withColumn("others", F.sort_array(F.array_except("_all", F.array("repo")))).filter(F.size("others") > 0).select("repo", "digest", "others")
