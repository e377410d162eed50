"""Image layouts on any file system that Spark reads: discovery, blob listing, index documents, contents.

Listings come from the binaryFile source; a query that doesn't use `content` never reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.digests import is_digest

#: Fixed value: folders deeper than this aren't searched.
MAX_DEPTH = 16


def _files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files under root with `rel`, the path from root; null-free and without hidden folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    rel = F.expr("substring(path, instr(path, base) + length(base) + 1)")
    return found.withColumn("base", F.lit(base)).withColumn("rel", F.ltrim(rel, F.lit("/"))).drop("base").filter(~F.col("rel").rlike(r"(^|/)\."))


def _repo(rel: Column, tail: str) -> Column:
    return F.regexp_extract(rel, f"^(.+)/{tail}$", 1)


def repositories(spark: SparkSession, root: str) -> DataFrame:
    """repo: folders with an index.json or oci-layout file, at most MAX_DEPTH deep, none inside blobs or uploads."""
    f = _files(spark, root).filter(F.col("rel").rlike(r"^.+/(index\.json|oci-layout)$"))
    repo = _repo(F.col("rel"), r"(?:index\.json|oci-layout)")
    return f.select(repo.alias("repo")).filter((F.size(F.split("repo", "/")) <= MAX_DEPTH) & ~F.col("repo").rlike("(^|/)(blobs|uploads)(/|$)")).distinct()


def blobs(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """repo, digest, size, changed_at (and content) of every file <repo>/blobs/<algorithm>/<hex> whose name is a digest."""
    parts = lambda k: F.regexp_extract("rel", r"^(.+)/blobs/([a-z0-9]+)/([0-9A-Fa-f]+)$", k)
    f = _files(spark, root).select(parts(1).alias("repo"), F.lower(F.concat(parts(2), F.lit(":"), parts(3))).alias("digest"), F.col("length").alias("size"), F.col("modificationTime").alias("changed_at"), *([F.col("content")] if content else []))
    return f.filter(is_digest("digest"))


def indexes(spark: SparkSession, root: str) -> DataFrame:
    """repo, body: each repository's index document as text."""
    f = _files(spark, root, "index.json")
    return f.select(_repo(F.col("rel"), r"index\.json").alias("repo"), F.col("content").cast("string").alias("body")).filter("repo <> ''")


def part_of(content: Column, start: Column, length: Column) -> Column:
    """length bytes of content from start (0 is the first)."""
    return F.substring(content, start + 1, length)


def write_indexes(rows: DataFrame, path: str) -> None:
    """rows: repo, body, as layout.to_index makes them. One text file a repository's partition, replaced as a whole."""
    rows.select("repo", F.col("body").alias("value")).write.mode("overwrite").partitionBy("repo").text(path)
