"""Cursor pages, catalogues, snapshots and orders.

A page starts strictly after its cursor, which need not exist; `more` tells whether anything follows the page. Pages of
one partition are a filter and a top-k; first pages of all partitions are a ranked window that Spark limits per group
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.operators.ordered import numbered, running_sum
from quayside.shared import written

#: Fixed value: the server's limit on a page.
MAX_PAGE = 1000


def clamp(n: int | None, most: int = MAX_PAGE) -> int:
    return most if n is None else min(n, most)


def page(rows: DataFrame, key: str, last: str | None, limit: int) -> DataFrame:
    """At most limit rows by key after last, and more. With limit 0 there are no rows, whatever follows."""
    after = rows if last is None else rows.filter(F.col(key) > last)
    head = after.orderBy(key).limit(limit + 1)
    n = Window.partitionBy(F.lit(0))  # limit + 1 rows at most
    ranked = head.withColumn("_n", F.count("*").over(n)).withColumn("_at", F.row_number().over(n.orderBy(key)))
    return ranked.filter(F.col("_at") <= limit).withColumn("more", F.col("_n") > limit).drop("_n", "_at")


def first_pages(rows: DataFrame, by: list[str], key: str, limit: int) -> DataFrame:
    """The first page of every partition, each row with more. One row over the limit per group is kept to know."""
    at = Window.partitionBy(*by).orderBy(key)
    ranked = rows.withColumn("_at", F.row_number().over(at)).filter(F.col("_at") <= limit + 1)
    return ranked.withColumn("more", F.max("_at").over(Window.partitionBy(*by)) > limit).filter(F.col("_at") <= limit).drop("_at")


def next_cursor(pages: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, cursor: the last key of a page that something follows, percent-encoded; no row where nothing follows."""
    return pages.filter("more").groupBy(*by).agg(F.url_encode(F.max(key)).alias("cursor"))


def referrers_page(referrers: DataFrame, repo: str, subject: str, artifact_type: str | None, last: str | None, limit: int) -> DataFrame:
    rows = referrers.filter((F.col("repo") == repo) & (F.col("subject") == subject))
    return page(rows if artifact_type is None else rows.filter(F.col("artifact_type") == artifact_type), "referrer", last, limit)


def subject_status(requests: DataFrame, referrers: DataFrame) -> DataFrame:
    """requests: repo, subject, artifact_type (null: any). known: the subject has referrers; n: those of the type. An
    unknown subject (known false) is not the same as a known one without that type (n 0)."""
    per_type = referrers.groupBy("repo", "subject", F.col("artifact_type").alias("_type")).agg(F.count("*").alias("_n"))
    hit = F.col("artifact_type").isNull() | (F.col("artifact_type") == F.col("_type"))
    out = requests.join(per_type, ["repo", "subject"], "left")
    return out.groupBy(*requests.columns).agg((F.max("_n").isNotNull()).alias("known"), F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("n"))


def catalog(manifests: DataFrame, referrers: DataFrame) -> DataFrame:
    """repo: those with a manifest or a referrer. Each side is made distinct before the union's shuffle."""
    return manifests.select("repo").unionAll(referrers.select("repo")).distinct()


def tags_snapshot(tags: DataFrame) -> DataFrame:
    """repo, tag, digest of all tags, by repository and tag. A range sort: no repository is gathered in a row."""
    return tags.select("repo", "tag", "digest").orderBy("repo", "tag")


def referrers_snapshot(referrers: DataFrame) -> DataFrame:
    """repo, subject, referrer, artifact_type, by repository, subject and referrer; repeated rows once."""
    return referrers.select("repo", "subject", "referrer", "artifact_type").distinct().orderBy("repo", "subject", "referrer")


def scrub_order(blobs: DataFrame) -> DataFrame:
    """repo, digest, place_in_repo, position: a repository's blobs in byte order, repositories taking turns.

    The position is counted, not sorted into one task: all blobs of earlier rounds, which follow from how many
    repositories have a given number of blobs, and the repositories of this round that come before. Places within a
    repository and sums over rounds are taken in two levels; a turn is ranked among one round's repositories."""
    ranked = written(numbered(blobs, ["repo"], "digest", "place_in_repo"))
    rounds = ranked.groupBy("place_in_repo").agg(F.count("*").alias("_in_round"))
    rounds = running_sum(rounds, [], "place_in_repo", "_in_round", "_through").select("place_in_repo", (F.col("_through") - F.col("_in_round")).alias("_before"))
    turn = F.row_number().over(Window.partitionBy("place_in_repo").orderBy("repo"))
    return ranked.withColumn("_turn", turn).join(rounds, "place_in_repo").withColumn("position", (F.col("_before") + F.col("_turn")).cast("long")).drop("_before", "_turn")


def adaptive_order(ordered: DataFrame, bad_repo: Column, after: int) -> DataFrame:
    """The order of what is left after position `after`, where a corrupt blob was found in bad_repo: the rest of that
    repository first. Returns repo, digest, position, turn (0: first)."""
    return ordered.filter(F.col("position") > after).withColumn("turn", F.when(F.col("repo") == bad_repo, 0).otherwise(1))
