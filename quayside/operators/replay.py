"""Replay, compaction and comparison of the metadata log.

The log is a table of records with a sequence number. State is the latest record per key, compared with the latest
deletion that touches it, so a replay is aggregations and equi-joins, in any order of the files.

Records: seq, op, repo, digest, media_type, tag, refs (array), subject, artifact_type, crc, size. Operations:
put_manifest, delete_manifest, put_backrefs, put_referrer, put_checksum, delete_blob.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def valid_prefix(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """log: seq, ok. What comes before the first record that is truncated or fails its check, in each of by or at all."""
    bad = log.filter("NOT ok").groupBy(*(by or [])).agg(F.min("seq").alias("_bad"))
    out = log.join(bad, by, "left") if by else log.crossJoin(F.broadcast(bad))  # one row
    return out.filter("_bad IS NULL OR seq < _bad").drop("_bad")


def _deletes(log: DataFrame, ops: tuple[str, ...] = ("delete_manifest",)) -> DataFrame:
    return log.filter(F.col("op").isin(*ops)).groupBy("repo", "digest").agg(F.max("seq").alias("_gone"))


def tags(log: DataFrame) -> DataFrame:
    """repo, tag, digest, media_type. The latest put of a tag holds, and is gone if its manifest was deleted later: a tag
    that moved away from a manifest doesn't come back when the new one goes."""
    put = log.filter((F.col("op") == "put_manifest") & F.col("tag").isNotNull())
    last = put.groupBy("repo", "tag").agg(F.max(F.struct("seq", "digest", "media_type")).alias("p")).select("repo", "tag", "p.*")
    return last.join(_deletes(log), ["repo", "digest"], "left").filter("_gone IS NULL OR _gone < seq").select("repo", "tag", "digest", "media_type")


def manifests(log: DataFrame) -> DataFrame:
    """repo, digest, media_type of manifests put after their last deletion, tagged or not."""
    last = log.filter(F.col("op") == "put_manifest").groupBy("repo", "digest").agg(F.max(F.struct("seq", "media_type")).alias("p")).select("repo", "digest", "p.*")
    return last.join(_deletes(log), ["repo", "digest"], "left").filter("_gone IS NULL OR _gone < seq").select("repo", "digest", "media_type")


def edges(log: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """repo, manifest, blob: the set of references that some put after the manifest's last deletion carried. references
    (seq, repo, manifest, blob) takes the place of the records' arrays if given."""
    refs = references if references is not None else log.filter(F.col("op").isin("put_manifest", "put_backrefs")).select("seq", "repo", F.col("digest").alias("manifest"), F.explode("refs").alias("blob"))
    last = refs.groupBy("repo", "manifest", "blob").agg(F.max("seq").alias("seq"))
    gone = _deletes(log).withColumnRenamed("digest", "manifest")
    return last.join(gone, ["repo", "manifest"], "left").filter("_gone IS NULL OR _gone < seq").select("repo", "manifest", "blob")


def referrers(log: DataFrame) -> DataFrame:
    """repo, subject, referrer, artifact_type. Deleting the referrer removes the row, deleting the subject doesn't."""
    put = log.filter(F.col("op").isin("put_manifest", "put_referrer") & F.col("subject").isNotNull())
    last = put.groupBy("repo", "subject", F.col("digest")).agg(F.max(F.struct("seq", "artifact_type")).alias("p")).select("repo", "subject", "digest", "p.*")
    return last.join(_deletes(log), ["repo", "digest"], "left").filter("_gone IS NULL OR _gone < seq").select("repo", "subject", F.col("digest").alias("referrer"), "artifact_type")


def checksums(log: DataFrame) -> DataFrame:
    """repo, digest, crc, size: the last recorded ones that neither deletion came after."""
    last = log.filter(F.col("op") == "put_checksum").groupBy("repo", "digest").agg(F.max(F.struct("seq", "crc", "size")).alias("p")).select("repo", "digest", "p.*")
    return last.join(_deletes(log, ("delete_manifest", "delete_blob")), ["repo", "digest"], "left").filter("_gone IS NULL OR _gone < seq").select("repo", "digest", "crc", "size")


def untagged(manifests_: DataFrame, tags_: DataFrame) -> DataFrame:
    """Manifests without a tag; they are roots of the collector all the same."""
    return manifests_.join(tags_.select("repo", "digest"), ["repo", "digest"], "left_anti")


def compact(manifests_: DataFrame, tags_: DataFrame, edges_: DataFrame, referrers_: DataFrame, checksums_: DataFrame) -> DataFrame:
    """The least log with the same state: op, repo, digest, tag, media_type, other, extra."""
    none = F.lit(None).cast("string")
    rows = lambda df, op, digest, tag, media, other, extra: df.select(F.lit(op).alias("op"), "repo", digest.alias("digest"), tag.alias("tag"), media.alias("media_type"), other.alias("other"), extra.alias("extra"))
    c = F.col
    parts = [
        rows(tags_, "put_manifest", c("digest"), c("tag"), c("media_type"), none, none),
        rows(untagged(manifests_, tags_), "put_manifest", c("digest"), none, c("media_type"), none, none),
        rows(edges_, "put_backrefs", c("manifest"), none, none, c("blob"), none),
        rows(referrers_, "put_referrer", c("referrer"), none, none, c("subject"), c("artifact_type")),
        rows(checksums_, "put_checksum", c("digest"), none, none, c("crc").cast("string"), c("size").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def needs_compaction(growth_bytes: int, threshold: int = 64 << 20) -> bool:
    """Whether the log has grown by more than the threshold since its last image; a threshold of 0 never asks for it."""
    return threshold > 0 and growth_bytes > threshold


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one of two tables of the same columns has, by multiplicity, with side; none means equal tables."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
