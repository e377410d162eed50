"""Scrubbing: what a stored blob's bytes say about its records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.digests import is_digest, matches_digest


def classify(blobs: DataFrame, recorded: DataFrame, fast: Column, sized: Column) -> DataFrame:
    """blobs: repo, digest, content; recorded: repo, digest, crc, size. Adds result: `ok` if size and fast checksum agree
    with the record, or if there is no record and the digest holds; `repaired` if the record disagrees but the digest
    holds; `corrupt` if the digest doesn't; `skipped` if the content can't be read or the digest is none.

    fast is the checksum's expression over content. The digest is only computed where the fast check didn't settle it."""
    r = recorded.select("repo", "digest", F.col("crc").alias("_crc"), F.col("size").alias("_size"))
    out = blobs.join(r, ["repo", "digest"], "left")
    agrees = F.coalesce((F.col("_size") == sized) & (F.col("_crc") == fast), F.lit(False))
    result = (
        F.when(F.col("content").isNull() | ~is_digest("digest"), "skipped").when(agrees, "ok").when(~matches_digest("content", "digest"), "corrupt")
        .when(F.col("_size").isNull(), "ok").otherwise("repaired")
    )
    return out.withColumn("result", result).drop("_crc", "_size")


def summary(classified: DataFrame, sized: Column) -> DataFrame:
    """result, blobs, bytes."""
    return classified.groupBy("result").agg(F.count("*").alias("blobs"), F.sum(sized).cast("long").alias("bytes"))


def verify(uploads: DataFrame, max_bytes: int) -> DataFrame:
    """uploads: digest, content. Adds verdict: `too large`, `invalid digest`, `mismatch` or `accepted`."""
    size = F.octet_length("content")
    verdict = F.when(size > max_bytes, "too large").when(~is_digest("digest"), "invalid digest").when(~matches_digest("content", "digest"), "mismatch").otherwise("accepted")
    return uploads.withColumn("verdict", verdict)


def throttle(blobs: DataFrame, rate: float, burst: float) -> DataFrame:
    """blobs: worker, position, size. Adds wait_s: the pause before each read of a bucket that may go into debt. Tokens
    start at burst; a read takes its size at once and the next one waits until the bucket is out of debt."""
    schema = T.StructType([*blobs.select("worker", "position", "size").schema.fields, T.StructField("wait_s", T.DoubleType())])

    def fold(batches):
        worker, tokens = None, burst
        for frame in batches:
            waits = []
            for w, size in zip(frame["worker"], frame["size"]):
                if w != worker:
                    worker, tokens = w, burst
                wait = max(0.0, -tokens / rate)
                waits.append(wait)
                tokens = min(burst, tokens + wait * rate) - size
            yield frame.assign(wait_s=waits)

    return blobs.select("worker", "position", "size").repartition("worker").sortWithinPartitions("worker", "position").mapInPandas(fold, schema)


def verdicts(requests: DataFrame, limit: int) -> DataFrame:
    """requests: size. Adds redirect: a blob large enough to be served by the object store itself."""
    return requests.withColumn("redirect", F.col("size") >= limit)
