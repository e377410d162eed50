"""Sharding by rendezvous (highest random weight) hashing of stable record keys over weighted shards.

Each shard draws a number from a hash of the key and the shard; the largest of -weight / ln(draw) wins. A shard's
draws don't depend on the others, so one more shard takes rows only into itself and moves its share alone.

Nulls: a null key is one key (all its rows meet in one shard; slots stay gapless); a null text has no bytes and
the CRC of nothing (0). Repeated rows get slots of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, shard: Column, seed: int = 0) -> Column:
    """Uniform in (0, 1): the upper 53 bits of a hash of key and shard."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), key, shard), 11).cast("double") + 0.5) / float(1 << 53)


def scores(key: Column, weights: list[float], seed: int = 0) -> Column:
    """An array with a struct (score, shard) for each shard of positive weight."""
    return F.array(*[F.struct((F.lit(-float(w)) / F.log(draw(key, F.lit(s), seed))).alias("score"), F.lit(-s).alias("shard")) for s, w in enumerate(weights) if w > 0])


def assign(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard of each key; equal scores go to the smaller shard."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    return (-F.array_max(scores(key, weights, seed))["shard"]).cast("int")


def numbered(df: DataFrame, shard: str, key: Column, order: list[Column], slot: str = "slot", ranges: int = 64) -> DataFrame:
    """A gapless number from 0 within each shard. Rows are counted in hash ranges of each shard, so that a shard's
    rows are numbered by many tasks; the numbers follow (range, order)."""
    df = df.withColumn("_range", F.pmod(F.xxhash64(F.lit("range"), key), F.lit(ranges)).cast("int"))
    counts = df.groupBy(shard, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(shard, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(shard, "_range").orderBy(*order))
    return df.withColumn("_at", at).join(counts, [shard, "_range"]).withColumn(slot, (F.col("_before") + F.col("_at") - 1).cast("long")).drop("_range", "_before", "_at")


def shard_documents(docs: DataFrame, weights: list[float], added: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one more shard of weight added). Texts don't move."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.col("doc_id").cast("long")
    rows = docs.select(
        "doc_id", (F.octet_length(text) + F.lit(16)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"),
        assign(key, weights, seed).alias("shard"), assign(key, [*weights, added], seed).alias("grown_shard"),
    )
    ranges = max(64, 1024 // max(1, len(weights)))
    # the range of a row comes from its key and text, so that a key which many rows share is spread
    spread = F.struct("doc_id", "text_crc32", "size")
    return numbered(rows, "shard", spread, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot", ranges).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
