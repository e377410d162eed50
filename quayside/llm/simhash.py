"""SimHash near-duplicates: pigeonhole blocks, verified Hamming distance, connected components.

A fingerprint has 64 bits; two of them at distance d or less agree in at least k - d of k blocks. So each
fingerprint gets a key for every choice of k - d blocks, and close pairs share a key. k grows with the number of
distinct fingerprints, so that a key has a few bits more than that number and chance meetings stay few; the result
doesn't depend on k. Equal fingerprints meet once.

Within a key nothing but a spanning forest of its links is kept. Keys with up to DENSE fingerprints are compared in
numpy; of larger ones every fingerprint is spread over all points at distance ceil(d / 2) or less (the shared blocks
stay), where two at distance d or less meet at a point between them, and a minimum per point links them: a number of
rows in proportion to the fingerprints, however many share the key.

Distances over POINTS have too many such points, and keys of few bits. There k is the one by which rows and comparisons
cost the least, and a key with over WIDE fingerprints is cut into parts whose pairs are compared each by itself, in any
task: all of its pairs meet, but their number is that of pairs.

Nulls: a null text has no words and fingerprint zero, like an empty one. A null id stands after all others; a
component of null ids only has a null id. Repeated rows share a fingerprint. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import NO_ID, Stored, free_shuffles, mapped, order_id, store
from quayside.llm.components import components

SEED = 42
#: Fingerprints of one key that are compared directly at most.
DENSE = 4096
#: The greatest distance at which points link large keys; beyond it, the fingerprints of one key that are compared at once.
POINTS, WIDE = 4, 1 << 14
#: Comparisons that cost what it costs to bring a fingerprint to a key.
_ROW = 1000
_STEP = 1 << 15


def simhash(text: bytes, shingle: int = 4, seed: int = SEED) -> int:
    """A bit is set if over half of the hashes of the word shingles have it. bytes.lower and bytes.split know A-Z and the six ASCII spaces only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    total = len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, total, _STEP):
        end = min(total, at + _STEP)
        spans = zip(starts[at:end].tolist(), ends[at + shingle - 1 : end + shingle - 1].tolist())
        h = np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, end - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def of_set(hashes: np.ndarray) -> int:
    """The fingerprint of a set of hashes, each of which counts once: as simhash, but for shingles that are repeated."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STEP):
        counts += np.unpackbits(hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            fps = np.fromiter((simhash((t.as_buffer().to_pybytes() if t.is_valid else b"")) for t in texts.cast(pa.large_binary())), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return mapped(rows, run, f"{schema}, fp long")


def hex_digits(fp: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def id_of(ord_: str) -> Column:
    """The id that an ord stands for; the last one stands for null."""
    return F.when(F.col(ord_) < NO_ID, F.col(ord_))


def block_masks(n: int, distance: int) -> list[int]:
    """The masks of all choices of k - distance blocks; k is the least with keys of 3 bits more than n has, beyond POINTS
    the one that costs the least."""
    for k in range(distance + 1, 17):
        if k == 16 or 64 * (k - distance) / k >= n.bit_length() + 3:
            break
    if distance > POINTS:
        k = min(range(distance + 1, max(17, distance + 3)), key=lambda k: comb(k, distance) * (_ROW + n / 2 ** (64 * (k - distance) // k + 1)))
    edges = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, k - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(fps: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Spanning edges of the links among fps: a search that compares each fingerprint with those not reached yet."""
    left, us, vs = fps, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            reached = []
            for x in front:
                near = np.bitwise_count(left ^ x) <= distance
                if near.any():
                    found = left[near]
                    us += found.tolist()
                    vs += [int(x)] * len(found)
                    reached.append(found)
                    left = left[~near]
                    if not len(left):
                        break
            front = np.concatenate(reached) if reached else left[:0]
    return us, vs


def links(fps: DataFrame, n: int, distance: int = 4) -> DataFrame:
    """u, v (u > v): of the graph on the distinct fingerprints fps.fp, edges that connect what distance connects."""
    spark = fps.sparkSession
    masks = block_masks(n, distance)
    keys = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])).alias("k")).select("fp", "k.choice", "k.key")
    most, told = (DENSE, []) if distance <= POINTS else (WIDE, ["count"])
    dense = Stored(keys.groupBy("choice", "key").count().filter(F.col("count") > most).select("choice", "key", *told))
    sparse = keys.join(dense.df.select("choice", "key"), ["choice", "key"], "left_anti").groupBy("choice", "key").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets = np.asarray(lists.offsets)
            values = np.asarray(lists.values).view(np.uint64)
            us, vs = [], []
            pairs = offsets[:-1][np.diff(offsets) == 2]
            a, b = values[pairs], values[pairs + 1]
            near = np.bitwise_count(a ^ b) <= distance
            us.append(a[near])
            vs.append(b[near])
            for i in np.flatnonzero(np.diff(offsets) > 2).tolist():
                x, y = _forest(values[offsets[i] : offsets[i + 1]], distance)
                us.append(np.array(x, np.uint64))
                vs.append(np.array(y, np.uint64))
            u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    out = mapped(sparse, compare, "u long, v long")
    if not dense.df.isEmpty():
        members = keys.join(dense.df, ["choice", "key"])
        out = out.unionByName(_dense_links(members, masks, distance) if distance <= POINTS else mapped(_parts(members), compare, "u long, v long"))
    return out


def _parts(members: DataFrame) -> DataFrame:
    """fps: for every two parts of a key, of about WIDE / 2 fingerprints each, those of both."""
    n = F.ceil(F.col("count") / F.lit(max(WIDE // 2, 1)))
    dealt = members.withColumn("own", F.pmod(F.xxhash64("fp"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    both = dealt.groupBy("choice", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    return both.agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")


def _dense_links(members: DataFrame, masks: list[int], distance: int) -> DataFrame:
    half = -(-distance // 2)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = {}
        for choice, m in enumerate(masks):
            free = [np.uint64(1 << i) for i in range(64) if not m >> i & 1]
            flips[choice] = np.array([sum(c, np.uint64(0)) for r in range(half + 1) for c in combinations(free, r)], np.uint64)
        for batch in batches:
            for fp, choice in zip(np.asarray(batch.column(0)).view(np.uint64), batch.column(1).to_pylist()):
                at = fp ^ flips[choice]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), choice, np.int32)), pa.array(at.view(np.int64)), pa.array(np.full(len(at), fp).view(np.int64))], names=["choice", "point", "fp"])

    spread = mapped(members.select("fp", "choice"), points, "choice int, point long, fp long")
    least = spread.groupBy("choice", "point").agg(F.min("fp").alias("v"))
    return spread.join(least, ["choice", "point"]).filter("fp > v").select(F.col("fp").alias("u"), "v").distinct()


def with_components(rows: DataFrame, distance: int = 4) -> DataFrame:
    """rows: a stored table with ord and fp. Adds component, the least ord that links reach."""
    fps = Stored(rows.groupBy("fp").agg(F.min("ord").alias("least")))
    n = fps.df.count()
    found = components(links(fps.df, n, distance))
    free_shuffles(rows.sparkSession)
    linked = found.join(fps.df.withColumnRenamed("fp", "node"), "node")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = store(linked.join(least, "root").select(F.col("node").alias("fp"), "component"))
    alone = fps.df.join(of_fp, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(alone, "fp")


def near_duplicates(docs: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, ord, fp, component of every row of docs."""
    rows = store(with_fingerprint(docs.withColumn("ord", order_id()), ["doc_id", "ord"]))
    return with_components(rows, distance)


def one_of_each(docs: DataFrame, distance: int = 4) -> DataFrame:
    """docs without near-duplicates: of each component the row with the least id (of equal ids the least hash of its text) stays."""
    keyed = docs.withColumn("_ord", order_id()).withColumn("_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = store(with_fingerprint(keyed.select(F.col("_ord").alias("ord"), F.col("_hash").alias("hash"), "text"), ["ord", "hash"]))
    best = with_components(rows, distance).groupBy("component").agg(F.min(F.struct("ord", "hash")).alias("best")).select(F.col("best.ord").alias("_ord"), F.col("best.hash").alias("_hash"))
    return keyed.join(best, ["_ord", "_hash"]).dropDuplicates(["_ord", "_hash"]).select(*docs.columns)
