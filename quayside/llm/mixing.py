"""Mixing sources to target weights with a low-discrepancy schedule of equal-token blocks.

The documents of a source stand in a shuffled order (by a hash of their id) and are cut into blocks of equal
word counts; a block may start or end inside a document. Slot i of the mix takes the point (i * golden ratio)
mod 1, maps it through the sources' cumulative shares of slots, and the k-th slot of a source takes its k-th
block, from the first one again after the last. So the sources interleave evenly at every length of prefix,
each one's words come to its target, and no word is taken more than ceil(target / size) <= limit times.

Positions are running sums in two levels (hash range within the source, then document), ranks are counted in
closed form, so neither a hot source nor the slots ever meet in one task. The driver holds one row a source.

Nulls: a null text has no words; a null source is a source of its own, after all others; a null id is an id.
Repeated rows are documents of their own. An empty table gives an empty mix. Other columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import cycle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quayside.llm.common import WORD, order_id, store

#: floor(2^31 / golden ratio), made odd: its multiples mod 2^31 are the points of the schedule.
STEP, MODULUS = 1327217885, 1 << 31
CHUNK = 1 << 16
#: Sources at most; the driver holds a row for each.
MAX_SOURCES = 1_000_000


@dataclass(frozen=True)
class Plan:
    """A row a source, in order: its words, target, blocks, whole slots and the words of the last, partial one."""

    names: list[str | None]
    sizes: list[int]
    targets: list[float]
    blocks: list[int]
    slots: list[int]
    last_words: list[int]

    def block_start(self, s: int, b: int) -> int:
        base, longer = divmod(self.sizes[s], self.blocks[s])
        return b * base + min(b, longer)


def share_out(sizes: list[int], weights: list[float], limit: float) -> list[float]:
    """Weighted shares of sum(sizes), none above limit * its size; what is cut off goes to the others by weight."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        weight = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / weight > limit * sizes[s]] if weight > 0 else []
        if not full:
            for s in open_:
                target[s] = left * weights[s] / weight if weight > 0 else 0.0
            break
        for s in full:
            target[s] = float(limit * sizes[s])
        open_ -= set(full)
        left -= sum(target[s] for s in full)
    return target


def below(n: int, m: int, a: int, b: int) -> int:
    """Sum over j < n of floor((a * j + b) / m), by Euclid's steps; b may be negative."""
    total = 0
    shift, b = divmod(b, m)
    total += n * shift
    while True:
        q, a = divmod(a, m)
        total += q * n * (n - 1) // 2
        q, b = divmod(b, m)
        total += q * n
        top = a * n + b
        if top < m:
            return total
        n, b = divmod(top, m)
        m, a = a, m


def points_below(n: int, cut: int) -> int:
    """How many of the first n points lie under cut."""
    return below(n, MODULUS, STEP, 0) - below(n, MODULUS, STEP, -cut) if n and cut else 0


def make_plan(rows: list[tuple[str | None, int]], weights: tuple[float, ...], limit: float, block_words: int) -> Plan:
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(n) for _, n in rows]
    targets = share_out(sizes, [w for w, _ in zip(cycle(weights), rows)], limit)
    plan = Plan([r[0] for r in rows], sizes, targets, [max(1, -(-n // block_words)) for n in sizes], [], [])
    for s, (size, target) in enumerate(zip(sizes, targets)):
        words = min(round(target), int(limit * size))
        epochs, rest = divmod(words, size) if size else (0, 0)
        base, longer = divmod(size, plan.blocks[s])
        edge = longer * (base + 1)
        b = rest // (base + 1) if rest < edge else longer + (rest - edge) // base if base else 0
        part = rest - plan.block_start(s, b)
        plan.slots.append(epochs * plan.blocks[s] + b + (part > 0))
        plan.last_words.append(part)
    return plan


def schedule(spark, plan: Plan) -> DataFrame:
    """slot, source_at (place in the plan), rank, block, epoch, words (null: the whole block)."""
    total = sum(plan.slots)
    edges = np.concatenate([[0], np.cumsum(plan.slots)]).tolist()
    cuts = [e * MODULUS // total for e in edges] if total else []
    slots, blocks, last = np.asarray(plan.slots, np.int64), np.asarray(plan.blocks, np.int64), np.asarray(plan.last_words, np.int64)

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                first, end = c * CHUNK, min(total, (c + 1) * CHUNK)
                if first < total:
                    at = np.arange(first, end, dtype=np.int64)
                    source = np.searchsorted(np.asarray(cuts[1:], np.int64), at % MODULUS * STEP % MODULUS, side="right")
                    order = np.argsort(source, kind="stable")
                    kinds, begin, counts = np.unique(source[order], return_index=True, return_counts=True)
                    rank = np.empty(len(at), np.int64)
                    for s, i, n in zip(kinds.tolist(), begin.tolist(), counts.tolist()):
                        before = points_below(first, cuts[s + 1]) - points_below(first, cuts[s])
                        rank[order[i : i + n]] = before + np.arange(n)
                else:  # a few slots that the points left out, after all others
                    missing = [max(0, plan.slots[s] - points_below(total, cuts[s + 1]) + points_below(total, cuts[s])) for s in range(len(plan.slots))]
                    source = np.repeat(np.arange(len(missing)), missing)
                    rank = np.concatenate([np.arange(plan.slots[s] - n, plan.slots[s]) for s, n in enumerate(missing)] or [np.zeros(0, np.int64)]).astype(np.int64)
                    at = total + np.arange(len(rank), dtype=np.int64)
                keep = rank < slots[source]
                at, source, rank = at[keep], source[keep], rank[keep]
                part = (rank == slots[source] - 1) & (last[source] > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(source.astype(np.int32)), pa.array(rank), pa.array(rank % blocks[source]), pa.array(rank // blocks[source]), pa.array(last[source], mask=~part)],
                    names=["slot", "source_at", "rank", "block", "epoch", "words"],
                )

    chunks = -(-total // CHUNK) + (total > 0)
    return spark.range(0, chunks, 1, max(1, min(chunks, 10_000))).mapInArrow(chunk, "slot long, source_at int, rank long, block long, epoch long, words long")


def positions(docs: DataFrame, plan: Plan) -> DataFrame:
    """Adds source_at and pos, the words of the source before the document in its shuffled order.

    docs has ord, source, size and h, the order. Of the running sum, one window is over hash ranges of a source, the
    other over the documents of one range; either sees about the square root of the largest source's documents."""
    spark = docs.sparkSession
    names = spark.createDataFrame([(i, n, n is None) for i, n in enumerate(plan.names)], "source_at int, source_name string, source_null boolean")
    docs = docs.join(F.broadcast(names) if len(plan.names) <= 10_000 else names, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name", "source_null")
    most = docs.groupBy("source_at").count().agg(F.max("count")).first()[0] or 0
    bits = most.bit_length() // 2
    docs = docs.withColumn("range", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = docs.groupBy("source_at", "range").agg(F.sum("size").alias("range_size"))
    ahead = Window.partitionBy("source_at").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_at", "range", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)).alias("range_pos"))
    within = Window.partitionBy("source_at", "range").orderBy("h", "ord", "size").rowsBetween(Window.unboundedPreceding, -1)
    return docs.withColumn("in_range", F.coalesce(F.sum("size").over(within), F.lit(0))).join(sums, ["source_at", "range"]).withColumn("pos", F.col("range_pos") + F.col("in_range")).drop("range", "in_range", "range_pos")


def pieces(docs: DataFrame, plan: Plan) -> DataFrame:
    """A row for each document and block that share words: lo and hi are words of the document, block_lo where lo lies in the block."""
    spark = docs.sparkSession
    shape = [(i, n, n // b, n % b) for i, (n, b) in enumerate(zip(plan.sizes, plan.blocks)) if n]
    shapes = spark.createDataFrame(shape, "source_at int, source_size long, base long, longer long")
    docs = docs.filter("size > 0").join(F.broadcast(shapes) if len(shape) <= 10_000 else shapes, "source_at")
    edge = "longer * (base + 1)"
    block = lambda at: F.expr(f"CASE WHEN {at} < {edge} THEN ({at}) div (base + 1) ELSE longer + ({at} - {edge}) div base END")
    start = lambda b: F.expr(f"{b} * base + least({b}, longer)")
    docs = docs.withColumn("block", F.explode(F.sequence(block("pos"), block("(pos + size - 1)"))))
    docs = docs.withColumn("from", start("block")).withColumn("to", start("(block + 1)"))
    return docs.withColumn("lo", F.greatest("from", "pos") - F.col("pos")).withColumn("hi", F.least(F.col("to"), F.col("pos") + F.col("size")) - F.col("pos")).withColumn("block_lo", F.greatest("from", "pos") - F.col("from")).drop("base", "longer", "from", "to", "source_size")


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, ord, text_hash, size and h, written once, as several passes use them."""
    return store(
        docs.select(
            F.col("doc_id"), F.col("source").cast("string").alias("source"), order_id().alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
            F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "ord", "text_hash"))
    )


def plan_for(base: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3, block_words: int | None = None) -> Plan:
    rows = base.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    total = sum(r["n"] for r in rows)
    return make_plan([(r["source"], r["n"]) for r in rows], weights, limit, block_words or max(8, min(8192, total >> 17)))


def mix(base: DataFrame, plan: Plan) -> DataFrame:
    """The mix in slots: slot, epoch, source_at, block and of each document in that block its row and words lo to hi."""
    parts = pieces(positions(base, plan), plan)
    taken = parts.join(schedule(base.sparkSession, plan), ["source_at", "block"])
    return taken.withColumn("hi", F.least("hi", F.col("lo") + F.coalesce("words", F.lit(NO_CUT)) - F.col("block_lo"))).filter("hi > lo")


NO_CUT = 1 << 62


def taken_words(base: DataFrame, plan: Plan) -> DataFrame:
    """Of each row of base: what the mix takes of it, in words, repeats counted; target and source_size beside it."""
    spark = base.sparkSession
    took = mix(base, plan).groupBy("source_at", "pos").agg(F.sum(F.col("hi") - F.col("lo")).alias("took"))
    sums = spark.createDataFrame(list(zip(range(len(plan.names)), plan.sizes, plan.targets)), "source_at int, source_size long, target double")
    rows = positions(base, plan).join(F.broadcast(sums) if len(plan.names) <= 10_000 else sums, "source_at")
    some = rows.filter("size > 0").join(took, ["source_at", "pos"], "left").withColumn("taken", F.coalesce("took", F.lit(0))).drop("took")
    return some.unionByName(rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))


def mix_stage(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), limit: float = 3) -> DataFrame:
    """The mixed documents with the columns of docs: a document that the mix takes k times whole is there k times,
    and once more with its first words if the schedule's end or a block's edge takes only a part of it.

    Documents without words are in no block and so not in the mix. Rows that share id, text and source are one row taken more
    often; where their other columns differ, those of one of them hold. Names of other columns may be any."""
    base = sized(docs)
    plan = plan_for(base, weights, limit)
    key = ["ord", "text_hash", "source"]
    took = taken_words(base, plan).groupBy(*key, "size").agg(F.sum("taken").alias("taken")).filter("taken > 0")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(whole, order_id().alias("ord"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.col("source").cast("string").alias("own")).dropDuplicates(["ord", "text_hash", "own"])
    rows = keyed.join(took, [keyed.ord == took.ord, keyed.text_hash == took.text_hash, keyed.own.eqNullSafe(took.source)]).select("row", "taken", "size")
    times, rest = F.expr("taken div size"), F.expr("taken % size")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times + (rest > 0).cast("long"))))
    words = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    text = F.when(F.col("copy") > times, F.array_join(F.slice(words, 1, rest.cast("int")), "")).otherwise(F.col("row.text"))
    made = {"text": text, "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
