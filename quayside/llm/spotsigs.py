"""Document fingerprints: SpotSigs.

Wherever a common word (an anchor) stands, it and the next CHAIN content words form a signature; a document's
fingerprint is the sorted set of its signatures' 32-bit hashes, eight hex digits each. Likeness is the Jaccard
similarity of two sets. Where no signature forms, every word is an anchor; a text without words has the empty
fingerprint, and two empty ones are alike (1).

Matching (classes) is that of nearsets on these sets: keys of a set's rarest signatures, cut into partitions of set lengths,
pairs pruned by sizes and places, the rest compared in full, and connected. Equal sets meet once and are of one class, as
all empty ones are.

For a document's successor the ids are cut into ranges by their quantiles, and the first document of a range is also
sent to the range before; a task streams its ranges in order. Texts move once, and classes come with them.

Nulls: a null text is empty; in descending order of ids a null id comes last, and repeated ids follow each other by
their texts' hashes. A single document is its own successor. Long texts are whole in their task. An empty table gives an
empty result. Columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm import nearsets
from quayside.llm.common import NO_ID, mapped, mix64, text_bytes, text_slices, word_hashes, word_spans

CHAIN = 2
#: Ranges of ids at most; the driver holds a bound for each.
RANGES = 1 << 16

#: Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be by for from has have in is it not of on or that the this to was were will with
aber als an auch auf aus bei das dem den der des die ein eine einer es für im in ist mit nicht sich sie und von vor werden zu
au aux avec ce cette dans de des du elle en est et il la le les mais ne on ou par pas pour que qui se sur un une
al como con de del el en es esta ha la las lo los más no o para pero por que se sin su un una y
""".split()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def _anchor_hashes() -> np.ndarray:
    raw, borders = text_bytes(pa.array(sorted(set(ANCHORS))))
    starts, ends, _ = word_spans(raw, borders)
    return np.sort(word_hashes(raw, starts, ends))


_ANCHOR = _anchor_hashes()
_QUICK = np.zeros(1 << 16, bool)
_QUICK[(_ANCHOR >> np.uint64(48)).astype(np.int64)] = True


def _is_anchor(h: np.ndarray) -> np.ndarray:
    out = _QUICK[(h >> np.uint64(48)).astype(np.int64)]
    maybe = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(_ANCHOR, h[maybe]), len(_ANCHOR) - 1)
    out[maybe] = _ANCHOR[at] == h[maybe]
    return out


def _chains(h: np.ndarray, anchors: np.ndarray, content: np.ndarray, cuts: np.ndarray, chain: int) -> tuple[np.ndarray, np.ndarray]:
    """The signature of each anchor that chain content words of its document follow, and its place in words."""
    before = np.cumsum(content) if len(content) else np.zeros(0, np.int64)
    places = np.flatnonzero(content)
    at = np.flatnonzero(anchors)
    next_ = before[at]  # content words up to the anchor; if it is one itself, it isn't counted as following
    end = cuts[np.searchsorted(cuts, at, side="right")]
    whole = next_ + chain <= len(places)
    at, next_, end = at[whole], next_[whole], end[whole]
    inside = places[next_ + chain - 1] < end
    at, next_ = at[inside], next_[inside]
    out = mix64(h[at])
    for i in range(chain):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[places[next_ + i]])
    return (out >> np.uint64(32)).astype(np.uint32), at


def signature_sets(texts: pa.Array, chain: int = CHAIN) -> list[np.ndarray]:
    """The sorted distinct signatures of each text."""
    out: list[np.ndarray] = []
    for a, b in text_slices(texts):
        raw, borders = text_bytes(texts.slice(a, b - a))
        raw = _LOWER[raw]
        starts, ends, cuts = word_spans(raw, borders)
        while len(going := np.flatnonzero((ends > starts) & _SIGN[raw[np.maximum(ends - 1, 0)]])):
            ends[going] -= 1
        while len(going := np.flatnonzero((ends > starts) & _SIGN[raw[np.minimum(starts, len(raw) - 1)]])):
            starts[going] += 1
        h = word_hashes(raw, starts, ends)
        anchors = _is_anchor(h)
        made, at = _chains(h, anchors, ~anchors & (ends > starts), cuts, chain)
        edges = np.searchsorted(at, cuts)
        every = np.ones(len(h), bool)
        for i in range(b - a):
            own = made[edges[i] : edges[i + 1]]
            if not len(own) and cuts[i + 1] > cuts[i]:  # no signature: chains from every word, or the words alone
                part = h[cuts[i] : cuts[i + 1]]
                own, _ = _chains(part, every[: len(part)], every[: len(part)], np.array([0, len(part)]), chain)
                if not len(own):
                    own = (mix64(part) >> np.uint64(32)).astype(np.uint32)
            out.append(np.unique(own))
    return out


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two sorted sets; 0 at once if their sizes alone keep it under least."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def digits(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and sigs, the set as an array of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signature_sets(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], names=[*keep, "sigs"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return mapped(rows, run, f"{schema}, sigs array<long>")


def wide_sets(column: pa.Array) -> Iterator[np.ndarray]:
    return (s.astype(np.uint64) for s in signature_sets(column))


def classes(docs: DataFrame) -> DataFrame:
    """ord, hash, first of nearsets.classes, by likeness 0.8 or more of signature sets."""
    return nearsets.classes(docs, wide_sets, by_size=True)


def _ranged(docs: DataFrame, ids: DataFrame, most: int) -> DataFrame:
    """docs (ord, whose values are ids.ord) with range, the place of ord's range in descending order, and extra: true for the first rows of the
    next range (of the first one after the last), which are there a second time."""
    rows = ids.count()
    n = max(1, min(most, rows // 500))
    cuts = ids.agg(F.percentile_approx("ord", [i / n for i in range(1, n)], 50 * n)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts))
    steps = max(1, len(cuts).bit_length())
    # binary search: the number of cuts at or under ord
    move = "element_at(cuts, (s.lo + s.hi) div 2 + 1) <= ord"
    found = f"""aggregate(sequence(1, {steps}), named_struct('lo', 0, 'hi', size(cuts)), (s, i) -> CASE WHEN s.lo >= s.hi THEN s
        WHEN {move} THEN named_struct('lo', (s.lo + s.hi) div 2 + 1, 'hi', s.hi)
        ELSE named_struct('lo', s.lo, 'hi', (s.lo + s.hi) div 2) END, s -> s.lo)""".replace("(s.lo + s.hi) div 2", "cast((s.lo + s.hi) div 2 as int)")

    def put(df: DataFrame) -> DataFrame:
        df = df.withColumn("cuts", F.lit(cuts or [0]).cast("array<long>")) if cuts else df
        return (df.withColumn("range", F.lit(len(cuts)) - F.expr(found)).drop("cuts") if cuts else df.withColumn("range", F.lit(0))).withColumn("range", F.col("range").cast("int"))

    heads = put(ids).groupBy("range").agg(F.max("ord").alias("head")).collect()
    heads = sorted((r["range"], r["head"]) for r in heads)
    before = [(h, heads[i - 1][0]) for i, (_, h) in enumerate(heads)]
    table = F.broadcast(docs.sparkSession.createDataFrame(before, "head long, before int"))  # a row a range, RANGES at most
    both = put(docs).join(table, F.col("ord") == F.col("head"), "left").drop("head")
    own = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")))
    twice = F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("range"), F.lit(True).alias("extra")))
    at = F.explode(F.when(F.col("before").isNull(), own).otherwise(twice))
    return both.withColumn("_at", at).withColumn("range", F.col("_at.range")).withColumn("extra", F.col("_at.extra")).drop("_at", "before")


def edited_text(text: str, after: str) -> str:
    """text with its last half (rounded down) replaced by as many of the first characters of after, or all there are."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_successors(docs: DataFrame, chain: int = CHAIN, ranges: int = RANGES, classes: DataFrame | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row of docs; with
    classes also class_id, the least id of its class."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    low = F.lit(-(1 << 63))  # descending order: a null id comes last
    none = F.lit(None).cast("long")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), low).alias("ord"), F.xxhash64(text).alias("mark"), text.alias("text"), F.lit(True).alias("doc"), none.alias("class"))
    both = rows
    if classes is not None:  # a row before the documents that it is for
        at = F.when(F.col("ord") == NO_ID, low).otherwise(F.col("ord"))
        first = F.when(F.col("first.ord") != NO_ID, F.col("first.ord"))
        both = rows.unionByName(classes.select(F.lit(None).cast(kind).alias("doc_id"), at.alias("ord"), F.col("hash").alias("mark"), F.lit("").alias("text"), F.lit(False).alias("doc"), first.alias("class")))
    placed = _ranged(both, rows.select("ord"), ranges)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] + ["class_id"] * (classes is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # range, doc_id, text, set, class of the row that waits for its successor
        own_class = None

        def out(ready: list[tuple]) -> pa.RecordBatch:
            edited = [edited_text(r[1], r[4]) for r in ready]
            sets = signature_sets(pa.array(edited, pa.string()), chain)
            columns = [
                pa.array([r[0] for r in ready], doc_type), pa.array([len(r[1]) for r in ready], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array([digits(r[2]) for r in ready]), pa.array([digits(s) for s in sets]),
                pa.array([jaccard(r[2], s) for r, s in zip(ready, sets)]), pa.array([jaccard(r[2], r[5]) for r in ready]), pa.array([r[3] for r in ready], pa.int64()),
            ]
            kinds = [doc_type, pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int64()]
            return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)][: len(names)], names=names)

        for whole in batches:
            doc_type = whole.schema.field(1).type
            for a, b in text_slices(whole.column(3)):
                batch = whole.slice(a, b - a)
                sets = signature_sets(batch.column(3), chain)
                ready = []
                for (at, doc, extra, text, is_doc, of), own in zip(zip(*(c.to_pylist() for c in batch.columns)), sets):
                    if not is_doc:
                        own_class = of
                        continue
                    if last is not None and last[0] == at:
                        ready.append((*last[1:], text, own))
                    last = None if extra else (at, doc, text, own, own_class)
                if ready:
                    yield out(ready)

    ordered = placed.repartition("range").sortWithinPartitions("range", "extra", F.desc("ord"), "mark", "doc").select("range", "doc_id", "extra", "text", "doc", "class")
    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return mapped(ordered, run, schema + ", class_id long" * (classes is not None))
