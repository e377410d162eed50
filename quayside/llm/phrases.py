"""Repeated phrases: confirm recurring passages, compile sharded Aho-Corasick automata, locate every occurrence.

A window is `window` consecutive words. Its anchor is the least hash among its runs of GRAM words, so equal windows
have equal anchors, and neighbours mostly share one: a document becomes a list of (anchor, range of windows).

1. Texts are made distinct, each under the least id that has it, in a table bucketed by a 128-bit hash; later steps join
   it where it lies. Any copy under a greater id is covered whole by the first one's windows, so copies need no more work.
2. Anchors are counted over the corpus (combined before the shuffle); only ranges with an anchor seen at two places stay.
3. Those ranges' words, as segments, go to shards by anchor. The number of shards follows the words in segments, and an
   anchor with more than HOT words is dealt to several shards, so a shard's size doesn't grow with the corpus.
4. A shard confirms what recurs in it (windows that are in two different segments or twice in one, and whole segments
   that are there twice and have a window of no other), compiles these phrases into a pyahocorasick automaton and streams
   all its segments through it. A word begins at most one window, and a whole segment is found only as itself, so hits
   are at most words and segments, however periodic a text is. Each occurrence but a phrase's first (by id, then place)
   is removed.
5. What is first in its shard under an anchor that was dealt out may still have come earlier in another shard: these
   windows meet by a 128-bit hash, and all but the first are removed too.
6. The removed ranges join their texts, the covered words go, and the rows of all documents take their text's result.

Words compare exactly in the automata (a shard numbers its words; those of over LONG_WORD bytes stand there as a
128-bit hash, so that a shard's bytes are bounded too); other hashes only route.

Nulls: a null text has no words; a null id stands after all others. Rows that share an id are one document in the
order of windows: at the same place neither is earlier. Repeated rows get equal results, and repeated rows, copies and
ties cost one text. Texts shorter than a window lose nothing. Long texts are worked on whole, a task holding one text and
its hashes at a time. An empty table gives an empty result. Columns other than doc_id and text aren't read, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import Stored, free_shuffles, mapped, mix64, order_id, span_hashes, text_bytes, text_key, text_slices, word_hashes, word_spans

GRAM = 8
#: Words of an anchor's segments that go to one shard, and words of a shard, about.
HOT, SHARD = 150_000, 450_000
#: Windows of a segment at most; longer ranges are cut.
LONGEST = 256
#: Bytes of a word that a segment holds as it is.
LONG_WORD = 64


def anchor_ranges(hashes: np.ndarray, cuts: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """anchor, document, first and last window (in words of the document) of each range of windows with one anchor, and
    how many of its places the range holds (1, or 2 for more)."""
    none = np.zeros(0, np.int64)
    n = len(hashes)
    if n < window:
        return none.astype(np.uint64), none, none, none, none
    at = np.arange(n - GRAM + 1)
    grams = span_hashes(hashes, at, at + GRAM)
    least = grams[: n - window + 1].copy()
    for i in range(1, window - GRAM + 1):
        np.minimum(least, grams[i : n - window + 1 + i], out=least)
    twice = np.zeros(len(least), np.int8)
    for i in range(window - GRAM + 1):
        twice += grams[i : n - window + 1 + i] == least
    doc = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    start = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    if not len(start):
        return none.astype(np.uint64), none, none, none, none
    anchor, of = least[start], doc[start]
    place = start - cuts[of]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])
    begins = np.flatnonzero(fresh)
    run = np.arange(len(start)) - np.repeat(begins, np.diff(np.append(begins, len(start))))
    fresh |= run % LONGEST == 0
    begins = np.flatnonzero(fresh)
    ends = np.append(begins[1:], len(start)) - 1
    # a place is in window - GRAM + 1 windows at most
    many = np.maximum.reduceat(twice[start], begins) > 1
    many |= ends - begins > window - GRAM
    return anchor[begins], of[begins], place[begins], place[ends], 1 + many.astype(np.int32)


def ranges(texts: DataFrame, window: int) -> DataFrame:
    """anchor, t1, t2, lo, hi, times of every range of windows. texts: t1, t2, text."""
    names = ["anchor", "t1", "t2", "lo", "hi", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in text_slices(whole.column(2)):
                batch = whole.slice(a, b - a)
                raw, borders = text_bytes(batch.column(2))
                starts, ends, cuts = word_spans(raw, borders)
                anchor, of, *rest = anchor_ranges(word_hashes(raw, starts, ends), cuts, window)
                of = pa.array(of)
                keys = [pa.array(anchor.view(np.int64)), batch.column(0).take(of), batch.column(1).take(of)]
                yield pa.RecordBatch.from_arrays(keys + [pa.array(x.astype(np.int32)) for x in rest], names=names)

    return mapped(texts.select("t1", "t2", "text"), run, "anchor long, t1 long, t2 long, lo int, hi int, times int")


def _short(words: list[bytes]) -> list[bytes]:
    if all(len(w) <= LONG_WORD for w in words):
        return words
    return [w if len(w) <= LONG_WORD else b"\0" + hashlib.md5(w).hexdigest().encode() for w in words]


def segments(texts: DataFrame, found: DataFrame, shards: int, window: int) -> DataFrame:
    """shard, hot, t1, t2, ord, lo, words: the segments of each text's ranges. texts: t1, t2, ord, text; found: t1, t2, parts
    (array of anchor, lo, hi, salts)."""
    names = ["shard", "hot", "t1", "t2", "ord", "lo", "words"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def batch_of(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for t1, t2, ord_, text, parts in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4)):
                words = _short(text.as_py().encode().split())
                anchor, lo, hi, salts = (np.asarray(x) for x in parts.values.flatten())
                salt = mix64(np.full(len(lo), t1).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)) % salts.astype(np.uint64)
                shard = mix64(anchor.view(np.uint64) + salt * np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(shards)
                for s, h, a, b in zip(shard.tolist(), (salts > 1).tolist(), lo.tolist(), hi.tolist()):
                    for column, value in zip(out, (s, h, t1, t2, ord_, a, b" ".join(words[a : b + window]))):
                        column.append(value)
                if len(out[0]) >= 20_000:
                    yield batch_of(out)
                    out = [[] for _ in names]
            yield batch_of(out)

    rows = texts.join(found, ["t1", "t2"]).select("t1", "t2", "ord", "text", "parts")
    return mapped(rows, run, "shard long, hot boolean, t1 long, t2 long, ord long, lo int, words binary")


def locate(words: pa.Array, ord_: np.ndarray, lo: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a shard's segments: whether the window that begins there has an earlier one in the shard; the
    len + 1 borders of segments in words; the words' hashes."""
    import ahocorasick

    raw, borders = text_bytes(pa.array(words).cast(pa.binary()).view(pa.binary()).cast(pa.string()))
    starts, ends, cuts = word_spans(raw, borders)
    hashes = word_hashes(raw, starts, ends)
    n = len(starts)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    spaces = np.ones(len(raw), bool)
    spaces[ends[ends < len(raw)]] = raw[ends[ends < len(raw)]] != 32
    packed = raw[spaces]
    ids = np.asarray(pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(packed))]).dictionary_encode().indices).astype(np.int64)
    # three signs a word, each from a range of its own, so that nodes have few children and matches begin at words
    base = 1
    while base**3 < n + 1:
        base += 1
    signs = np.stack([ids // base**2, ids // base % base + base, ids % base + 2 * base], axis=1).astype(np.uint32) + 0x10000
    line = signs.tobytes().decode("utf-32-le")

    sizes = np.diff(cuts)
    _, chosen, counts = np.unique(span_hashes(ids.astype(np.uint64), cuts[:-1], cuts[1:]), return_index=True, return_counts=True)
    automaton = ahocorasick.Automaton()
    lengths: list[int] = []

    def add(at: int, size: int) -> None:
        automaton.add_word(line[3 * at : 3 * (at + size)], len(lengths))
        lengths.append(size)

    # the windows of all different segments, each with the segment's place among them
    many = np.maximum(sizes[chosen] - window + 1, 0)
    of = np.repeat(np.arange(len(chosen)), many)
    first = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + cuts[chosen][of]
    _, at, same, repeats = np.unique(span_hashes(ids.astype(np.uint64), first, first + window), return_index=True, return_inverse=True, return_counts=True)
    for a in first[at[repeats > 1]].tolist():
        add(a, window)
    # a segment whose windows all recur is found by them; any other has a window that no other segment has
    own = np.bincount(of, weights=repeats[same] == 1, minlength=len(chosen)) > 0
    for i in chosen[own & (counts > 1)].tolist():
        add(int(cuts[i]), int(sizes[i]))
    flags = np.zeros(n + 1, np.int64)
    if lengths:
        automaton.make_automaton()
        size = np.asarray(lengths, np.int64)
        _, rank = np.unique(ord_, return_inverse=True)
        place = (rank.astype(np.int64) << 32)[np.repeat(np.arange(len(sizes)), sizes)] + np.repeat(lo.astype(np.int64) - cuts[:-1], sizes) + np.arange(n)
        least = np.full(len(size), np.iinfo(np.int64).max)
        matches: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in _stretches(cuts, 1 << 17):  # segments are streamed a stretch at a time; none matches across their border
            hits = [(end, what) for i in range(a, b) for end, what in automaton.iter(line, 3 * int(cuts[i]), 3 * int(cuts[i + 1]))]
            if hits:
                end, what = np.array(hits, np.int64).T
                begin = (end + 1) // 3 - size[what]
                np.minimum.at(least, what, place[begin])
                matches.append((begin, what))
        for begin, what in matches:
            late = place[begin] > least[what]
            np.add.at(flags, begin[late], 1)
            np.add.at(flags, begin[late] + size[what[late]] - window + 1, -1)
    return np.cumsum(flags)[:n] > 0, cuts, hashes


def _stretches(cuts: np.ndarray, words: int) -> Iterator[tuple[int, int]]:
    a = 0
    for b in range(1, len(cuts)):
        if cuts[b] - cuts[a] >= words or b == len(cuts) - 1:
            yield a, b
            a = b


def located(parts: DataFrame, window: int) -> DataFrame:
    """t1, t2, ord, lo, hi: ranges of words to remove (h1 null); or, for step 5, a window's place (lo) and hash (h1, h2)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        t1, t2, ord_, lo = (group.column(c).to_numpy() for c in ("t1", "t2", "ord", "lo"))
        hot = np.asarray(group.column("hot").to_pylist(), bool)
        late, cuts, hashes = locate(group.column("words").chunk(0), ord_, lo, window)
        seg = np.repeat(np.arange(len(ord_)), np.diff(cuts))
        at = np.flatnonzero(late)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) > 1) | (np.diff(seg[at]) > 0)
        begin = at[fresh]
        end = at[np.append(np.flatnonzero(fresh)[1:], len(at)) - 1] if len(at) else at
        first = np.flatnonzero(hot[seg] & ~late)
        first = first[first + window <= cuts[seg[first] + 1]]
        h1 = span_hashes(hashes, first, first + window).view(np.int64)
        h2 = span_hashes(mix64(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), first, first + window).view(np.int64)
        s = np.concatenate([seg[begin], seg[first]])
        base = lo[s].astype(np.int64) - cuts[s]
        columns = [t1[s], t2[s], ord_[s], np.concatenate([begin, first]) + base, np.concatenate([end, first]) + base + window]
        out = [pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 2)]
        nothing = pa.nulls(len(begin), pa.int64())
        out += [pa.concat_arrays([nothing, pa.array(h, pa.int64())]) for h in (h1, h2)]
        return pa.table(out, names=["t1", "t2", "ord", "lo", "hi", "h1", "h2"])

    return parts.groupBy("shard").applyInArrow(run, "t1 long, t2 long, ord long, lo int, hi int, h1 long, h2 long")


def repeated_ranges(texts: DataFrame, window: int = 20) -> DataFrame:
    """t1, t2, lo, hi: the ranges of words that windows with an earlier equal cover. texts: t1, t2, ord, text, distinct."""
    spark = texts.sparkSession
    words = F.col("hi") - F.col("lo") + window
    every = Stored(ranges(texts, window))
    again = every.df.groupBy("anchor").agg(F.sum("times").alias("n"), F.sum(words).alias("words")).filter("n > 1")
    again = again.select("anchor", F.ceil(F.col("words") / HOT).cast("int").alias("salts"))
    parts = every.df.join(again, "anchor").groupBy("t1", "t2")
    found = Stored(parts.agg(F.sum(words).alias("words"), F.collect_list(F.struct("anchor", "lo", "hi", "salts")).alias("parts")))
    every.drop()
    free_shuffles(spark)
    total = found.df.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    out = Stored(located(segments(texts, found.df.drop("words"), max(1, -(-total // SHARD)), window), window))
    found.drop()
    free_shuffles(spark)
    removed = out.df.filter("h1 IS NULL").select("t1", "t2", "lo", "hi")
    open_ = out.df.filter("h1 IS NOT NULL")
    least = open_.groupBy("h1", "h2").agg(F.min(F.struct("ord", "lo")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = open_.join(least, ["h1", "h2"]).filter("first.ord < ord OR first.ord = ord AND first.lo < lo")
    return removed.unionByName(late.select("t1", "t2", "lo", "hi"))


def kept_words(texts: DataFrame, spans: DataFrame, with_text: bool) -> DataFrame:
    """t1, t2, first (its ord), n_words, n_removed, kept_sha256 (and the kept words, if asked for) of every text. spans: t1,
    t2, lo, hi."""
    names = ["t1", "t2", "first", "n_words", "n_removed", "kept_sha256"] + ["text"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, sums, texts = [], [], [], []
            for text, spans in zip(batch.column(3), batch.column(4)):
                words = text.as_py().encode().split()
                kept = words
                if spans.is_valid:
                    lo, hi = (np.asarray(x) for x in spans.values.flatten())
                    edges = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edges, lo, 1)
                    np.add.at(edges, hi, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()]
                joined = b" ".join(kept)
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                sums.append(hashlib.sha256(joined).hexdigest())
                texts.append(joined.decode() if with_text else None)
            out = [*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names=names)

    listed = spans.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    rows = texts.join(listed, ["t1", "t2"], "left").select("t1", "t2", "ord", "text", "spans")
    schema = "t1 long, t2 long, first long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return mapped(rows, run, schema)


def without_repeats(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept words, if asked for) of every row of docs."""
    rows = docs.select("doc_id", order_id().alias("ord"), *text_key())
    keyed = docs.select(order_id().alias("ord"), *text_key(), F.coalesce("text", F.lit("")).alias("text"))
    texts = Stored(keyed.groupBy("t1", "t2").agg(F.min("ord").alias("ord"), F.first("text").alias("text")), ["t1", "t2"])
    results = Stored(kept_words(texts.df, repeated_ranges(texts.df, window), with_text))
    texts.drop()
    # what a text has under its least id holds there; under any other all its windows are repeats
    copy = (F.col("ord") > F.col("first")) & (F.col("n_words") >= window)
    values = {"n_removed": F.col("n_words"), "kept_sha256": F.lit(hashlib.sha256(b"").hexdigest())} | ({"text": F.lit("")} if with_text else {})
    columns = [F.when(copy, v).otherwise(F.col(c)).alias(c) for c, v in values.items()]
    return rows.join(results.df, ["t1", "t2"]).select("doc_id", "n_words", *columns)
