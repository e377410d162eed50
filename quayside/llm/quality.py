"""Document quality from a linear-chain conditional random field over lines.

Each line gets features of its own and of the lines before and after it (character classes, word lengths, words
that repeat the one, two or three before, repeated lines, place). A chain of two labels, good and bad, is fitted by
its likelihood on lines that take their document's label. Forward-backward marginals, weighted by line length, give
the document's raw score, and a logistic curve fitted on the same rows turns it into the score.

Only the fit uses labels, on at most SAMPLE documents and LINES lines a label (the least hashes of the id; a document that
has more lines than are left is passed over); lines of all documents are scored, from the text alone. The fit runs on the
driver, which holds the features of those lines, 172 bytes each.

Nulls: a null or empty text is one empty line and gets that line's score. Without labelled rows of both labels
there is nothing to tell apart: every score is 1 (or 0 if all labels are 0). Repeated rows get equal scores; rows that
share an id and a label are learned from once (the one with the least hash of its text), an id with both labels as both.
Long texts are scored whole, line by line. An empty table gives an empty result. Other columns are passed through; of
keep, a column named score is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.chars import BREAK, CRY, DIGIT, LOWER, N_CLASSES, POINT, SPACE, SYMBOL, UPPER, classes, code_points
from quayside.llm.common import Stored, mapped, span_hashes, text_slices
from quayside.llm.langid import held_out

#: Labelled documents a label that the chain is fitted on at most.
SAMPLE = 1500
#: Their lines, a label, at most.
LINES = 100_000
THRESHOLD = 0.7
N_OWN = 14


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x 3 * N_OWN + 1), line lengths in characters and the len + 1 borders of documents in lines."""
    codes, borders = code_points(texts)
    kind = classes(codes)
    n = len(codes)
    breaks = np.flatnonzero(kind == BREAK)
    # a line begins at each document's start and after each break; empty documents have a line too
    starts = np.sort(np.concatenate([borders[:-1], breaks + 1]), kind="stable")
    docs = np.searchsorted(breaks, borders) + np.arange(len(borders))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:]
    if len(ends):
        ends[-1] = n
    own_break = np.zeros(len(starts), np.int64)
    some = ends > starts
    own_break[some] = kind[ends[some] - 1] == BREAK
    lengths = ends - starts - own_break
    line_of = np.repeat(np.arange(len(starts)), ends - starts)
    by_kind = np.bincount(line_of * N_CLASSES + kind, minlength=len(starts) * N_CLASSES).reshape(len(starts), N_CLASSES).astype(np.float64)
    chars = np.maximum(lengths, 1)
    letters = by_kind[:, UPPER] + by_kind[:, LOWER]

    word = kind != SPACE
    word &= kind != BREAK
    fresh = word.copy()
    fresh[1:] &= ~word[:-1]
    cut = borders[(borders > 0) & (borders < n)]
    fresh[cut] = word[cut]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[cut - 1] = word[cut - 1]
    first, after = np.flatnonzero(fresh), np.flatnonzero(last) + 1
    of = line_of[first] if n else np.zeros(0, np.int64)
    words = np.bincount(of, minlength=len(starts)).astype(np.float64)
    h = span_hashes(codes, first, after)
    repeats = np.zeros(len(starts))
    again = np.zeros(len(h), bool)
    for lag in (1, 2, 3):
        again[lag:] |= (h[lag:] == h[:-lag]) & (of[lag:] == of[:-lag])
    repeats += np.bincount(of, weights=again, minlength=len(starts))

    doc_of = np.repeat(np.arange(len(borders) - 1), np.diff(docs))
    lines = span_hashes(codes, starts, starts + lengths) if n else np.zeros(len(starts), np.uint64)
    order = np.lexsort((lines, doc_of))
    same = np.zeros(len(starts), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        equal = (lines[a] == lines[b]) & (doc_of[a] == doc_of[b]) & (lengths[b] > 0)
        same[b] |= equal
        same[a] |= equal
    ending = np.zeros(len(starts))
    full = lengths > 0
    ending[full] = kind[starts[full] + lengths[full] - 1] == POINT
    own = np.zeros((len(starts), N_OWN))
    own[:, 0] = np.log1p(lengths) / 6
    own[:, 1] = by_kind[:, UPPER] / np.maximum(letters, 1)
    own[:, 2] = by_kind[:, DIGIT] / chars
    own[:, 3] = np.minimum(1, 5 * by_kind[:, POINT] / chars)
    own[:, 4] = np.minimum(1, 5 * by_kind[:, CRY] / chars)
    own[:, 5] = np.minimum(1, 5 * by_kind[:, SYMBOL] / chars)
    own[:, 6] = by_kind[:, SPACE] / chars
    own[:, 7] = np.minimum(2, letters / np.maximum(words, 1) / 8)
    own[:, 8] = repeats / np.maximum(words, 1)
    own[:, 9] = same
    own[:, 10] = ending
    own[:, 11] = words < 4
    own[docs[:-1], 12] = 1
    own[docs[1:] - 1, 13] = 1
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[docs[:-1]] = 0
    behind[:-1] = own[1:]
    behind[docs[1:] - 1] = 0
    return np.hstack([own, before, behind, np.ones((len(starts), 1))]), lengths.astype(np.float64), docs


def marginals(unary: np.ndarray, moves: np.ndarray, docs: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, float, np.ndarray]:
    """P(good) of each line, the log of all documents' partition sums and, if asked for, the expected moves (2 x 2).

    unary: each line's score for good (bad has 0); moves: scores of (label, next label). All documents go forward and
    backward together, line by line, with the scaled recursions."""
    sizes = np.diff(docs)
    order = np.argsort(-sizes, kind="stable")
    first, sizes = docs[:-1][order], sizes[order]
    top = np.maximum(unary, 0)
    emit = np.exp(np.stack([-top, unary - top], axis=1))
    step = np.exp(moves)
    forward, scale = np.empty_like(emit), np.empty(len(unary))
    longest = int(sizes[0]) if len(sizes) else 0
    open_ = np.searchsorted(-sizes, -np.arange(longest), side="left")  # documents with more than t lines
    for t in range(longest):
        at = first[: open_[t]] + t
        p = emit[at] * (forward[at - 1] @ step if t else 1.0)
        scale[at] = p.sum(axis=1)
        forward[at] = p / scale[at][:, None]
    backward, expected = np.ones_like(emit), np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: open_[t + 1]] + t
        ahead = emit[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        if pairs:
            expected += np.einsum("ni,ij,nj->ij", forward[at], step, ahead)
        backward[at] = ahead @ step.T
    both = forward * backward
    return both[:, 1] / both.sum(axis=1), float(np.log(scale).sum() + top.sum()), expected


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float
    constant: float | None = None


def _raw(good: np.ndarray, lengths: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Length-weighted means of the lines' marginals; where all lines are empty, plain means."""
    weight = np.add.reduceat(lengths, docs[:-1]) if len(docs) > 1 else np.zeros(0)
    lengths = np.where(np.repeat(weight == 0, np.diff(docs)), 1.0, lengths)
    return np.add.reduceat(good * lengths, docs[:-1]) / np.add.reduceat(lengths, docs[:-1]) if len(docs) > 1 else weight


def fit(features: np.ndarray, lengths: np.ndarray, docs: np.ndarray, labels: np.ndarray, steps: int = 250, decay: float = 1e-3) -> Model:
    """Adam on the chain's mean log-likelihood a line, then on the logistic curve's."""
    of_line = np.repeat(labels, np.diff(docs)).astype(np.float64)
    inner = np.ones(len(of_line), bool)
    inner[docs[1:] - 1] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (of_line[at].astype(int), of_line[at + 1].astype(int)), 1)

    def adam(x: np.ndarray, gradient, rate: float, steps: int) -> np.ndarray:
        m, v = np.zeros_like(x), np.zeros_like(x)
        for i in range(1, steps + 1):
            g = gradient(x)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            x = x - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        return x

    d = features.shape[1]

    def chain(x: np.ndarray) -> np.ndarray:
        w, moves = x[:d], x[d:].reshape(2, 2)
        good, _, expected = marginals(features @ w, moves, docs, pairs=True)
        return np.concatenate([features.T @ (good - of_line), (expected - seen).ravel()]) / len(of_line) + decay * x

    x = adam(np.zeros(d + 4), chain, 0.1, steps)
    weights, moves = x[:d], x[d:].reshape(2, 2)
    raw = _raw(marginals(features @ weights, moves, docs)[0], lengths, docs)
    # both labels weigh the same, and what lies at THRESHOLD is as likely one as the other
    weight = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    prior = np.log(THRESHOLD / (1 - THRESHOLD))

    def curve(x: np.ndarray) -> np.ndarray:
        gap = weight * (1 / (1 + np.exp(-(x[0] * raw + x[1]))) - labels)
        return np.array([(gap * raw).sum(), gap.sum()]) + 1e-4 * x

    slope, shift = adam(np.array([1.0, 0.0]), curve, 0.2, 600)
    return Model(weights, moves, float(slope), float(shift + prior))


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    out = []
    for a, b in text_slices(texts):
        features, lengths, docs = line_features(texts.slice(a, b - a))
        raw = _raw(marginals(features @ model.weights, model.moves, docs)[0], lengths, docs)
        out.append(1 / (1 + np.exp(-(model.slope * raw + model.shift))))
    return np.concatenate(out) if out else np.zeros(0)


def _within(sizes: list[tuple[int, int, int]], most: int) -> list[tuple[int, int]]:
    """sizes: label, id, lines, in the order of choice. The (label, id) that fit into most lines a label."""
    left: dict[int, int] = {}
    out = []
    for label, id_, n in sizes:
        if n <= left.setdefault(label, most):
            left[label] -= n
            out.append((label, id_))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = LINES) -> Model:
    """labels: doc_id, quality; rows of a held-out id, without an id or without a 0/1 label are never read from."""
    usable = labels.filter(F.col("doc_id").isNotNull() & ~held_out() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label"))
    pick = lambda label: usable.filter(F.col("label") == label).distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    mine = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    chosen = mine.join(F.broadcast(pick(0).unionByName(pick(1))), "id")
    one = chosen.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x")).select("x.text", "label", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, lengths, borders = line_features(batch.column(0))
            raw = [features[a:b].astype(np.float32).tobytes() for a, b in zip(borders, borders[1:])]
            sizes = [lengths[a:b].tobytes() for a, b in zip(borders, borders[1:])]
            columns = [batch.column(1), batch.column(2), pa.array(np.diff(borders), pa.int64()), pa.array(raw, pa.binary()), pa.array(sizes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["label", "id", "n", "features", "lengths"])

    kept = Stored(mapped(one, run, "label int, id long, n long, features binary, lengths binary"))
    sizes = [tuple(r) for r in kept.df.orderBy(F.xxhash64("id"), "id").select("label", "id", "n").collect()]
    fitting = docs.sparkSession.createDataFrame(_within(sizes, lines), "label int, id long")
    rows = kept.df.join(F.broadcast(fitting), ["label", "id"]).select("label", "features", "lengths").collect()
    kept.drop()
    rows.sort(key=lambda r: (r["label"], bytes(r["features"])))
    y = np.array([r["label"] for r in rows], np.int64)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(0), np.zeros((2, 2)), 0.0, 0.0, float(y[0]) if len(y) else 1.0)
    features = np.vstack([np.frombuffer(r["features"], np.float32).reshape(-1, 3 * N_OWN + 1) for r in rows]).astype(np.float64)
    lengths = [np.frombuffer(r["lengths"], np.float64) for r in rows]
    return fit(features, np.concatenate(lengths), np.concatenate([[0], np.cumsum([len(x) for x in lengths])]), y)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep of docs and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score_texts(batch.column(batch.num_columns - 1), model))], names=[*keep, "score"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return mapped(rows, run, f"{schema}, score double")


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score under threshold; the texts go through the scoring, so nothing is joined or shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = score_texts(batch.column(batch.schema.get_field_index("text")), model) >= threshold
            yield batch.filter(pa.array(good))

    return mapped(docs, run, docs.schema)
