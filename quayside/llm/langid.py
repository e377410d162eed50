"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lowered, everything but letters (of any plane) counts as a space, and n-grams of one to three characters are
hashed into DIM counters. A batch's counts are a sparse matrix in compressed rows: for each text the counters that it has
and how often. Training adds whole numbers, one vector a language in every task, then in two steps; the log-probabilities
(languages x DIM floats) are broadcast, and a text's score in a language is the sum of its counts times that row's entries.

Nulls: a text that is null or without a letter is `und` with score 0, as are all where nothing could be learned.
Rows without a language aren't learned from. Repeated rows count again. Equal scores go to the first language by
code point. A long text is a batch of its own; it has DIM counters at most. An empty table gives an empty result. Other
columns are passed through if they are named in keep; a clash with lang_pred or score is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.chars import code_points, letters
from quayside.llm.common import mapped, text_slices

DIM = 1 << 14
ORDERS = (1, 2, 3)
#: Languages at most; the broadcast matrix has a row for each.
MAX_LANGUAGES = 1000
_FOLD = 512


def held_out(col: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4, is 2; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Counts:
    """Rows of counters: row i has times[borders[i] : borders[i + 1]] in the columns at the same places."""

    columns: np.ndarray
    times: np.ndarray
    borders: np.ndarray
    has_letter: np.ndarray

    def dot(self, vector: np.ndarray) -> np.ndarray:
        """The product with a vector of DIM entries; rows without counters have 0."""
        out = np.zeros(len(self.borders) - 1)
        some = self.borders[1:] > self.borders[:-1]
        if some.any():
            out[some] = np.add.reduceat(vector[self.columns] * self.times, self.borders[:-1][some])
        return out


def counts(texts: pa.Array) -> Iterator[tuple[int, Counts]]:
    """First row and counts of the texts, in batches of rows."""
    for a, b in text_slices(texts):
        codes, borders = code_points(texts.slice(a, b - a), lower=True)
        is_letter = letters(codes)
        plain = np.where(is_letter, codes, 32).astype(np.uint32)
        hashed = []
        for n in ORDERS:
            h = np.full(max(0, len(plain) - n + 1), n, np.uint32)
            for i in range(n):
                h = (h ^ plain[i : len(plain) - n + 1 + i]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            hashed.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14)).astype(np.int64))
        seen = np.concatenate([[0], np.cumsum(is_letter)])
        columns, times, ends = [], [], [0]
        for first, last in zip(borders[:-1].tolist(), borders[1:].tolist()):
            grams = [h[first : last - n + 1] for n, h in zip(ORDERS, hashed) if last - first >= n]
            if grams:
                own = np.bincount(np.concatenate(grams), minlength=DIM)
                at = np.flatnonzero(own)
                columns.append(at)
                times.append(own[at])
            ends.append(ends[-1] + (len(at) if grams else 0))
        none = [np.zeros(0, np.int64)]
        yield a, Counts(np.concatenate(columns or none), np.concatenate(times or none), np.array(ends), seen[borders[1:]] > seen[borders[:-1]])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_probs: np.ndarray  # languages x DIM
    priors: np.ndarray


def train(rows: DataFrame, smoothing: float = 0.5) -> Model:
    """rows: text, lang; all of them are learned from."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs = np.asarray(batch.column(1).to_pylist(), dtype=object)
            for at, x in counts(batch.column(0)):
                here = langs[at : at + len(x.has_letter)]
                of = np.repeat(np.arange(len(here)), np.diff(x.borders))
                for lang in set(here.tolist()):
                    own = here == lang
                    mine = own[of]
                    total = sums.setdefault(lang, np.zeros(DIM, np.int64))
                    np.add.at(total, x.columns[mine], x.times[mine])
                    docs[lang] = docs.get(lang, 0) + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["lang", "docs", "sums"])

    def fold(table: pa.Table) -> pa.Table:
        total = np.zeros(DIM, np.int64)
        for raw in table.column("sums").to_pylist():
            total += np.frombuffer(raw, np.int64)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "docs": [int(np.sum(table.column("docs").to_numpy()))], "sums": [total.tobytes()]})

    schema = "lang string, docs long, sums binary"
    parts = mapped(rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL"), add, schema)
    parts = parts.withColumn("part", F.spark_partition_id() % _FOLD).groupBy("lang", "part").applyInArrow(fold, schema)
    found = sorted(parts.groupBy("lang").applyInArrow(fold, schema).limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"])
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    sums = np.array([np.frombuffer(r["sums"], np.int64) for r in found], np.float64).reshape(len(found), DIM) + smoothing
    docs = np.array([r["docs"] for r in found], np.float64)
    return Model([r["lang"] for r in found], np.log(sums / sums.sum(axis=1, keepdims=True)), np.log(docs / docs.sum()) if len(docs) else docs)


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns keep, lang_pred and score, the posterior of the predicted language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, "und"], dtype=object)
        for batch in batches:
            best, score = [], []
            for _, x in counts(batch.column(batch.num_columns - 1)):
                if not model.languages:
                    best += [0] * len(x.has_letter)
                    score += [0.0] * len(x.has_letter)
                    continue
                total = np.stack([x.dot(row) for row in model.log_probs], axis=1) + model.priors
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                top = total.argmax(axis=1)
                best += np.where(x.has_letter, top, len(model.languages)).tolist()
                score += np.where(x.has_letter, 1 / odds.sum(axis=1), 0.0).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names[best].tolist() if best else [], pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return mapped(rows, run, f"{schema}, lang_pred string, score double")
