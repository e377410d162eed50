"""Repeated phrases where texts, ids or words recur without end."""

import hashlib
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from quayside.llm import phrases
from test_operators import brute_phrases, table

SCHEMA = "doc_id long, text string"


def compared(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = phrases.without_repeats(docs, 20, with_text=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_phrases(table(docs), 20)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def line(rng, n):
    return " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))


def test_many_rows_without_an_id(spark):
    """Unique texts, copies of identified ones and repeated rows, all under the null id, with words of any length."""
    rng = random.Random(1)
    first = line(rng, 40)
    rows = [(1, first), (None, first), (None, None), (None, "")] + [(None, line(rng, 40)) for _ in range(300)]
    same = line(rng, 30)
    rows += [(7, same)] * 200 + [(None, same)] * 50 + [(6, f"{line(rng, 5)} {same}")]
    long_ = " ".join("x" * 100 + str(rng.randrange(3)) for _ in range(60))
    rows += [(8, long_), (9, f"a {long_} b"), (9, f"c {long_} d")]
    compared(spark, rows)


def test_copies_cost_one_text(spark):
    rng = random.Random(2)
    text = line(rng, 100)
    docs = spark.createDataFrame([(3, text)] * 200 + [(4, text)] * 200, "ord long, text string")
    kept = docs.select("ord", *phrases.text_key(), "text").groupBy("t1", "t2").agg({"ord": "min", "text": "first"}).toDF("t1", "t2", "ord", "text")
    assert phrases.repeated_ranges(kept).count() == 0
    compared(spark, [(3, text)] * 200 + [(4, text)] * 200)


@pytest.mark.parametrize("period", [1, 2, 7, 19, 23])
def test_periodic_texts(spark, monkeypatch, period):
    monkeypatch.setattr(phrases, "LONGEST", 50)
    rng = random.Random(period)
    unit = [f"p{i}" for i in range(period)]
    rows = [(rng.randrange(40), " ".join((unit * 100)[: rng.randrange(15, 90)])) for _ in range(60)]
    compared(spark, rows + [(50, "z " * 60 + " ".join(unit * 3))])


def test_periodic_segments_stay_small():
    """1,536 segments of one word, in 256 lengths: the memory of a task that takes them all."""
    code = """
import resource, numpy as np, pyarrow as pa
from quayside.llm.phrases import locate
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
sizes = [20 + i % 256 for i in range(1536)]
late, cuts, _ = locate(pa.array([b" ".join([b"a"] * n) for n in sizes], pa.binary()), np.arange(1536), np.zeros(1536, np.int64), 20)
assert late.sum() == sum(n - 19 for n in sizes) - 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(__file__).parents[2], check=True)
    assert int(out.stdout.split()[-1]) < 512
