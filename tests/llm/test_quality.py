"""What the line chain learns from, and the registered query's columns."""

import zlib
from pathlib import Path

import numpy as np
import pytest

from quayside.llm import quality, queries
from test_operators import table

SF = "/root/testdata/sf0.001"


def test_within():
    assert quality._within([(0, 1, 5), (1, 2, 9), (0, 3, 6), (0, 4, 5), (1, 5, 2), (1, 6, 1)], 10) == [(0, 1), (1, 2), (0, 4), (1, 6)]
    assert quality._within([], 10) == []


def test_repeated_ids_count_once(spark):
    rng = np.random.default_rng(5)
    text = lambda good: "\n".join(f"{'Nice line of words' if good else 'BUY NOW!!! $$$'} {rng.integers(9)}." for _ in range(4))
    rows = [(i, text(i % 2)) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] * 2, "doc_id long, quality int")
    plain = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = quality.train(spark.createDataFrame(rows + rows[:7] * 50, "doc_id long, text string"), labels)
    assert np.array_equal(plain.weights, many.weights) and plain.slope == many.slope
    few = quality.train(spark.createDataFrame(rows, "doc_id long, text string"), labels, lines=40)
    assert not np.array_equal(plain.weights, few.weights)


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_query(spark, tmp_path):
    got = {r["doc_id"]: r for r in table(queries.op7_quality(spark, SF))}
    docs = table(spark.read.parquet(f"{SF}/documents.parquet"))
    labels = {r["doc_id"]: r["quality"] for r in table(spark.read.parquet(f"{SF}/labels.parquet"))}
    assert set(got) == {r["doc_id"] for r in docs}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [got[i]["predicted"] == q for i, q in labels.items() if got[i]["held_out"]]
    assert held and np.mean(held) > 0.95
    # labels of held-out rows, and every other column than the text, change nothing
    from pyspark.sql import functions as F

    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    flipped = spark.read.parquet(f"{SF}/labels.parquet").withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    flipped.write.parquet(str(tmp_path / "labels.parquet"))
    again = {r["doc_id"]: r["score"] for r in table(queries.op7_quality(spark, str(tmp_path)))}
    assert again == {i: r["score"] for i, r in got.items()}
