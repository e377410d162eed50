"""The pipeline's stages against what they must do, on the smallest tables."""

import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no tables")


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from quayside.llm import mixing, pii, quality
    from quayside.llm.common import table

    from test_operators import brute_targets, words_of
    from test_whole import brute_firsts

    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert docs.columns == columns
    raw = [r.asDict() for r in table(spark, SF, "documents").collect()]

    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"] for r in seen["quality"]}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert np.mean(right) > 0.97
    held = [(i in kept) == bool(q) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean(held) > 0.95
    assert {r["doc_id"]: r["text"] for r in seen["quality"]} == {r["doc_id"]: r["text"] for r in raw if r["doc_id"] in kept}

    assert sorted((r["doc_id"] for r in seen["near_dedup"]), key=str) == brute_firsts(seen["quality"])

    before = {r["doc_id"]: r["text"] for r in seen["near_dedup"]}
    real = {x[2:] for t in before.values() for x in pii.find(t)}
    for r in seen["pii"]:
        assert not any(x[2:] in real for x in pii.find(r["text"])) and r["n_chars"] == len(r["text"])
        if not pii.find(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]
    assert {r["doc_id"] for r in seen["pii"]} == set(before) and real

    sizes, taken = defaultdict(int), defaultdict(int)
    for r in seen["pii"]:
        sizes[r["source"]] += len(words_of(r["text"]))
    for r in seen["mixing"]:
        taken[r["source"]] += len(words_of(r["text"]))
    order = sorted(sizes)
    assert all(abs(taken[s] - t) <= 1 for s, t in zip(order, brute_targets([sizes[s] for s in order])))

    lengths = Counter()
    for r in seen["packing"]:
        lengths[r["sequence_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths.values())
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}
    assert mixing.MODULUS and quality.THRESHOLD == 0.7


def test_empty(spark, tmp_path):
    import corpus_pipeline
    from quayside.llm.common import table

    for name in ("documents", "labels"):
        table(spark, SF, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
