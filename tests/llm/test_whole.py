"""The whole job of operators that once did less."""

from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quayside.llm import audio, nearsets, pii
from quayside.llm.common import store

SF = "/root/testdata/sf0.001"


def brute_firsts(rows):
    """The ids that stay: five-word shingles, Jaccard similarity 0.8 or more, connected."""
    sets = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r["doc_id"])
    return sorted((min((x for x in ids if x is not None), default=None) for ids in least.values()), key=str)


@pytest.mark.parametrize("dense,common", [(32, 8), (2, 1)])
@pytest.mark.parametrize("name", ["odd", "corpus", "tables"])
def test_near_dedup_stage(spark, request, monkeypatch, name, dense, common):
    import corpus_pipeline

    if name == "tables" and not Path(SF).exists():
        pytest.skip("no tables")
    monkeypatch.setattr(nearsets, "DENSE", dense)
    monkeypatch.setattr(nearsets, "COMMON", common)
    docs = spark.read.parquet(f"{SF}/documents.parquet") if name == "tables" else request.getfixturevalue(name)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == brute_firsts([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("text,kind", [("at 96.153.118.61 now", "ip"), ("at 7.153.118.610 or 10.200.118.255.", "ip"), ("at 196.153.118.161, so", "ip"), ("card 4111-1111-1111-1111 paid", "card"), ("card 4111-1111 1111 1111 paid", "card")])
def test_whole_entities(text, kind):
    assert kind in [x[2] for x in pii.find(text)]
    whole = next(x for x in pii.find(text) if x[2] == kind)
    new, _ = pii.rewrite(text, pii.DEFAULT_KEY)
    assert text[whole[0] : whole[1]] not in new
    if kind == "card":
        out = pii.find(new)[0]
        assert out[2] == "card" and pii.luhn(out[3][:-1]) == int(out[3][-1]) and out[3][4:] != whole[3][4:]


def test_neighbours_stay_apart():
    assert [x[2] for x in pii.find("call 555-123-4567 123-45-6789")] == ["phone", "ssn"]
    assert [x[2] for x in pii.find("call 1-555-123-4567.")] == ["phone"]


def test_audio_query_stores_tensors(spark, odd, empty, monkeypatch, tmp_path):
    from quayside.llm import queries

    made = []
    monkeypatch.setattr(queries, "store", lambda df: made.append(store(df)) or made[-1])
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op3_audio(spark, str(tmp_path))
    plain = audio.stored(odd)
    assert sorted(map(str, got.drop("n_segments").collect())) == sorted(map(str, plain.drop("segments").collect()))
    patches = 0
    for r in made[0].collect():
        kept = pa.ipc.open_stream(bytes(r["tensors"])).read_all()
        kind = kept.schema.field("tensor").type
        assert isinstance(kind, pa.FixedShapeTensorType) and list(kind.shape) == [audio.PATCH, audio.MELS]
        patches += kept.num_rows
    assert patches == sum(len(r["tensors"]) for r in audio.stored(odd, tensors=True).collect())
    assert audio.read_back(audio.files(empty)).count() == 0


def brute_fingerprint(text):
    """SimHash of the distinct five-word shingles."""
    w = (text or "").encode().lower().split()
    h = {xxhash.xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))} if w else set()
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_dedup_stage_is_by_simhash(spark, corpus, monkeypatch):
    import corpus_pipeline
    from quayside.llm import simhash

    given, links, pairs = [], simhash.links, nearsets._pairs
    monkeypatch.setattr(simhash, "links", lambda fps, n, distance=4: given.append((fps, distance)) or links(fps, n, distance))
    monkeypatch.setattr(nearsets, "_pairs", lambda groups, stars: pairs(groups, stars).limit(0))  # what keys add is left out
    texts = {r["doc_id"]: r["text"] for r in corpus.collect()}
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, corpus, SF).collect()}
    (fps, distance), = given
    fp = {i: brute_fingerprint(t) for i, t in texts.items()}
    assert {r["fp"] & (1 << 64) - 1 for r in fps.collect()} == set(fp.values())
    firsts = set(brute_firsts([r.asDict() for r in corpus.collect()]))
    assert firsts <= kept
    # most of what is alike but not equal is found by fingerprints alone, and nothing that isn't
    equal = {min(i for i in fp if fp[i] == x) for x in set(fp.values())}
    assert len(kept - firsts) < 0.5 * len(equal - firsts)
    # of two texts that are alike and whose fingerprints are near, with no third one in reach, one goes
    near = {i: [j for j in fp if j != i and (fp[i] ^ fp[j]).bit_count() <= distance] for i in fp}
    lone = [(i, js[0]) for i, js in near.items() if len(js) == 1 and near[js[0]] == [i] and len(brute_firsts([{"doc_id": x, "text": texts[x]} for x in (i, js[0])])) == 1]
    assert lone and not any({i, j} <= kept for i, j in lone)


@pytest.mark.parametrize("wide", [1 << 14, 3])
def test_wide_links_lose_nothing(spark, monkeypatch, wide):
    from quayside.llm import simhash

    monkeypatch.setattr(simhash, "WIDE", wide)
    rng = np.random.default_rng(3)
    centers = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = sorted({int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 15), replace=False)) for c in centers for _ in range(8)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps), 10).distinct().collect()
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 10 for r in edges)

    def roots(links):
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in signed}

    brute = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 10]
    assert roots((r["u"], r["v"]) for r in edges) == roots(brute)
    for n in (10, 1 << 18, 1 << 24):
        masks = simhash.block_masks(n, 10)
        assert all(any(not x & m for m in masks) for x in (sum(1 << int(b) for b in rng.choice(64, 10, replace=False)) for _ in range(50)))
