"""Each operator on odd tables and against a brute-force version of its contract."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import cycle

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quayside.llm import audio, langid, mixing, packing, permute, phrases, pii, quality, sharding, simhash, spotsigs
from quayside.llm.common import span_hashes, text_bytes, text_slices, word_hashes, word_spans
from quayside.llm.components import components
from quayside.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def table(df):
    return [r.asDict() for r in df.collect()]


# --- common ----------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
def test_word_spans(texts):
    raw, borders = text_bytes(pa.array(texts, pa.string()))
    starts, ends, cuts = word_spans(raw, borders)
    got = [[raw[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(cuts, cuts[1:])]
    assert got == [words_of(t) for t in texts]
    hashes = word_hashes(raw, starts, ends)
    by_word = defaultdict(set)
    for h, w in zip(hashes.tolist(), [w for t in texts for w in words_of(t)]):
        by_word[w].add(h)
    assert all(len(s) == 1 for s in by_word.values()) and len({min(s) for s in by_word.values()}) == len(by_word)
    assert [x for a, b in text_slices(pa.array(texts, pa.string()), 20) for x in range(a, b)] == list(range(len(texts)))


def test_span_hashes_depend_on_content_only():
    v = np.array([5, 6, 7, 1, 5, 6, 7, 0], np.uint64)
    h = span_hashes(v, np.array([0, 4, 0, 7, 3]), np.array([3, 7, 2, 8, 3]))
    assert h[0] == h[1] and len(set(h.tolist())) == 4


def test_components(spark):
    edges = [(5, 1), (9, 5), (7, 3), (30, 29), (31, 30), (32, 31), (33, 32), (34, 33)] + [(100 + i, 100) for i in range(1, 40)]
    got = dict((r["node"], r["root"]) for r in table(components(spark.createDataFrame(edges, "u long, v long"))))
    assert got[9] == got[5] == got[1] == 1 and got[7] == 3 and all(got[i] == 29 for i in range(29, 35)) and all(got[100 + i] == 100 for i in range(40))
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 1 ---------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    weights = [w for w, _ in zip(cycle([1, 2, 3]), sizes)]
    target, full = [0.0] * len(sizes), set()
    while True:
        left = sum(sizes) - sum(3.0 * sizes[i] for i in full)
        total = sum(w for i, w in enumerate(weights) if i not in full)
        target = [3.0 * n if i in full else left * weights[i] / total for i, n in enumerate(sizes)]
        over = {i for i, n in enumerate(sizes) if i not in full and target[i] > 3 * n}
        if not over:
            return target
        full |= over


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=12))
def test_targets(sizes):
    got = mixing.share_out(sizes, [w for w, _ in zip(cycle([1, 2, 3]), sizes)], 3)
    assert got == pytest.approx(brute_targets(sizes) if sum(sizes) else [0.0] * len(sizes))


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 3000), st.integers(0, mixing.MODULUS))
def test_points(n, cut):
    assert mixing.points_below(n, cut) == sum(i * mixing.STEP % mixing.MODULUS < cut for i in range(n))


@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_mixing(spark, request, name):
    docs = request.getfixturevalue(name)
    base = mixing.sized(docs)
    got = table(mixing.taken_words(base, mixing.plan_for(base)))
    sizes = defaultdict(int)
    for r in table(docs):
        sizes[r["source"]] += len(words_of(r["text"]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, brute_targets([sizes[s] for s in order])))
    assert len(got) == docs.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in order)
    key = lambda rows: sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in rows)
    base = mixing.sized(docs.repartition(3))
    assert key(got) == key(table(mixing.taken_words(base, mixing.plan_for(base))))


def test_schedule_is_even(spark):
    plan = mixing.make_plan([("a", 4000), ("b", 4000), ("c", 4000)], (1, 2, 3), 3, 8)
    rows = sorted(table(mixing.schedule(spark, plan)), key=lambda r: r["slot"])
    assert Counter(r["source_at"] for r in rows) == dict(enumerate(plan.slots))
    seen = [0, 0, 0]
    for i, r in enumerate(rows, 1):
        assert r["rank"] == seen[r["source_at"]]
        seen[r["source_at"]] += 1
        assert all(abs(seen[s] - i * plan.slots[s] / len(rows)) < 6 for s in range(3))  # low discrepancy at every prefix


def test_mix_stage(spark, corpus, empty):
    out = mixing.mix_stage(corpus)
    assert out.columns == corpus.columns
    base = mixing.sized(corpus)
    want = Counter({r["ord"]: r["taken"] for r in table(mixing.taken_words(base, mixing.plan_for(base))) if r["taken"]})
    got = Counter()
    texts = {r["doc_id"]: r["text"] for r in table(corpus)}
    for r in table(out):
        got[r["doc_id"]] += len(words_of(r["text"]))
        assert texts[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert got == want
    assert mixing.mix_stage(empty).count() == 0
    base = mixing.sized(empty)
    assert mixing.taken_words(base, mixing.plan_for(base)).count() == 0


# --- 2 ---------------------------------------------------------------------------------------------------------------


def test_sharding(spark, odd, empty):
    got = table(sharding.shard_documents(odd, [1.0] * 40))
    texts = Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 16) for r in table(odd))
    assert Counter((r["doc_id"], r["text_crc32"], r["size"]) for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 40 and r["law"] == "key" and r["grown_shard"] in (r["shard"], 40)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty, [1.0] * 40).count() == 0


def test_shards_are_weighted_and_stable(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "cast(doc_id as string) text")
    got = table(sharding.shard_documents(ids, [1.0, 2.0, 1.0], 1.0))
    n = Counter(r["shard"] for r in got)
    assert abs(n[1] - 10_000) < 400 and abs(n[0] - 5_000) < 300
    moved = [r for r in got if r["grown_shard"] != r["shard"]]
    assert abs(len(moved) - 4_000) < 250
    again = {r["doc_id"]: r["shard"] for r in table(sharding.shard_documents(ids, [1.0, 2.0, 1.0, 1.0]))}
    assert all(again[r["doc_id"]] == (3 if r["grown_shard"] == 3 else r["shard"]) for r in got)
    with pytest.raises(ValueError):
        sharding.assign(None, [0.0])


# --- 3 ---------------------------------------------------------------------------------------------------------------


def test_audio(spark, odd, empty):
    docs = table(odd)
    got = table(audio.stored(odd, media=True, tensors=True))
    assert len(got) == len(docs) and audio.stored(empty).count() == 0
    by_text = {}
    texts = {hashlib.sha256(audio.payload_of(r["text"])[0]).hexdigest(): (r["text"] or "").encode() for r in docs}
    for r in got:
        raw = texts[r["payload_sha256"]]
        padded = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(padded) and r["tail_crc32"] == zlib.crc32(padded[-64:])
        back, rate = audio.unwav(bytes(r["media"]))
        assert back == padded and rate == audio.RATE and hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
        assert by_text.setdefault(raw, r["feature"]) == r["feature"]
        assert all(t["shape"] == [audio.PATCH, audio.MELS] and len(t["values"]) == audio.PATCH * audio.MELS for t in r["tensors"]) and r["tensors"]


def test_audio_signal():
    t = np.arange(audio.RATE * 2)
    tone = np.where((t > 8000) & (t < 20000), np.sin(2 * np.pi * 440 * t / audio.RATE) * 100, 0) + 128
    f = audio.features(tone.astype(np.uint8).tobytes(), patches=True)
    (a, b), = f.spans
    hop = audio.HOP / audio.OUT_RATE
    assert abs(a * hop - 0.5) < 0.05 and abs(b * hop - 1.25) < 0.05
    x = np.random.default_rng(0).normal(size=4000).astype(np.float32)
    direct = np.convolve(x, audio.low_pass(1, 2, 16)[0][::-1])[::2][:1500]
    assert np.allclose(audio.resample(np.concatenate([np.zeros(15, np.float32), x]), 0, 1500, 1, 2, 16), direct, atol=1e-5)
    up = audio.resample(np.concatenate([np.zeros(7, np.float32), np.ones(500, np.float32)]), 0, 600, 3, 2, 8)
    assert np.allclose(up[50:550], 1, atol=0.05)
    assert audio.tensor_batch(f.patches).type.shape == [audio.PATCH, audio.MELS] and len(audio.tensor_batch([])) == 0
    chunked, audio._CHUNK = audio._CHUNK, 800
    try:
        assert audio.features(tone.astype(np.uint8).tobytes()).digest() == f.digest()
    finally:
        audio._CHUNK = chunked
    with pytest.raises(ValueError):
        audio.unwav(b"RIFFxxxxNOPE")


# --- 4 ---------------------------------------------------------------------------------------------------------------

KEY = b"test key"


@settings(max_examples=80, deadline=None)
@given(st.integers(2, 5000), st.binary(min_size=1, max_size=8))
def test_permutation(n, key):
    image = [permute.moved(x, n, key, b"l") for x in range(min(n, 300))]
    assert len(set(image)) == len(image) and all(0 <= y < n and y != x for x, y in enumerate(image))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcXYZ019éçÄяЖβ-. ", min_size=1, max_size=20))
def test_text_keeps_its_shape(text):
    out = permute.move_text(text, KEY, b"l")
    assert [permute.shape(a) for a in out] == [permute.shape(a) for a in text]


def test_surrogates_are_distinct_and_typed():
    cards = {f"4{i:014d}{pii.luhn(f'4{i:014d}')}" for i in range(500)}
    out = {pii.surrogate("card", c, KEY) for c in cards}
    assert len(out) == 500 and all(c[0] == "4" and int(c[-1]) == pii.luhn(c[:-1]) for c in out)
    wrong = {pii.surrogate("card", f"4{i:014d}{(pii.luhn(f'4{i:014d}') + 1) % 10}", KEY) for i in range(500)}
    assert len(wrong) == 500 and not any(int(c[-1]) == pii.luhn(c[:-1]) for c in wrong)
    names = pii.FIRST_NAMES["f"]
    assert {pii.surrogate("first_f", n.lower(), KEY) for n in names} == {n.lower() for n in names}
    assert pii.surrogate("surname", "петров", KEY) != "петров" and all("а" <= c <= "ё" for c in pii.surrogate("surname", "петров", KEY))
    ips = {pii.surrogate("ip", f"10.0.{i // 256}.{i % 256}", KEY) for i in range(600)}
    assert len(ips) == 600 and all(0 <= int(x) < 256 for ip in ips for x in ip.split("."))


TEXT = "Mail Ann.Lee7@Mail.example.com or ann.lee7@mail.example.com, call +1 (017) 555-7713, card 4111 1111 1111 1111 and 9807915762804490, host 97.51.17.173, token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\". Mrs. Anna Schmidt met Mr Peter Smith; Frau Schmidt left. 123-45-6789."
CLEAN = "Released under version 3.0 of 2024-01-01, pages 10-20, 1,000,000 words, ratio 3.14159, v1.2.3, a@b, 12:30 and 555."


def test_rewrite():
    kinds = Counter(x[2] for x in pii.find(TEXT))
    assert kinds == {"email": 2, "phone": 1, "card": 2, "ip": 1, "token": 1, "first_f": 1, "first_m": 1, "surname": 3, "ssn": 1}
    out, n = pii.rewrite(TEXT, KEY)
    assert n == 13 and not any(TEXT[a:b] in out for a, b, k, _ in pii.find(TEXT))
    new = pii.find(out)
    assert [x[2] for x in new] == [x[2] for x in pii.find(TEXT)]
    emails = [x[3] for x in new if x[2] == "email"]
    assert emails[0] == emails[1]  # coreference across case
    surnames = [x[3] for x in new if x[2] == "surname"]
    assert surnames[0] == surnames[2] != surnames[1]
    assert pii.rewrite(TEXT, KEY)[0] == out != pii.rewrite(TEXT, b"other")[0]
    assert pii.rewrite(CLEAN, KEY) == (CLEAN, 0)


def test_pii(spark, odd, empty, corpus):
    got = pii.pseudonymized(odd, KEY, count="n_replaced")
    assert got.columns == [*odd.columns, "n_replaced"]
    strip = lambda df: Counter((r["doc_id"], r["text"], r["source"]) for r in table(df))
    assert strip(got) == strip(odd) and pii.pseudonymized(empty).count() == 0
    docs = spark.createDataFrame([(1, TEXT), (2, CLEAN), (3, None), (None, TEXT)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in table(pii.pseudonymized(docs, KEY))}
    assert out[1] == out[None] == pii.rewrite(TEXT, KEY)[0] and out[2] == CLEAN and out[3] is None


def test_collisions_are_resolved(spark):
    first = "123-45-6789"
    hit = pii.dress(pii.surrogate("ssn", "123456789", KEY), first, "ssn")  # the surrogate of the first is an entity too
    docs = spark.createDataFrame([(1, f"no {first}."), (2, f"no {hit}."), (3, f"both {first} {hit}")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in table(pii.pseudonymized(docs, KEY))}
    assert first not in " ".join(out.values()) and hit not in " ".join(out.values())
    a, b = out[1][3:-1], out[2][3:-1]
    assert a != b and out[3] == f"both {a} {b}"


# --- 5 ---------------------------------------------------------------------------------------------------------------


def brute_phrases(rows, window):
    """Per row: words, removed. Equal places of one id are no order."""
    first = {}
    key = lambda r: r["doc_id"] if r["doc_id"] is not None else 1 << 62
    split = [words_of(r["text"]) for r in rows]
    for r, w in zip(rows, split):
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first.get(k, (1 << 63, 0)), (key(r), s))
    out = []
    for r, w in zip(rows, split):
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (key(r), s):
                gone[s : s + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r["doc_id"], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_phrases(spark, request, monkeypatch, name, hot):
    if hot:
        monkeypatch.setattr(phrases, "HOT", 3)
        monkeypatch.setattr(phrases, "SHARD", 25)
        monkeypatch.setattr(phrases, "LONGEST", 7)
    docs = request.getfixturevalue(name)
    got = phrases.without_repeats(docs, 20, with_text=True).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_phrases(table(docs), 20)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in got)


def test_phrases_empty(empty):
    assert phrases.without_repeats(empty).count() == 0


# --- 6, 7 ------------------------------------------------------------------------------------------------------------

SAMPLES = {"en": "the cat and the dog were in the house with another friend", "de": "der Hund und die Katze waren in dem Haus mit einem Freund", "fr": "le chien et le chat étaient dans la maison avec un autre ami"}


def test_langid(spark, odd, empty):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(SAMPLES[lang].split())), lang) for i, lang in enumerate(list(SAMPLES) * 20)] + [(99, "x", None), (100, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.filter(~langid.held_out()))
    assert model.languages == sorted(SAMPLES)
    got = table(langid.predict(docs, model, ["doc_id", "lang"]))
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got if r["doc_id"] < 90)
    assert next((r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 100) == ("und", 0.0)
    held = {r["doc_id"]: r["h"] for r in table(docs.select("doc_id", langid.held_out().alias("h")))}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in held.items())
    out = table(langid.predict(odd, model, ["doc_id", "text"]))
    assert len(out) == odd.count() and all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in out)
    nothing = langid.train(empty)
    assert {r["lang_pred"] for r in table(langid.predict(odd, nothing, ["doc_id"]))} == {"und"} and langid.predict(empty, model, ["doc_id"]).count() == 0


def test_counts_are_per_document():
    texts = pa.array(["ab", None, "ab cd", "ab"])
    (_, x), = langid.counts(texts)
    rows = [dict(zip(x.columns[a:b].tolist(), x.times[a:b].tolist())) for a, b in zip(x.borders, x.borders[1:])]
    assert rows[0] == rows[3] and not rows[1] and x.has_letter.tolist() == [True, False, True, True]
    assert sum(rows[2].values()) == 5 + 4 + 3 and langid.Model([], np.zeros((0, langid.DIM)), np.zeros(0)).languages == []
    assert x.dot(np.ones(langid.DIM)).tolist() == [sum(r.values()) for r in rows]


def brute_marginals(u, m):
    """P(good) of each line of one document, by enumeration."""
    n = len(u)
    weight = np.zeros((n, 2))
    total = 0.0
    for k in range(1 << n):
        y = [k >> i & 1 for i in range(n)]
        w = np.exp(sum(u[i] * y[i] for i in range(n)) + sum(m[a, b] for a, b in zip(y, y[1:])))
        total += w
        for i in range(n):
            weight[i, y[i]] += w
    return weight[:, 1] / total, np.log(total)


def test_forward_backward():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 6]
    docs = np.concatenate([[0], np.cumsum(sizes)])
    u, m = rng.normal(size=docs[-1]) * 3, rng.normal(size=(2, 2))
    got, log_z, _ = quality.marginals(u, m, docs)
    parts = [brute_marginals(u[a:b], m) for a, b in zip(docs, docs[1:])]
    assert np.allclose(got, np.concatenate([p[0] for p in parts])) and np.isclose(log_z, sum(p[1] for p in parts))
    eps = 1e-5  # expected moves are the gradient of log Z
    for i in range(2):
        for j in range(2):
            d = np.zeros((2, 2))
            d[i, j] = eps
            slope = (quality.marginals(u, m + d, docs)[1] - quality.marginals(u, m - d, docs)[1]) / (2 * eps)
            assert np.isclose(slope, quality.marginals(u, m, docs, pairs=True)[2][i, j], atol=1e-4)


def test_line_features():
    texts = pa.array(["One line.\nONE TWO!!\n\nlast", "", None, "\n", "a a a a"])
    f, lengths, docs = quality.line_features(texts)
    assert np.diff(docs).tolist() == [4, 1, 1, 2, 1] and lengths.tolist() == [9, 9, 0, 4, 0, 0, 0, 0, 7]
    assert f.shape == (9, 3 * quality.N_OWN + 1) and f[8, 8] == 0.75 and f[1, 1] == 1.0
    assert (f[1, quality.N_OWN : 2 * quality.N_OWN] == f[0, : quality.N_OWN]).all() and not f[4, quality.N_OWN : 3 * quality.N_OWN].any()
    alone = quality.line_features(texts.slice(0, 1))[0]
    assert np.allclose(alone, f[:4])


def test_quality(spark, odd, empty):
    rng = np.random.default_rng(5)
    w = lambda n: " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(n))
    good = [f"{w(12).capitalize()}.\n{w(9).capitalize()}.\n{w(14).capitalize()}." for _ in range(80)]
    bad = [f"{w(4).capitalize()}.\n" + " ".join(f"{x.upper()}!!" for x in w(20).split()) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80), 0) for i in range(160)] + [(None, 1, 0), (500, None, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    got = table(quality.score(docs, model, ["doc_id"]))
    assert all((r["score"] >= quality.THRESHOLD) == (r["doc_id"] < 80) for r in got)
    out = table(quality.score(odd, model, ["doc_id"]))
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 for r in out) and quality.score(empty, model, ["doc_id"]).count() == 0
    assert {r["doc_id"] for r in table(quality.keep_good(docs, model))} == set(range(80))
    assert quality.keep_good(odd, model).columns == odd.columns
    blind = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in table(quality.score(odd, blind, ["doc_id"]))} == {1.0}
    shuffled = quality.train(docs.repartition(5), labels.repartition(3))
    assert np.allclose(shuffled.weights, model.weights)


# --- 8 ---------------------------------------------------------------------------------------------------------------


def brute_simhash(text):
    w = [x.encode() for x in words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, distance=4):
    fps = [brute_simhash(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                parent[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for i, r in enumerate(rows):
        ids = [x for x in (least[find(i)], r["doc_id"]) if x is not None]
        least[find(i)] = min(ids, default=None)
    return Counter((r["doc_id"], f"{f:016x}", least[find(i)]) for i, (r, f) in enumerate(zip(rows, fps)))


@pytest.mark.parametrize("dense", [4096, 2])
@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_simhash(spark, request, monkeypatch, name, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    docs = request.getfixturevalue(name)
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits().alias("f"), simhash.id_of("component").alias("c"))
    assert Counter(map(tuple, found.collect())) == brute_components(table(docs))


@pytest.mark.parametrize("dense", [4096, 3])
def test_links_lose_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(2)
    centers = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 7), replace=False)) for c in centers for _ in range(8)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), len(fps)).distinct().collect()
    assert all(((r["u"] ^ r["v"]) & (1 << 64) - 1).bit_count() <= 4 for r in edges)

    def classes(pairs):
        group = {x: {x} for x in signed}
        for a, b in pairs:
            if group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
        return {frozenset(g) for g in group.values()}

    brute = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4]
    assert classes([(r["u"], r["v"]) for r in edges]) == classes(brute)
    assert len(simhash.block_masks(10, 4)) < len(simhash.block_masks(1 << 30, 4))


def test_one_of_each(spark, odd, empty):
    kept = table(simhash.one_of_each(odd))
    rows = table(odd)
    firsts = {c for _, _, c in brute_components(rows)}
    assert Counter(r["doc_id"] for r in kept) == Counter(firsts) and set(kept[0]) == set(odd.columns)
    assert simhash.one_of_each(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# --- 9 ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("ranges", [1, 7, 1 << 16])
@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_spotsigs(spark, request, name, ranges):
    docs = request.getfixturevalue(name)
    rows = table(docs)
    hashes = {r["text"]: h["h"] for r, h in zip(rows, table(docs.selectExpr("xxhash64(coalesce(text, '')) AS h")))}
    order = sorted(rows, key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -(1 << 63)), hashes[r["text"]]))
    texts = [r["text"] or "" for r in order]
    want = []
    for i, (r, t) in enumerate(zip(order, texts)):
        after = texts[(i + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, e, n = spotsigs.signature_sets(pa.array([t, edited, after]))
        jac = lambda x, y: len({*x.tolist()} & {*y.tolist()}) / len({*x.tolist()} | {*y.tolist()}) if len(x) or len(y) else 1.0
        want.append((r["doc_id"], len(t), hashlib.sha256(edited.encode()).hexdigest(), spotsigs.digits(a), spotsigs.digits(e), round(jac(a, e), 9), round(jac(a, n), 9)))
    got = [(*r[:5], round(r[5], 9), round(r[6], 9)) for r in spotsigs.with_successors(docs, ranges=ranges).collect()]
    assert Counter(got) == Counter(want)


def test_signatures():
    sets = spotsigs.signature_sets(pa.array(["The red fox, the blue FOX.", "the red fox the blue fox", "zebra xylophone quartz", "", None, "zebra", "The red"]))
    assert sets[0].tolist() == sets[1].tolist() != [] and len(sets[0]) == 2  # the+red+fox, the+blue+fox
    assert len(sets[2]) and not len(sets[3]) and not len(sets[4]) and len(sets[5]) == 1 and len(sets[6]) == 2
    assert spotsigs.jaccard(sets[3], sets[4]) == 1.0 and spotsigs.jaccard(sets[0], sets[3]) == 0.0


@pytest.mark.parametrize("dense", [32, 2])
@pytest.mark.parametrize("name", ["odd", "corpus"])
def test_classes(spark, request, monkeypatch, tmp_path, name, dense):
    """class_id of the registered query against all pairs of sets, connected."""
    from quayside.llm import nearsets, queries

    monkeypatch.setattr(nearsets, "DENSE", dense)
    docs = request.getfixturevalue(name)
    rows = table(docs)
    sets = [set(s.tolist()) for s in spotsigs.signature_sets(pa.array([r["text"] for r in rows], pa.string()))]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r["doc_id"] if r["doc_id"] is not None else 1 << 63)
    want = Counter((r["doc_id"], r["text"] or "", min(least[find(i)]) % (1 << 63) if min(least[find(i)]) < 1 << 63 else None) for i, r in enumerate(rows))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.op9_spotsigs(spark, str(tmp_path))
    by_key = defaultdict(list)
    for r in rows:
        by_key[r["doc_id"], len(r["text"] or ""), spotsigs.digits(spotsigs.signature_sets(pa.array([r["text"] or ""]))[0])].append(r["text"] or "")
    got = Counter((r["doc_id"], by_key[r["doc_id"], r["n_chars"], r["fingerprint"]].pop(), r["class_id"]) for r in table(found))
    assert got == want and len(set(k[2] for k in want)) < len(rows)


def test_no_documents(spark, empty):
    assert spotsigs.with_successors(empty).count() == 0
    assert spotsigs.with_successors(empty, classes=spotsigs.classes(empty)).count() == 0


# --- 10 --------------------------------------------------------------------------------------------------------------


def test_tokenizer_is_exact():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    fast = packing.WordTokenizer(tokenizer_path())
    odd = ["It's we'll I'D  don't 'sx", "é É İ ΑΣ ΌΣΟΣ ﬁ", "<|endoftext|> x <|startoftext|>y <|ENDOFTEXT|>", "١٢٣ 12a3", "日本語 テスト", "\x85 a\x1cb", "", "   ", "a" * 3000, "’s ''s 's's", "x̀ ̀", "😀!! ok", None, "ªº µ÷×", "a_b __ -- a-b. x&&&", "Ünï çñ;"]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert fast.fast and [x.tolist() for x in fast.encode(pa.array(odd, pa.string()))] == want
    plain = [o for o in odd if "<|" not in (o or "")]
    assert [x.tolist() for x in fast.encode(pa.array(plain, pa.string()))] == [w for o, w in zip(odd, want) if "<|" not in (o or "")]
    small, packing.CACHED = packing.CACHED, 8
    try:
        assert [x.tolist() for x in packing.WordTokenizer(tokenizer_path()).encode(pa.array(plain, pa.string()))] == [w for o, w in zip(odd, want) if "<|" not in (o or "")]
    finally:
        packing.CACHED = small


def test_hilbert_steps_are_neighbours():
    side = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(side, 3)
    path = side[np.argsort(keys)]
    assert sorted(keys.tolist()) == list(range(512)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("length", [2048, 100])
@pytest.mark.parametrize("name", ["odd", "corpus", "empty"])
def test_packing(spark, request, name, length):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(name)
    whole = Tokenizer.from_file(tokenizer_path())
    ids = Counter()
    for r in table(docs):
        ids[(r["doc_id"], tuple([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]))] += 1
    got = table(packing.pack(docs, tokenizer_path(), length=length, with_ids=True))
    pieces = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        pieces[r["sequence_id"]].append(r)
    padding = 0
    for p in pieces.values():
        p.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in p] == np.cumsum([0, *[r["length"] for r in p]])[:-1].tolist()
        n = sum(r["length"] for r in p)
        assert n <= length
        padding += 0 if n & (n - 1) == 0 or n == length else 1
    assert padding == 0
    cut = Counter()
    for (doc, tokens), n in ids.items():
        for r in got:
            if r["doc_id"] == doc and r["doc_tokens"] == len(tokens) and tuple(r["ids"]) == tokens[r["start"] : r["start"] + r["length"]]:
                cut[(doc, tokens)] += r["length"]
    assert all(cut[k] >= n * len(k[1]) for k, n in ids.items()) and sum(r["length"] for r in got) == sum(n * len(k[1]) for k, n in ids.items())
