"""Language identification against a naive Bayes by hand, and letters of all planes."""

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pyarrow as pa
import pytest

from quayside.llm import langid, queries
from test_operators import table

SF = "/root/testdata/sf0.001"


def grams(text):
    """The hashed n-grams of one text, character by character."""
    plain = [ord(c) if c.isalpha() else 32 for c in (text or "").lower()]
    out, mask = Counter(), (1 << 32) - 1
    for n in langid.ORDERS:
        for i in range(len(plain) - n + 1):
            h = n
            for c in plain[i : i + n]:
                h = ((h ^ c) * 0x9E3779B1) & mask
                h ^= h >> 15
            out[((h * 0x85EBCA6B) & mask) >> 18] += 1
    return out


def brute(learned, texts, smoothing=0.5):
    """lang_pred and score of each text, from sums of logarithms."""
    sums, docs = defaultdict(Counter), Counter()
    for text, lang in learned:
        if lang is not None:
            sums[lang].update(grams(text))
            docs[lang] += 1
    out = []
    for text in texts:
        if not docs or not any(c.isalpha() for c in (text or "").lower()):
            out.append(("und", 0.0))
            continue
        score = {}
        for lang in sorted(docs):
            total = sum(sums[lang].values()) + smoothing * langid.DIM
            score[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((sums[lang][g] + smoothing) / total) for g, n in grams(text).items())
        best = max(sorted(score), key=score.get)
        out.append((best, 1 / sum(math.exp(min(700, s - score[best])) for s in score.values())))
    return out


def same(got, want):
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(abs(g[1] - w[1]) < 1e-6 for g, w in zip(got, want))


def test_posteriors(spark):
    rng = random.Random(5)
    words = {"en": "the cat and dog house".split(), "el": "το σπίτι και η γάτα".split(), "xx": "😀 𝐚𝐛𝐜 𐐨𐐩 cat η".split(), "zh": "猫和狗在家里".split()}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randrange(1, 9))), lang) for i, lang in enumerate([*words] * 30)]
    rows += [(200, None, "en"), (201, "", "el"), (202, "cat", None), (203, "😀😀", None), (204, "𝟙𝟚 123 !?", None), (205, "𐐨", None), (206, "cat " * 30_000, None), (206, "cat " * 30_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in table(langid.predict(docs, langid.train(docs), ["doc_id", "text"]))}
    asked = [r[:2] for r in rows]
    same([got[k] for k in asked], brute([r[1:] for r in rows], [k[1] for k in asked]))
    assert got[203, "😀😀"] == got[204, "𝟙𝟚 123 !?"] == ("und", 0.0) and got[205, "𐐨"][0] == "xx"


@pytest.mark.skipif(not Path(SF).exists(), reason="no tables")
def test_query(spark):
    rows = table(spark.read.parquet(f"{SF}/documents.parquet"))
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows}
    want = brute([(r["text"], r["lang"]) for r in rows if not held[r["doc_id"]]], [r["text"] for r in rows])
    got = {r["doc_id"]: r for r in table(queries.op6_langid(spark, SF))}
    assert {i: r["held_out"] for i, r in got.items()} == held
    same([(got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) for r in rows], want)


def test_one_long_text():
    (_, x), = langid.counts(pa.array(["añb 東京 " * 50_000]))
    assert dict(zip(x.columns.tolist(), x.times.tolist())) == grams("añb 東京 " * 50_000)
