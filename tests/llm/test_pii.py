"""Surrogates in every script, full ranges, and texts in which no original entity may stay."""

import random
import time
from collections import defaultdict

import pytest

from quayside.llm import permute, pii
from test_operators import KEY, table

SCRIPTS = ["Schmidt", "Петров", "Παπάς", "Պետրոսյան", "山田", "김철수", "שלום", "محمد", "शर", "ทดสอบ", "გიორგი", "Öß", "J", "Ñ", "王", "ö"]


@pytest.mark.parametrize("name", SCRIPTS)
def test_no_entity_stays(name):
    for text in (f"{name}@{name}.jp", f"Mr {name} {name}", f"Mrs. {name}", f"{name}.1@mail.com"):
        found = pii.find(text)
        new, n = pii.rewrite(text, KEY)
        assert n == len(found)
        if name != "ö" or "@" in text:  # a name doesn't begin with a small letter
            assert found
        for a, b, kind, canonical in found:
            made = pii.surrogate(kind, canonical, KEY)
            assert made != canonical and text[a:b].lower() not in new.lower().split()
            assert all({permute.alphabet(c) for c in made if c.isalpha()} <= {permute.alphabet(c) for c in canonical} for _ in [0]) or kind == "email"


def test_alphabets_dont_overlap():
    rng = random.Random(4)
    for c in [chr(rng.randrange(32, 0x2FFFF)) for _ in range(3000)]:
        own = permute.alphabet(c)
        assert c in own and len(set(own)) == len(own) or c in "ω"
        assert all(permute.alphabet(d) == own for d in own[:5])


def test_ten_scripts_in_one_corpus(spark):
    """All one-letter surnames of several alphabets, so that their shapes have no room, beside long ones and copies."""
    letters = [c for a in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмн", "αβγδεζηθικλμν", "աբգդեզէըթժ") for c in a]
    names = [c.upper() for c in letters] + [n for n in SCRIPTS if len(n) > 1] + ["王", "李", "Bo", "Li"]
    rows = [(i if i % 3 else None, f"Mr {n} wrote to {n}x@{n}.de, and Mrs {n}.") for i, n in enumerate(names)]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"] for r in table(pii.pseudonymized(docs, KEY))]
    assert len(got) == len(rows)
    real = {x[2:] for _, t in rows for x in pii.find(t)}
    now = [pii.find(t) for t in got]
    assert not real & {x[2:] for f in now for x in f}
    # distinct entities stay distinct, equal ones equal: each text has one surname twice
    made = defaultdict(set)
    for f, text in zip(now, got):
        assert text and len({x[3] for x in f if x[2] == "surname"}) == 1
    table_ = pii.assignments(pii.entities(docs), KEY).collect()
    for r in table_:
        made[r["kind"], r["surrogate"]].add(r["canonical"])
    assert all(len(v) == 1 for v in made.values()) and {(r["kind"], r["canonical"]) for r in table_} == real


def test_what_finds_no_room_is_masked(spark, monkeypatch):
    monkeypatch.setattr(pii, "ROUNDS", 2)
    monkeypatch.setattr(pii, "surrogate", lambda kind, canonical, key, attempt=0: pii.mask(kind, canonical, key) if attempt == pii.MASKED else "111223333")
    found = spark.createDataFrame([("ssn", f"12345678{i}") for i in range(4)], "kind string, canonical string")
    got = {r["canonical"]: r for r in table(pii.assignments(found, KEY))}
    assert sorted(r["attempt"] for r in got.values()) == [pii.MASKED] * 3 + [0]
    assert len({r["surrogate"] for r in got.values()}) == 4
    assert pii.dress(got["123456783"]["surrogate"], "123-45-6783", "ssn").startswith("[ssn ")


def test_ibans():
    valid = [f"DE{98 - int(f'{i:018d}131400') % 97:02d}{i:018d}" for i in range(300)]
    assert all(map(pii._checks, valid))
    made = {pii.surrogate("iban", x, KEY) for x in valid}
    assert len(made) == 300 and all(map(pii._checks, made)) and not made & set(valid)
    wrong = [f"{x[:3]}{(int(x[3]) + 1) % 10}{x[4:]}" for x in valid]
    made = {pii.surrogate("iban", x, KEY) for x in wrong}
    assert len(made) == 300 and not any(map(pii._checks, made))


def test_time_is_linear():
    def took(n):
        text = " ".join(f"user{i}@mail{i}.com" for i in range(n))
        began = time.perf_counter()
        assert len(pii.find(text)) == n
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 40 * max(took(2000), 0.01)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "Mr J met Mr K", "a", "b", "c")], "doc_id long, text string, t1 string, odd string, _own string")
    got = pii.pseudonymized(docs, KEY)
    assert got.columns == docs.columns and table(got)[0]["_own"] == "c"
    with pytest.raises(ValueError):
        pii.pseudonymized(docs, count="odd")
