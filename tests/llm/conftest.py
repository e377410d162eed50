import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, ord string"


def words(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, blank and long texts, ties, copies, repeated rows, and extra columns
    whose names clash with those of results."""
    rng = random.Random(3)
    long_ = words(rng, 6000, 5000)
    shared = words(rng, 60)
    texts = [None, "", "   \n\t ", "one", "Zwei Wörter!", long_, long_, long_ + " end", shared, f"lead {shared} tail", f"{words(rng, 40)} {shared}", words(rng, 200), "a b c d e f g h " * 30, "日本語 テスト 文 。", "x" * 5000]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], len(t or ""), 1, "x", None) for i, t in enumerate(texts)]
    rows += [(40, words(rng, 50), "en", "s1", 1, 1, "x", None)] * 3  # repeated rows
    rows += [(41, "same id, one text", "en", "s1", 1, 1, "x", None), (41, "same id, another text", "en", "s2", 1, 1, "x", None)]
    rows += [(None, words(rng, 30), None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """A few hundred documents of 5 to 120 words, with copies, near copies and shared passages; ids unique."""
    rng = random.Random(11)
    base = [words(rng, rng.randrange(5, 120), 4000) for _ in range(120)]
    passage = words(rng, 45, 4000)
    texts = list(base)
    texts += [rng.choice(base) for _ in range(40)]
    for t in rng.choices(base, k=60):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [f"{words(rng, rng.randrange(30), 4000)} {passage} {words(rng, rng.randrange(30), 4000)}".strip() for _ in range(40)]
    texts += ["THE the THE the " * rng.randrange(1, 20) for _ in range(10)]
    rng.shuffle(texts)
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else "hot", len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
