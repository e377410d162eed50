"""The write path, snapshots and two-level ordered computations."""

import hashlib
import random

from pyspark.sql import functions as F

from quayside.operators import ingest, layout, lookup, ordered, replay
from quayside.sources import stamp


def sha(b):
    return "sha256:" + hashlib.sha256(b).hexdigest()


def test_uploads(spark, rows):
    u = [("r", 1, sha(b"aaaa"), b"aaaa"), ("r", 2, sha(b"x"), b"bbbb"), ("r", 3, "md5:1", b"c"), ("r", 4, sha(b"dddd"), b"dddd"), ("r", 5, sha(b"e" * 9), b"e" * 9), ("r", 6, sha(b"ff"), b"ff")]
    out = ingest.put_blobs(spark.createDataFrame(u, "repo string, seq long, digest string, content binary"), 8, 7)
    assert {r["seq"]: r["verdict"] for r in out.collect()} == {1: "accepted", 2: "mismatch", 3: "invalid digest", 4: "over quota", 5: "too large", 6: "accepted"}
    made = ingest.blob_records(out.filter("verdict = 'accepted'"))
    assert made.columns == ingest.COLUMNS and {r["size"] for r in replay.checksums(made).collect()} == {4, 2}


def test_manifests(spark, rows):
    blob, media = sha(b"layer"), "application/vnd.oci.image.manifest.v1+json"
    body = '{"mediaType":"%s","config":{"digest":"%s"},"subject":{"digest":"%s"}}' % (media, blob, sha(b"s"))
    deep = "[" * 33 + "]" * 33
    m = [("r", 1, sha(b"1"), "v1", media + "; charset=utf-8", body), ("q", 2, sha(b"2"), None, media, body), ("r", 3, sha(b"3"), None, "other/type", body), ("r", 4, sha(b"4"), "v4", media, "no json"), ("r", 5, sha(b"5"), None, media, deep)]
    out = ingest.put_manifests(spark.createDataFrame(m, "repo string, seq long, digest string, tag string, content_type string, body string"), spark.createDataFrame([("r", blob)], "repo string, digest string"))
    assert {r["seq"]: r["verdict"] for r in out.collect()} == {1: "accepted", 2: "blob unknown", 3: "invalid", 4: "accepted", 5: "too deep"}
    log = ingest.manifest_records(out.filter("verdict = 'accepted'"))
    assert rows(replay.tags(log).select("tag")) == [("v1",), ("v4",)]
    assert rows(lookup.backrefs(replay.edges(log)).select("blob")) == sorted([(blob,), (sha(b"s"),)])  # the subject is a reference too
    gone = ingest.delete_manifests(spark.createDataFrame([("r", 9, sha(b"1"))], "repo string, seq long, digest string"))
    assert rows(replay.tags(log.unionByName(gone)).select("tag")) == [("v4",)]
    asked = spark.createDataFrame([("a", "b", "d", True), ("a", "c", "d", False)], "source string, target string, digest string, ok boolean")
    assert rows(ingest.mount(asked)) == [("b", "d")]


def test_warm_referrers(spark, rows):
    a, c = sha(b"a"), sha(b"c")
    index = spark.createDataFrame([("r", '{"manifests":[{"digest":"%s","artifactType":"x","subject":{"digest":"%s"}}]}' % (c, a))], "repo string, body string")
    have = "repo string, subject string, referrer string"
    assert rows(layout.warm_referrers(index, spark.createDataFrame([], have))) == [("r", a, c, "x")]
    assert rows(layout.warm_referrers(index, spark.createDataFrame([("r", a, c)], have))) == []


def test_stamp(spark, tmp_path):
    now = stamp.Stamp("h", 3, 100)
    path = str(tmp_path / "s")
    assert stamp.read(spark, path, now) is None
    stamp.write({"tags": spark.range(3)}, now, path)
    assert stamp.read(spark, path, now)["tags"].count() == 3
    assert stamp.read(spark, path, now) is None  # used once
    stamp.write({"tags": spark.range(3)}, now, path)
    assert stamp.read(spark, path, stamp.Stamp("h", 4, 100)) is None


def test_two_levels(spark):
    rng = random.Random(1)
    data = [(g, i, rng.choice([-3, 0, 1, 7, 7, 1000])) for g in ("a", "b", None) for i in range(200)] + [("one", 5, 9)]
    df = spark.createDataFrame(data, "g string, t long, v long")
    for buckets in (1, 5, 4096):
        got = {(r["g"], r["t"]): r["s"] for r in ordered.running_sum(df.filter("g IS NOT NULL"), ["g"], "t", "v", "s", buckets).collect()}
        for g in ("a", "b", "one"):
            total = 0
            for _, t, v in sorted(x for x in data if x[0] == g):
                total += v
                assert got[(g, t)] == total
        places = {"low": F.lit(0), "mid": F.floor(F.col("n") / 2), "top": F.col("n") - 1}
        out = {r["g"]: (r["low"], r["mid"], r["top"]) for r in ordered.at_places(df.filter("g IS NOT NULL"), ["g"], "v", places, buckets).collect()}
        for g in ("a", "b", "one"):
            v = sorted(x[2] for x in data if x[0] == g)
            assert out[g] == (v[0], v[len(v) // 2], v[-1])


def test_two_level_folds(spark):
    rng = random.Random(2)
    data = [(g, t, rng.choice([-1, -1, 1, 1, 1]), rng.randrange(50)) for g in ("a", None) for t in [*range(150), 10**9]] + [("one", 5, -1, 3)]
    df = spark.createDataFrame(data, "g string, t long, d int, raw long")
    for buckets in (1, 3, 4096):
        floor = {(r["g"], r["t"]): r["o"] for r in ordered.running_floor(df, ["g"], "t", "d", "o", buckets).collect()}
        total = {(r["g"], r["t"]): r["o"] for r in ordered.without_resets(df, ["g"], "t", "raw", "o", buckets).collect()}
        place = {(r["g"], r["t"]): r["o"] for r in ordered.numbered(df, ["g"], "t", "o", buckets).collect()}
        for g in ("a", None, "one"):
            active, lost, before = 0, 0, None
            for i, (_, t, d, raw) in enumerate(sorted((x for x in data if x[0] == g), key=lambda x: x[1]), 1):
                active = max(0, active + d)
                lost += before if before is not None and raw < before else 0
                before = raw
                assert (floor[(g, t)], total[(g, t)], place[(g, t)]) == (active, raw + lost, i)
    assert ordered.numbered(df.limit(0), ["g"], "t", "o").isEmpty()


def test_even_ranges(spark):
    spread = spark.range(20_000).select(F.lit("g").alias("g"), F.when(F.col("id") == 0, 10**15).otherwise(F.col("id")).alias("v"))
    sizes = [r["count"] for r in ordered.placed(spread, ["g"], "v").groupBy("_bucket").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 8_000  # one outlier crowds nothing


def test_malformed_manifests(spark):
    good, media = sha(b"layer"), "application/vnd.oci.image.manifest.v1+json"
    bodies = ['{"config":{"digest":"none"}}', '{"config":null}', '{"config":{}}', '{"layers":"x"}', '{"layers":[{"digest":"%s"},5]}' % good, '{"mediaType":5}', '{"layers":[]}', '{"config":{"digest":"%s"},"layers":[{"digest":"%s","size":"x"}]}' % (good, good), "{}", "5"]
    m = spark.createDataFrame([("r", i, sha(b"%d" % i), None, media, b) for i, b in enumerate(bodies)], "repo string, seq long, digest string, tag string, content_type string, body string")
    out = ingest.put_manifests(m, spark.createDataFrame([("r", good)], "repo string, digest string"))
    assert [r["verdict"] for r in out.orderBy("seq").collect()] == ["invalid"] * 6 + ["accepted"] * 4
    asked = [("latest", "{}"), (sha(b"{}"), "{}"), (sha(b"x"), "{}"), ("md5:1", "{}"), ("sha512:" + hashlib.sha512(b"{}").hexdigest(), "{}")]
    out = ingest.named(spark.createDataFrame(asked, "reference string, body string")).collect()
    assert [(r["digest"] == sha(b"{}"), r["tag"], r["matches"]) for r in out] == [(True, "latest", True), (True, None, True), (False, None, False), (False, None, False), (False, None, True)]


def test_presence(spark):
    key = "repo string, digest string"
    marks = lookup.presence_filter(spark.createDataFrame([("r", "a"), ("r", "a"), ("s", "b")], key))
    asked = spark.createDataFrame([("r", "a"), ("s", "a"), (None, "b"), ("s", "b")], key)
    said = lambda cap: sorted((str(r["repo"]), r["digest"], r["maybe"]) for r in lookup.maybe_present(asked, marks, cap).collect())
    assert marks.count() == 2
    assert said(2) == [("None", "b", False), ("r", "a", True), ("s", "a", False), ("s", "b", True)]
    assert all(m for _, _, m in said(1))  # over its capacity it excludes nothing
    assert not any(r["maybe"] for r in lookup.maybe_present(asked, marks.limit(0), 2).collect())
