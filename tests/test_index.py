"""Lookups, paging, replay: the cases of the model's behaviour, and its traps."""

import json

from pyspark.sql import functions as F

from quayside.operators import collect, lookup, paging, replay

LOG = "seq long, op string, repo string, digest string, media_type string, tag string, refs array<string>, subject string, artifact_type string, crc long, size long"


def log(spark, *ops):
    names = LOG.replace("array<string>", "x").split(", ")
    keys = [n.split()[0] for n in names]
    return spark.createDataFrame([tuple(({"seq": i, "repo": "r"} | o).get(k) for k in keys) for i, o in enumerate(ops, 1)], LOG)


def put(digest, tag=None, refs=(), **more):
    return {"op": "put_manifest", "digest": digest, "tag": tag, "media_type": "m", "refs": list(refs)} | more


def test_tag_pages(spark):
    tags = spark.createDataFrame([(t,) for t in ("gamma", "alpha", "epsilon", "beta", "delta")], "tag string")
    page = lambda last, n=2: [(r["tag"], r["more"]) for r in paging.page(tags, "tag", last, n).orderBy("tag").collect()]
    assert page(None) == [("alpha", True), ("beta", True)]
    assert page("beta") == [("delta", True), ("epsilon", True)]
    assert page("epsilon") == [("gamma", False)]
    assert page("gamma") == [] and page("zzz") == []
    assert page("bet") == [("beta", True), ("delta", True)]  # the cursor needn't exist
    assert page(None, 0) == [] and page(None, 5)[-1] == ("gamma", False)
    assert paging.clamp(None) == 1000 and paging.clamp(5) == 5 and paging.clamp(5000) == 1000


def test_first_pages_and_cursor(spark, rows):
    tags = spark.createDataFrame([("a", t) for t in "xyz"] + [("b", "x y")], "repo string, tag string")
    pages = paging.first_pages(tags, ["repo"], "tag", 2)
    assert rows(pages) == [("a", "x", True), ("a", "y", True), ("b", "x y", False)]
    assert rows(paging.next_cursor(pages, ["repo"], "tag")) == [("a", "y")]


def test_referrers_by_type(spark, rows):
    refs = spark.createDataFrame([("r", "s", f"d{i}", t) for i, t in enumerate(["sbom"] * 3 + ["sig"] * 2)], "repo string, subject string, referrer string, artifact_type string")
    count = lambda t, limit=9: paging.referrers_page(refs, "r", "s", t, None, limit).count()
    assert (count(None), count("sbom"), count("sig"), count("none")) == (5, 3, 2, 0)
    assert [r["more"] for r in paging.referrers_page(refs, "r", "s", "sbom", None, 2).collect()] == [True, True]
    asked = spark.createDataFrame([("r", "s", "none"), ("r", "?", None), ("r", "s", None)], "repo string, subject string, artifact_type string")
    assert rows(paging.subject_status(asked, refs)) == [("r", "?", None, False, 0), ("r", "s", "none", True, 0), ("r", "s", None, True, 5)]


def test_cascade(spark, rows):
    ops = log(spark, put("m1", "v1", ["b1"], subject="s"), {"op": "put_checksum", "digest": "m1", "crc": 1, "size": 2}, {"op": "delete_manifest", "digest": "m1"})
    for f in (replay.tags, replay.manifests, replay.edges, replay.referrers, replay.checksums):
        assert rows(f(ops)) == []
    both = log(spark, put("m1", "v1"), put("m2", "v2"), {"op": "delete_manifest", "digest": "m1"})
    assert rows(replay.tags(both)) == [("r", "v2", "m2", "m")]
    shared = log(spark, put("m1", refs=["b"]), put("m2", refs=["b"]), {"op": "delete_manifest", "digest": "m1"})
    assert rows(lookup.backrefs(replay.edges(shared))) == [("r", "b", "m2")] == [("r", "b", r["manifest"]) for r in lookup.backrefs_of(replay.edges(shared), "r", "b").collect()]


def test_moved_tag_does_not_come_back(spark, rows):
    ops = log(spark, put("m1", "t"), put("m2", "t"), {"op": "delete_manifest", "digest": "m2"})
    assert rows(replay.tags(ops)) == [] and rows(replay.manifests(ops)) == [("r", "m1", "m")]
    again = log(spark, put("m1", "t", ["a"]), {"op": "delete_manifest", "digest": "m1"}, put("m1", "u", ["b"]))
    assert rows(replay.tags(again)) == [("r", "u", "m1", "m")] and rows(replay.edges(again)) == [("r", "m1", "b")]


def test_checksums_and_referrers(spark, rows):
    ops = log(spark, {"op": "put_checksum", "digest": "b", "crc": 0xDEADBEEF, "size": 42}, {"op": "put_referrer", "digest": "x", "subject": "s", "artifact_type": "t"}, {"op": "delete_manifest", "digest": "s"})
    assert rows(replay.checksums(ops)) == [("r", "b", 0xDEADBEEF, 42)]
    assert rows(replay.referrers(ops)) == [("r", "s", "x", "t")]  # deleting the subject keeps them
    assert rows(replay.checksums(ops.unionByName(log(spark, {"seq": 9, "op": "delete_blob", "digest": "b"})))) == []


def test_valid_prefix_untagged_compact(spark, rows):
    frames = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "seq long, ok boolean")
    assert rows(replay.valid_prefix(frames).select("seq")) == [(1,), (2,)]
    ops = log(spark, put("m1", "t", ["a", "a"]), put("m2"))
    image = replay.compact(replay.manifests(ops), replay.tags(ops), replay.edges(ops), replay.referrers(ops), replay.checksums(ops))
    assert sorted(r["op"] for r in image.collect()) == ["put_backrefs", "put_manifest", "put_manifest"]
    assert rows(replay.untagged(replay.manifests(ops), replay.tags(ops))) == [("r", "m2", "m")]
    assert replay.difference(replay.tags(ops), replay.tags(ops)).isEmpty()
    assert replay.needs_compaction(10, 9) and not replay.needs_compaction(10, 0)


def test_lookups(spark, rows):
    asked = spark.createDataFrame([("r", "t"), ("r", "sha256:x"), ("r", "none")], "repo string, reference string")
    tags = spark.createDataFrame([("r", "t", "sha256:d")], "repo string, tag string, digest string")
    known = spark.createDataFrame([("r", "sha256:d", "M")], "repo string, digest string, media_type string")
    got = {r["reference"]: (r["digest"], r["media_type"]) for r in lookup.resolve_references(asked, tags, known, known.limit(0)).collect()}
    assert got == {"t": ("sha256:d", "M"), "sha256:x": ("sha256:x", lookup.DEFAULT_MEDIA_TYPE), "none": (None, None)}
    marked = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:01")], "digest string, t string").select("digest", F.col("t").cast("timestamp").alias("marked_at"))
    assert [r["digest"] for r in lookup.due(marked, F.lit("2024-01-01 00:01:00").cast("timestamp"), 60).collect()] == ["a"]


def test_collection(spark, rows):
    schema = "repo string, digest string"
    blobs = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "m"), ("c", "x")], schema)
    edges = spark.createDataFrame([("a", "m", "x")], "repo string, manifest string, blob string")
    manifests = spark.createDataFrame([("a", "m")], schema)  # untagged, and a root all the same
    unsafe = spark.createDataFrame([("c",)], "repo string")
    assert rows(collect.candidates(blobs, edges, manifests, unsafe_repos=unsafe)) == [("b", "x")]
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (1, 3), (7, 8)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert rows(collect.reachable(roots, links)) == [(1, 0), (2, 1), (3, 1)]


def test_scrub_order(spark, rows):
    blobs = spark.createDataFrame([("b", "1"), ("a", "2"), ("a", "1"), ("a", "3")], "repo string, digest string")
    got = paging.scrub_order(blobs).orderBy("position").collect()
    assert [(r["repo"], r["digest"], r["position"]) for r in got] == [("a", "1", 1), ("b", "1", 2), ("a", "2", 3), ("a", "3", 4)]
    left = paging.adaptive_order(paging.scrub_order(blobs), F.lit("a"), 1).orderBy("turn", "position").collect()
    assert [(r["repo"], r["digest"]) for r in left] == [("a", "2"), ("a", "3"), ("b", "1")]


def test_rebuild(spark, rows):
    d = {k: "sha256:" + f"{i:x}" * 64 for i, k in enumerate("abcdefghij")}
    doc = lambda **f: json.dumps(f)
    one = lambda k: {"digest": d[k]}
    key = "repo string, digest string"
    indexes = spark.createDataFrame([("r", doc(manifests=[one("a"), {"digest": "none"}, 5, {"size": "x"}])), ("torn", '{"manifests":['), ("empty", "{}"), ("lost", doc(manifests=[one("j")])), ("big", doc(manifests=[one("a")])), ("bad", doc(manifests=[one("a")]))], "repo string, body string")
    bodies = [("r", d["a"], 9, doc(manifests=[one("b"), {"digest": d["c"].upper().replace("SHA256", "sha256")}], subject=one("i"))), ("r", d["b"], 9, doc(config={"digest": d["d"], "size": "ten"}, layers=[one("e"), "x", {"digest": 7}, one("e")])), ("r", d["c"], 9, doc(manifests=[one("a")], layers="none")),
              ("r", d["f"], 9, doc(layers=[one("g")])), ("torn", d["a"], 9, "{}"), ("big", d["a"], collect.MAX_MANIFEST_BYTES + 1, "{}"), ("bad", d["a"], 9, "no json"), ("r", d["h"], 9, "no json"), ("m", d["h"], 9, "5")]
    bodies = spark.createDataFrame(bodies, "repo string, digest string, size long, content string")
    recorded = spark.createDataFrame([("r", d["b"]), ("m", d["h"])], key)
    edges = spark.createDataFrame([("r", d["b"], d["d"]), ("q", d["a"], d["d"])], "repo string, manifest string, blob string")
    found = collect.rebuild_backrefs(indexes, recorded, edges, bodies)
    assert rows(found.unsafe) == [("bad",), ("big",), ("lost",), ("torn",)]
    assert [k for k, v in d.items() for r in rows(found.roots) if r == ("r", v)] == ["a", "c"]
    assert rows(found.edges) == sorted([("q", d["a"], d["d"]), ("r", d["a"], d["b"]), ("r", d["a"], d["c"]), ("r", d["a"], d["i"]), ("r", d["b"], d["d"]), ("r", d["b"], d["e"]), ("r", d["c"], d["a"])])
    blobs = spark.createDataFrame([("r", d[k]) for k in "abcdefghi"] + [("torn", d["g"])], key)
    assert rows(collect.candidates(blobs, found.edges, recorded, found.roots, found.unsafe)) == [("r", d["f"]), ("r", d["g"]), ("r", d["h"])]
    none = collect.rebuild_backrefs(indexes.limit(0), recorded.limit(0), edges.limit(0), bodies.limit(0))
    assert none.edges.isEmpty() and none.roots.isEmpty() and none.unsafe.isEmpty()


def test_marks(spark, rows):
    key = "repo string, digest string"
    now, then = F.lit("2024-01-02 00:00:00").cast("timestamp"), "2024-01-01 00:00:00"
    marked = spark.createDataFrame([("r", "a", then), ("r", "b", then)], key + ", t string").select("repo", "digest", F.col("t").cast("timestamp").alias("marked_at"))
    day = lambda df: [(r["digest"], r["marked_at"].day) for r in df.orderBy("digest").collect()]
    assert day(collect.marks(spark.createDataFrame([("r", "a"), ("r", "c"), ("r", "c")], key), marked, now)) == [("a", 1), ("c", 2)]
    assert day(collect.touch(marked, spark.createDataFrame([("r", "b"), ("r", "z"), ("q", "a")], key), now)) == [("a", 1), ("b", 2)]
    edges = spark.createDataFrame([("r", "m", "x"), ("r", "m", "y"), ("r", "n", "y"), ("q", "m", "z"), ("r", "m", "n")], "repo string, manifest string, blob string")
    manifests = spark.createDataFrame([("r", "m"), ("r", "n"), ("q", "m")], key)
    assert rows(collect.left_without(spark.createDataFrame([("r", "m"), ("r", "m")], key), edges, manifests)) == [("r", "m"), ("r", "x")]
