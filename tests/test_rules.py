"""Routing, accounting, policy, traffic, scalars, telemetry."""

import pytest
from pyspark.sql import functions as F

from quayside.functions import digests, globs, headers, paths
from quayside.operators import accounting, benchstats, integrity, layout, policy, routing, telemetry, traffic


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_routes(spark, rows):
    names = spark.createDataFrame([("a/b/c",), ("ab",), ("a",), ("x",)], "repo string")
    routes = spark.createDataFrame([("a", "1"), ("a/b", "2"), ("a/b/cd", "3")], "prefix string, backend string")
    assert rows(routing.longest_prefix(names, routes)) == [("a", "1"), ("a/b/c", "2"), ("ab", "default"), ("x", "default")]


def test_dedupe(spark, rows):
    writes = spark.createDataFrame([("d", "b", 2, 5), ("d", "a", 3, 5), ("e", "a", 1, 7), ("d", "b", 9, 5)], "digest string, repo string, seq long, size long")
    assert rows(routing.canonical(writes)) == [("d", "b"), ("e", "a")]
    assert rows(routing.locate(writes).select("repo", "digest", "canonical")) == [("a", "d", "b")]
    assert rows(routing.savings(writes)) == [(17, 12)]
    files = spark.createDataFrame([("a", "d", 1, 1), ("b", "d", 1, 1), ("c", "d", 1, 2)], "repo string, digest string, device int, inode int")
    assert rows(routing.linked_copies(files)) == [("a", "d", ["b"]), ("b", "d", ["a"])]


def test_quota(spark, rows):
    writes = spark.createDataFrame([("r", 1, 60), ("r", 2, 50), ("r", 3, 40), ("r", 4, 1), ("s", 1, 100)], "repo string, seq long, size long")
    got = {(r["repo"], r["seq"]): (r["admitted"], r["used"]) for r in accounting.admission(writes, 100).collect()}
    assert got == {("r", 1): (True, 60), ("r", 2): (False, 60), ("r", 3): (True, 100), ("r", 4): (False, 100), ("s", 1): (True, 100)}
    assert all(r["admitted"] for r in accounting.admission(writes, 0).collect())
    used = spark.createDataFrame([("r", 10), ("s", 5)], "repo string, bytes long")
    freed = spark.createDataFrame([("r", 4), ("s", 9), ("t", 1)], "repo string, size long")
    assert rows(accounting.release(used, freed)) == [("r", 6)]
    assert (None, 251) in rows(accounting.usage(writes)) and ("r", 151) in rows(accounting.usage(writes))
    events = spark.createDataFrame([("r", i, d) for i, d in enumerate([-1, 1, 1, -1, -1, -1, 1])], "repo string, seq long, delta int")
    assert [r["active"] for r in accounting.sessions(events).orderBy("seq").collect()] == [0, 1, 2, 1, 0, 0, 1]
    capped = accounting.admitted_sessions(events.select("seq", "delta"), 1).orderBy("seq").collect()
    assert [(r["admitted"], r["active"]) for r in capped] == [(True, 0), (True, 1), (False, 1), (True, 0), (True, 0), (True, 0), (True, 1)]
    both = spark.createDataFrame([("r", 1, 60), ("r", 2, 50), ("s", 3, 50), ("s", 4, 40), ("r", 5, 5)], "repo string, seq long, size long")
    verdicts = lambda r, t: [x["refused_by"] for x in accounting.capped_admission(both, r, t).orderBy("seq").collect()]
    assert verdicts(100, 105) == [None, "repository", "total", None, None] and verdicts(0, 0) == [None] * 5
    assert verdicts(100, 1000) == [None, "repository", None, None, None] and verdicts(0, 100) == [None, "total", "total", None, "total"]
    chunks = spark.createDataFrame([("u", 1, 0, 5), ("u", 2, 4, 5), ("u", 3, 5, 5)], "session string, seq long, offset long, size long")
    assert [r["accepted"] for r in accounting.upload_offsets(chunks).orderBy("seq").collect()] == [True, False, True]


@pytest.mark.parametrize(
    ("pattern", "name", "expected"),
    [("**", "a/b", True), ("a/*", "a/b", True), ("a/*", "a/b/c", False), ("a/**", "a/b/c", True), ("a/**", "a", False), ("**/b", "b", True), ("**/b", "a/x/b", True), ("**/b", "ab", False), ("a*c", "abc", True), ("a*c", "a/c", False), ("a.b", "axb", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a**", "ab/c", False)],
)
def test_globs(spark, pattern, name, expected):
    assert one(spark, F.col("n").rlike(globs.to_regex(pattern)), n=name) is expected


def test_policy(spark, rows):
    repos = spark.createDataFrame([("a/b",), ("a/x",), ("q",)], "repo string")
    won = policy.winning_rules(repos, [(0, "a/*"), (1, "**/b"), (2, "a/b"), (3, "a/*")])
    assert rows(won) == [("a/b", 2), ("a/x", 0), ("q", None)]  # most literal, then first declared
    assert globs.literal_length("a/**") == 2 and globs.literal_length("**/b") == 1 and globs.stars("**/b*") == 2
    rules = spark.createDataFrame([(2, 1, 2), (0, 0, 1)], "rule int, anonymous int, authenticated int")
    policies = spark.createDataFrame([(2, ["u"], ["g"], 4)], "rule int, users array<string>, groups array<string>, actions int")
    groups = spark.createDataFrame([("g", "w")], "name string, user string")
    admins = spark.createDataFrame([("root",)], "user string")
    asked = spark.createDataFrame([(None, "a/b"), ("u", "a/b"), ("w", "a/b"), ("v", "a/b"), ("root", "q"), ("u", "q")], "user string, repo string")
    got = {(r["user"], r["repo"]): r["actions"] for r in policy.grants(asked, won, rules, policies, groups, admins).collect()}
    assert got == {(None, "a/b"): 1, ("u", "a/b"): 7, ("w", "a/b"): 7, ("v", "a/b"): 3, ("root", "q"): 7, ("u", "q"): 0}
    assert [r["allowed"] for r in policy.without_policy(asked.limit(2), True).collect()] == [False, True]


def test_buckets(spark):
    requests = spark.createDataFrame([("k", i, t) for i, t in enumerate([0.0, 0.0, 0.0, 0.5, 1.0, 9.0])], "key string, seq long, at double")
    got = [(r["admitted"], r["retry_after"]) for r in traffic.decisions(requests, {"k": (1.0, 2.0)}).orderBy("seq").collect()]
    assert got == [(True, 0), (True, 0), (False, 1), (False, 1), (True, 0), (True, 0)]
    assert all(r["admitted"] for r in traffic.decisions(requests, {}).collect())
    cache = spark.createDataFrame([(0, i, k, 100) for i, k in enumerate("abacab")], "worker int, seq long, key string, size long")
    assert [r["hit"] for r in traffic.cache_hits(cache, 2 * 229, 1000).orderBy("seq").collect()] == [False, False, True, False, True, False]


def test_credentials(spark):
    logins = [(0, "a", True), (5, "a", True), (10, "a", True), (11, "b", False), (12, "b", False), (13, "c", True), (14, "a", True), (15, "d", True), (16, "a", True), (17, "d", True), (18, None, True), (19, None, True)]
    df = spark.createDataFrame([(0, i, t, k, v) for i, (t, k, v) in enumerate(logins)], "worker int, seq long, at long, credential string, valid boolean")
    hits = lambda ttl: [r["hit"] for r in traffic.credential_hits(df, ttl, 2).orderBy("seq").collect()]
    # expired at exactly its time; refusals aren't kept; d finds two and clears them, so a is asked for again
    assert hits(10) == [False, True, False, False, False, False, True, False, False, True, False, False]
    assert not any(hits(0)) and traffic.credential_hits(df.limit(0), 10).count() == 0


def test_policy_versions(spark, rows):
    files = spark.createDataFrame([(1, 0, True), (2, 3, True), (3, 4, True), (4, 11, False), (5, 12, True), (6, 15, False), (7, None, True)], "seq long, at long, valid boolean")
    assert rows(policy.versions(files, 5)) == [(1, 0), (3, 5)]  # 2 is replaced before the poll at 5; at 15 an invalid one is seen
    asked = spark.createDataFrame([(-1,), (0,), (4,), (5,), (99,), (None,)], "at long")
    assert rows(policy.in_force(asked, files, 5)) == sorted([(-1, None), (0, 1), (4, 1), (5, 3), (99, 3), (None, None)], key=lambda t: tuple((x is None, str(x)) for x in t))
    assert {r["version"] for r in policy.in_force(asked, files.limit(0), 5).collect()} == {None}


def test_reload(spark, tmp_path):
    from quayside.streaming.policy import Reload, decided

    source, seen = tmp_path / "rules", []
    source.write_text("a/*")

    def parse(text):
        if text.startswith("!"):
            raise ValueError(text)
        return list(enumerate(text.split()))

    live = Reload(source.read_text, parse)
    folder = tmp_path / "in"
    for text, want in [("a/*", 0), ("q a/*", 1), ("!", 1), (None, 1), ("q", None)]:
        source.write_text(text) if text else source.unlink()
        spark.createDataFrame([("a/x",)], "repo string").write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema("repo string").parquet(str(folder))
        q = decided(stream, live, lambda rows, _: seen.extend(r["rule"] for r in rows.collect()), "0 seconds").option("checkpointLocation", str(tmp_path / "state")).start()
        q.processAllAvailable()
        q.stop()
        assert seen[-1] == want, (text, seen)
    assert len(seen) == 5


def test_paths(spark):
    parse = lambda p: tuple(one(spark, paths.parse_path(F.col("p")), p=p))
    assert parse("/v2/a/blobs/b/manifests/v1") == ("manifest", "a/blobs/b", "v1")
    assert parse("/v2/a/blobs/uploads/") == ("uploads", "a", None) and parse("/v2/a/blobs/uploads/id") == ("upload", "a", "id")
    assert parse("/v2/a/tags/foo")[0] == "unknown" and parse("/v2/a/tags/list") == ("tags", "a", None)
    end = lambda p: one(spark, paths.endpoint(F.col("p")), p=p)
    assert [end(p) for p in ("/livez", "/v2/", "/v2/x/tags/foo", "/v2/x/blobs/uploads", "/v2/x/blobs/d", "/x")] == ["health", "base", "tags", "uploads", "blobs", "other"]
    action = lambda m, p: one(spark, traffic.required_action(F.lit(m), F.col("p")), p=p)
    assert action("GET", "/v2/a/tags/list") == "pull" and action("HEAD", "/v2/a/tags/list") is None and action("DELETE", "/v2/a/manifests/x") == "delete" and action("POST", "/v2/a/blobs/uploads/") == "push"
    good = lambda n: one(spark, paths.is_repo_name(F.col("n")), n=n)
    assert [good(n) for n in ("a/b--c_d__e.f", "A", "a//b", "a___b", "-a", "a" * 255, "a" * 256)] == [True, False, False, False, False, True, False]
    assert [one(spark, paths.is_safe_component(F.col("n")), n=n) for n in ("a", "", ".", "..", "a/b", "...")] == [True, False, False, False, False, True]
    assert [one(spark, paths.status_class(F.col("s")), s=s) for s in (200, 304, 404, 500, 101)] == ["2xx", "3xx", "4xx", "5xx", "5xx"]
    assert one(spark, paths.quarantine_name(F.lit("a/b"), F.lit("sha256:x"), F.lit(7))) == "a__b---sha256_x---7"


def test_headers(spark):
    r = lambda h, n=10: tuple(one(spark, headers.byte_range(F.lit(h).cast("string"), F.lit(n))))
    assert r("bytes=0-4") == ("partial", 0, 4) and r("bytes=5-") == ("partial", 5, 9) and r("bytes=-3") == ("partial", 7, 9) and r("bytes=-30") == ("partial", 0, 9)
    assert r(None)[0] == r("bytes=0-1,3-4")[0] == r("bytes=4-2")[0] == r("x")[0] == "full"
    assert r("bytes=0-9223372036854775807") == r("bytes=0-18446744073709551615") == ("partial", 0, 9) == r("bytes=-18446744073709551615")
    assert r("bytes=18446744073709551615-")[0] == "unsatisfiable" and r("bytes=0-18446744073709551616")[0] == r("bytes=0-100000000000000000000")[0] == "full"
    assert r("bytes=10-")[0] == r("bytes=-0")[0] == r("bytes=-5", 0)[0] == "unsatisfiable"
    match = lambda h: one(spark, headers.if_none_match(F.lit(h), F.lit("e")))
    assert match('"x", W/"e"') and match("*") and not match('"x"')
    assert [one(spark, headers.duration_ms(F.lit(d))) for d in ("1m2.5s", "1.5ms", "x", "1m2")] == [62500.0, 1.5, None, None]
    assert one(spark, headers.json_depth(F.lit('{"a":[{"b":"}]]"}]}'))) == 3 and one(spark, headers.json_depth(F.lit("1"))) == 0
    assert one(spark, headers.artifact_type(F.lit('{"artifactType":"","config":{"mediaType":"c"}}'))) == "c"
    assert one(spark, headers.media_types_agree(F.lit("a/b; charset=x"), F.lit("a/b"))) is True
    assert one(spark, headers.media_types_agree(F.lit("a/b"), F.lit("a/b; x=y"))) is True and one(spark, headers.media_types_agree(F.lit("a/b"), F.lit("a/c"))) is False
    assert one(spark, headers.error_status(F.lit("DENIED"))) == 403


def test_digests(spark):
    assert digests.crc32c(b"123456789") == 0xE3069283 and digests.crc32c(b"") == 0 and digests.crc32c(b"\0" * 32) == 0x8A9136AA
    slow = digests.crc32c(bytes(range(256)) * 9)
    value = 0xFFFFFFFF
    for b in bytes(range(256)) * 9:
        value ^= b
        for _ in range(8):
            value = (value >> 1) ^ (0x82F63B78 if value & 1 else 0)
    assert slow == value ^ 0xFFFFFFFF
    import hashlib
    import hmac

    key = bytes(range(40))
    assert one(spark, digests.hmac_sha256(F.lit("hello"), key)) == hmac.new(key, b"hello", hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        digests.hmac_sha256(F.lit("x"), b"short")
    assert one(spark, digests.is_digest(F.lit("sha256:" + "a" * 64))) and not one(spark, digests.is_digest(F.lit("sha256:" + "g" * 64)))
    assert tuple(one(spark, digests.parse_digest(F.lit("sha256:" + "A" * 64)))) == ("sha256", "a" * 64)


def test_scrub(spark):
    c = b"content"
    d = "sha256:" + __import__("hashlib").sha256(c).hexdigest()
    bad = "sha256:" + "0" * 64
    blobs = spark.createDataFrame([("ok", d, c), ("bare", d, c), ("fixed", d, c), ("bad", bad, c), ("gone", d, None)], "repo string, digest string, content binary")
    recorded = spark.createDataFrame([("ok", d, digests.crc32c(c), 7), ("fixed", d, 1, 7), ("bad", bad, 1, 7)], "repo string, digest string, crc long, size long")
    out = integrity.classify(blobs, recorded, digests.crc32c_col(F.col("content")), F.octet_length("content"))
    assert {r["repo"]: r["result"] for r in out.collect()} == {"ok": "ok", "bare": "ok", "fixed": "repaired", "bad": "corrupt", "gone": "skipped"}
    reads = spark.createDataFrame([(0, i, 100) for i in range(3)], "worker int, position long, size long")
    assert [r["wait_s"] for r in integrity.throttle(reads, 50.0, 100.0).orderBy("position").collect()] == [0.0, 0.0, 2.0]


def test_telemetry(spark, rows):
    s = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 3.0)], "k string, v double")
    assert rows(telemetry.histogram(s, ["k"], "v", [1.0, 2.5]).select("le", "n")) == [(1.0, 1), (2.5, 2), (None, 3)]
    hundred = spark.range(100).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v"))
    assert rows(telemetry.nearest_rank(hundred, ["k"], "v", [50, 99])) == [("a", 49.0, 98.0)]
    assert rows(telemetry.rounded_rank(hundred, ["k"], "v", [50, 99])) == [("a", 50.0, 98.0)]
    raw = spark.createDataFrame([("a", i, r) for i, r in enumerate([5, 9, 2, 3, 1])], "k string, t long, raw long")
    assert [r["total"] for r in telemetry.monotone(raw, ["k"], "t", "raw").orderBy("t").collect()] == [5, 9, 11, 12, 13]
    points = spark.createDataFrame([("a.b", {"x": 'q"\\\n'}, 1)], "name string, labels map<string,string>, value long")
    assert telemetry.exposition(points, "counter", "h").collect()[-1]["line"] == 'a_b_total{x="q\\"\\\\\\n"} 1'
    bare = spark.createDataFrame([("a.b", {}, 1)], "name string, labels map<string,string>, value long")
    assert [r["line"] for r in telemetry.exposition(bare, "gauge", "").collect()] == ["# TYPE a_b gauge", "a_b{} 1"]
    seconds = spark.createDataFrame([("g.x", 0.25), ("g.x", 1.0), ("g.x", 7.0)], "k string, v double")
    hist = telemetry.histogram(seconds, ["k"], "v", [0.25, 5.0]).select(F.lit("t.d").alias("name"), F.create_map(F.lit("a.k"), "k").alias("labels"), "le", "n", "total", "samples")
    lines = [r["line"] for r in telemetry.histogram_exposition(hist, "H.", "s").collect()]
    assert lines == ["# HELP t_d_seconds H.\n# TYPE t_d_seconds histogram", 't_d_seconds_bucket{a.k="g.x",le="0.25"} 1', 't_d_seconds_bucket{a.k="g.x",le="5"} 2', 't_d_seconds_bucket{a.k="g.x",le="+Inf"} 3', 't_d_seconds_sum{a.k="g.x"} 8.25', 't_d_seconds_count{a.k="g.x"} 3']


def test_bench(spark, rows):
    s = spark.createDataFrame([(1, "log", "m", 10.0), (2, "log", "m", 10.0), (1, "x", "m", 5.0), (1, "log", "z", 0.0)], "rep int, registry string, metric string, value double")
    sums = benchstats.summary(s)
    assert ("m", "x", 5.0, 5.0, 5.0, 1, 0.0) in rows(sums) and ("z", "log", 0.0, 0.0, 0.0, 1, 0.0) in rows(sums)
    assert rows(benchstats.compare(sums, "log")) == [("m", "x", 0.5, False, False)]
    assert rows(benchstats.gaps(sums, "log", F.lit(True))) == [("m", 10.0, 5.0, "x", 0.5, 2.0)]
    steps = spark.createDataFrame([("e", 100, 100.0, 5.0, 1.0), ("e", 200, 150.0, 5.0, 1.0), ("e", 400, 400.0, 5.0, 1.0)], "endpoint string, rps int, rate double, p99_ms double, status_share double")
    assert rows(benchstats.sustained(steps)) == [("e", 100)]
    assert rows(benchstats.sustained(steps.filter("rps > 100"))) == [("e", 0)]


def test_gaps(spark, rows):
    """A gap is over ten percent; nothing divides by zero."""
    sums = lambda *x: spark.createDataFrame([("m", r, float(v)) for r, v in x], "metric string, registry string, median double")
    low = lambda *x: rows(benchstats.gaps(sums(*x), "us", F.lit(True)))
    high = lambda *x: rows(benchstats.gaps(sums(*x), "us", F.lit(False)))
    assert low(("us", 100), ("a", 95)) == low(("us", 100), ("a", 90)) == high(("us", 100), ("a", 109)) == low(("us", 100)) == []
    assert low(("us", 100), ("b", 80), ("a", 80), ("c", 85)) == [("m", 100.0, 80.0, "a", 0.8, 1.25)]
    assert high(("us", 100), ("a", 150), ("b", 120)) == [("m", 100.0, 150.0, "a", 1.5, 1.5)]
    assert high(("us", 0), ("a", 5)) == [("m", 0.0, 5.0, "a", float("inf"), float("inf"))] and low(("us", 5), ("a", 0)) == [("m", 5.0, 0.0, "a", 0.0, float("inf"))]


def test_categories(spark):
    leaves = ["memcpy", "tokio::poll", "std::x", "own_x", "rustls::y", "z", "x_[k]"]
    stacks = spark.createDataFrame([([leaf], 1) for leaf in leaves], "frames array<string>, n long")
    got = {r["category"] for r in benchstats.categories(stacks, "^own_").collect()}
    assert got == {"copy/alloc", "runtime", "std-other", "own", "tls", "other", "kernel"}


def test_layout(spark, rows):
    ref = layout.REF_NAME
    a, b, c = ("sha256:" + x * 64 for x in "abc")
    body = '{"manifests":[{"digest":"%s","annotations":{"%s":"t"}},{"digest":"%s","annotations":{"%s":"t"}},{"digest":"%s","artifactType":"x","subject":{"digest":"%s"}},{"digest":"%s","artifactType":"y","subject":{"digest":"%s"}},{"digest":"bad","annotations":{"%s":"u"}}]}' % (a, ref, b, ref, c, a, c, a, ref)
    index = spark.createDataFrame([("r", body), ("broken", "{")], "repo string, body string")
    assert rows(layout.tags(index)) == [("r", "t"), ("r", "u")]
    assert rows(layout.referrers(index)) == [("r", a, c, "x")]  # the first of equal digests
    none = spark.createDataFrame([], "repo string, tag string")
    assert rows(layout.foreign_tags(index, none)) == [("r", "t", b, layout.DEFAULT_MEDIA_TYPE)]
    m = spark.createDataFrame([("r", "m", '{"config":{"digest":"%s"},"layers":[{"digest":"%s"},{"digest":"nope"}],"subject":{"digest":"%s"}}' % (a, a, b))], "repo string, digest string, body string")
    assert rows(layout.references(m)) == [("r", "m", a), ("r", "m", a), ("r", "m", b)]
