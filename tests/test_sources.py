"""Files, logs, tool output, streams."""

import hashlib
import json

from pyspark.sql import functions as F

from quayside.operators import replay
from quayside.registry import Registry
from quayside.sources import bench, layout, wal
from quayside.streaming import log as log_stream
from quayside.streaming import traffic as traffic_stream


def put(repo, digest, tag, refs):
    return {"op": "put_manifest", "repo": repo, "digest": digest, "media_type": "m", "tag": tag, "references": refs}


def test_frames(spark, tmp_path, rows):
    key = bytes(32)
    ops = [{"op": "gen", "gen": 7}, put("r", "d1", "t", ["b"]), {"op": "unknown"}, {"op": "delete_manifest", "repo": "r", "digest": "d0"}]
    good = wal.frame(b"magic\x01", key) + b"".join(wal.frame(json.dumps(o).encode(), key) for o in ops)
    (tmp_path / "a.log").write_bytes(good + wal.frame(b"{}", key)[:-3])
    (tmp_path / "b.log").write_bytes(good[:20])
    found = wal.read(spark, str(tmp_path), key)
    per_file = {r["path"].rsplit("/")[-1]: (r["n"], r["bad"]) for r in found.groupBy("path").agg(F.count("*").alias("n"), F.sum((~F.col("ok")).cast("int")).alias("bad")).collect()}
    assert per_file == {"a.log": (6, 1), "b.log": (1, 1)}
    assert [r["op"] for r in wal.records(found, b"magic").orderBy("seq").collect()] == ["put_manifest", "delete_manifest"]
    assert sorted(r["generation"] for r in wal.generation(found).collect()) == [0, 7]
    assert [ok for _, ok, _ in wal.frames(good, b"x" * 32)] == [False]


def test_image_round_trip(spark, tmp_path, rows):
    ops = [put("r", f"d{i}", f"t{i % 3}" if i % 2 else None, [f"b{i % 4}", "b9"]) for i in range(8)] + [{"op": "put_checksum", "repo": "r", "digest": "d1", "crc32c": 5, "size": 6}, {"op": "put_referrer", "repo": "r", "subject": "s", "referrer": "d2", "descriptor": '{"artifactType":"sbom"}'}, {"op": "delete_manifest", "repo": "r", "digest": "d3"}]
    (tmp_path / "w").mkdir()
    (tmp_path / "w/x.log").write_bytes(b"".join(wal.frame(json.dumps(o).encode()) for o in ops))
    state = Registry.open(spark, str(tmp_path), str(tmp_path / "w"))
    state.compact(str(tmp_path / "image"), 1)
    frames = [bytes(r["frame"]) for r in spark.read.parquet(str(tmp_path / "image/generation=1")).collect()]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/x.log").write_bytes(b"".join(frames))
    again = Registry.open(spark, str(tmp_path), str(tmp_path / "v"))
    for name in ("tags", "manifests", "edges", "referrers", "checksums"):
        assert rows(getattr(state, name)()) == rows(getattr(again, name)()), name
        assert replay.difference(getattr(state, name)(), getattr(again, name)()).isEmpty()


def test_layout_tree(spark, tmp_path, rows):
    content = b"blob"
    digest = hashlib.sha256(content).hexdigest()
    for repo in ("a/b", "c"):
        (tmp_path / repo / "blobs/sha256").mkdir(parents=True)
        (tmp_path / repo / "blobs/sha256" / digest).write_bytes(content)
        (tmp_path / repo / "blobs/sha256/notadigest").write_bytes(content)
        (tmp_path / repo / "index.json").write_text('{"manifests":[]}')
    (tmp_path / "c/uploads/x").mkdir(parents=True)
    (tmp_path / "c/uploads/x/index.json").write_text("{}")
    root = str(tmp_path)
    assert rows(layout.repositories(spark, root)) == [("a/b",), ("c",)]
    assert rows(layout.blobs(spark, root).select("repo", "digest", "size")) == [("a/b", f"sha256:{digest}", 4), ("c", f"sha256:{digest}", 4)]
    empty = spark.createDataFrame([], "seq long, op string, repo string, digest string, media_type string, tag string, refs array<string>, subject string, artifact_type string, crc long, size long")
    r = Registry(spark, root, empty)
    assert r.gc_candidates().count() == 2 and {x["result"] for x in r.scrub().collect()} == {"ok"}
    assert (None, 8) in rows(r.quota())


def test_tool_output(spark, rows):
    text = "Test name: pull\nRequests per second: 12.5\nFailed requests: 2\np50: 1.5ms\nManifest GET TTFB p99: 1s\n=====\nno name\n=====\n"
    got = {(r["name"], r["metric"]): r["value"] for r in bench.blocks(spark.createDataFrame([(1, text)], "id int, text string")).collect()}
    assert got == {("pull", "rps"): 12.5, ("pull", "failed"): 2.0, ("pull", "p50_ms"): 1.5, ("pull", "manifest_get_ttfb_p99"): 1000.0}
    line = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert rows(bench.folded(line("a;b c;d 7", "", "x y"))) == [(["a", "b c", "d"], 7)]
    assert rows(bench.traced(line("read 10 0 1.5 0.1 0.2 0.3 2%", "read 4 2.5 0.1 0.2 0.3 1%", "syscall calls x"))) == [("read", 10, 1.5), ("read", 4, 2.5)]
    assert rows(bench.counted(line("50.0 0.5 10 20 read", "1.0 0.1 1 2 3 write", "100 1 1 1 total"))) == [("read", 20, 500.0), ("write", 2, 100.0)]
    assert rows(bench.exposition(line('a_sum{x="1"} 2.5', "# HELP a", "b 1"), "a")) == [("a_sum", '{x="1"}', 2.5)]
    assert bench.corpus(spark, 200).select("repo").distinct().count() == 100


def test_log_stream_equals_batch(spark, tmp_path, rows):
    schema = "seq long, op string, repo string, digest string, media_type string, tag string, refs array<string>, subject string, artifact_type string, crc long, size long"
    ops = [(i, "put_manifest", "r", f"d{i % 7}", "m", f"t{i % 5}", [f"b{i % 3}"], None, None, None, None) for i in range(40)] + [(50 + i, "delete_manifest", "r", f"d{i}", None, None, None, None, None, None, None) for i in (2, 5)] + [(60, "put_manifest", "r", "d2", "m", "new", ["b0"], None, None, None, None)]
    whole = spark.createDataFrame(ops, schema)
    src = str(tmp_path / "in")
    for part in (ops[:20], ops[20:41], ops[41:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(src)
    log_stream.maintain(stream, str(tmp_path / "state"), str(tmp_path / "cp")).awaitTermination(120)
    now = log_stream.current(spark, str(tmp_path / "state"))
    for f in (replay.tags, replay.manifests, replay.edges):
        assert rows(f(now)) == rows(f(whole))


def test_bucket_stream(spark, tmp_path):
    data = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate([0, 0, 0, 1, 5])], "key string, seq long, at double")
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = traffic_stream.decisions(stream, {"k": (1.0, 2.0)}).writeStream.format("memory").queryName("buckets").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [r["admitted"] for r in spark.sql("select * from buckets order by seq").collect()]
    assert got == [True, True, False, True, True]
