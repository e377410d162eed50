"""The framed metadata log: a 4-byte length, a 4-byte CRC-32C of the payload (both little-endian), the payload (JSON) and,
with a key, 32 bytes of HMAC-SHA256.

A file is one sequence, so it is one task; files are read side by side. Frames after the first bad one are reported as
not ok once and not read: what they would hold can't be known.
"""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.digests import crc32c

FRAMES = "path string, seq long, ok boolean, payload binary"
PAYLOAD = "op string, repo string, digest string, media_type string, tag string, `references` array<string>, subject string, descriptor string, manifest string, blobs array<string>, referrer string, crc32c long, size long, generation long"
TAG = 32


def frames(data: bytes, key: bytes | None = None) -> Iterator[tuple[int, bool, bytes | None]]:
    """seq from 1, ok, payload; ends after the first frame that is cut short or fails a check."""
    at, seq = 0, 0
    while at < len(data):
        seq += 1
        body = at + 8
        size = struct.unpack_from("<I", data, at)[0] if body <= len(data) else 0
        end = body + size
        if body > len(data) or end + (TAG if key else 0) > len(data):
            yield seq, False, None
            return
        payload = data[body:end]
        good = crc32c(payload) == struct.unpack_from("<I", data, at + 4)[0]
        if good and key:
            good = hmac.compare_digest(hmac.new(key, payload, hashlib.sha256).digest(), data[end : end + TAG])
        if not good:
            yield seq, False, None
            return
        yield seq, True, payload
        at = end + (TAG if key else 0)


def frame(payload: bytes, key: bytes | None = None) -> bytes:
    tag = hmac.new(key, payload, hashlib.sha256).digest() if key else b""
    return struct.pack("<II", len(payload), crc32c(payload)) + payload + tag


def read(spark: SparkSession, path: str, key: bytes | None = None, stream: bool = False) -> DataFrame:
    """path, seq, ok, payload of the frames of all files at path, batch or stream."""
    files = spark.read.format("binaryFile") if not stream else spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                rows = [(file, *f) for f in frames(bytes(data), key)]
                yield pd.DataFrame(rows, columns=["path", "seq", "ok", "payload"])

    return files.load(path).select("path", "content").mapInPandas(run, FRAMES)


#: The operations of the log; others are skipped.
OPERATIONS = ["put_manifest", "delete_manifest", "put_backrefs", "put_referrer", "put_checksum", "delete_blob"]


def records(found: DataFrame, magic: bytes | None = None) -> DataFrame:
    """The operations of good frames, as columns of replay.py. A first frame that begins with magic is a header, and a
    generation marker counts among the first two frames only; both are left out, as are unknown operations."""
    p = F.from_json(F.col("payload").cast("string"), PAYLOAD, {"mode": "PERMISSIVE"})
    rows = found.filter("ok")
    if magic is not None:
        rows = rows.filter(~((F.col("seq") == 1) & F.startswith("payload", F.lit(magic))))
    rows = rows.withColumn("p", p).filter(F.col("p.op").isin(OPERATIONS))
    own = F.coalesce("p.digest", "p.referrer", "p.manifest")
    return rows.select(
        "path", "seq", F.col("p.op").alias("op"), F.col("p.repo").alias("repo"), own.alias("digest"), F.col("p.media_type").alias("media_type"), F.col("p.tag").alias("tag"), F.coalesce("p.references", "p.blobs").alias("refs"),
        F.col("p.subject").alias("subject"), F.get_json_object("p.descriptor", "$.artifactType").alias("artifact_type"), F.col("p.crc32c").alias("crc"), F.col("p.size").alias("size"),
    )


def generation(found: DataFrame) -> DataFrame:
    """path, generation: the number in the marker ({"op": "gen", "gen": n}) among each file's first two frames; 0 without one."""
    g = F.when((F.col("seq") <= 2) & F.col("ok") & (F.get_json_object(F.col("payload").cast("string"), "$.op") == "gen"), F.get_json_object(F.col("payload").cast("string"), "$.gen").try_cast("long"))
    return found.groupBy("path").agg(F.coalesce(F.max(g), F.lit(0)).alias("generation"))


def payloads(image: DataFrame) -> DataFrame:
    """payload: the JSON of each row of replay.compact, null fields left out."""
    c = F.col
    body = F.to_json(F.struct(
        c("op"), c("repo"), F.when(c("op").isin("put_manifest", "put_checksum"), c("digest")).alias("digest"), F.when(c("op") == "put_backrefs", c("digest")).alias("manifest"), F.when(c("op") == "put_referrer", c("digest")).alias("referrer"),
        c("media_type"), c("tag"), F.when(c("op") == "put_backrefs", F.array("other")).alias("blobs"), F.when(c("op") == "put_referrer", c("other")).alias("subject"),
        F.when((c("op") == "put_referrer") & c("extra").isNotNull(), F.to_json(F.struct(c("extra").alias("artifactType")))).alias("descriptor"),
        F.when(c("op") == "put_checksum", c("other").cast("long")).alias("crc32c"), F.when(c("op") == "put_checksum", c("extra").cast("long")).alias("size"),
    ))
    return image.select(body.alias("payload"))


def write_image(image: DataFrame, path: str, generation_: int, key: bytes | None = None) -> None:
    """The compacted log as one table of frames a generation: <path>/generation=<n>. A new generation is a new folder, so
    readers of the old one aren't disturbed, and the newest complete one (with _SUCCESS) counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"frame": [frame(p.encode(), key) for p in batch["payload"]]})

    payloads(image).mapInPandas(run, "frame binary").write.mode("errorifexists").parquet(f"{path}/generation={generation_}")


def append(records_: DataFrame, path: str) -> None:
    """Appends log records (columns of replay.py) to a table, a file a task; each file appears whole or not at all."""
    records_.write.mode("append").parquet(path)
