"""The write path in batches: checked uploads become blobs, manifests become log records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.digests import crc32c_col, digest_of, is_digest, matches_digest
from quayside.functions.headers import artifact_type, json_depth, media_type, media_types_agree
from quayside.operators import accounting, integrity, layout, lookup

#: The most that JSON may nest, and the operations' columns.
MAX_DEPTH = 32
COLUMNS = ["seq", "op", "repo", "digest", "media_type", "tag", "refs", "subject", "artifact_type", "crc", "size"]
_TYPES = {"seq": "long", "refs": "array<string>", "crc": "long", "size": "long"}


def record(rows: DataFrame, op: str, **values: Column) -> DataFrame:
    """Log records of one operation; columns that aren't given are null."""
    known = {"repo": F.col("repo"), "digest": F.col("digest"), "seq": F.col("seq")} | values
    return rows.select(*[(F.lit(op) if c == "op" else known.get(c, F.lit(None))).cast(_TYPES.get(c, "string")).alias(c) for c in COLUMNS])


def put_blobs(uploads: DataFrame, max_bytes: int, repo_cap: int = 0) -> DataFrame:
    """uploads: repo, seq, digest, content. Adds verdict: integrity.verify's, or `over quota` for what the repository's cap
    leaves no room for. Refused uploads don't count against the cap."""
    checked = integrity.verify(uploads, max_bytes)
    sized = checked.filter("verdict = 'accepted'").select("repo", "seq", F.octet_length("content").cast("long").alias("size"))
    fits = accounting.admission(sized, repo_cap).select("repo", "seq", "admitted")
    over = (F.col("verdict") == "accepted") & ~F.col("admitted")
    return checked.join(fits, ["repo", "seq"], "left").withColumn("verdict", F.when(over, "over quota").otherwise(F.col("verdict"))).drop("admitted")


def blob_records(accepted: DataFrame) -> DataFrame:
    """A put_checksum record for each accepted upload."""
    return record(accepted, "put_checksum", crc=crc32c_col(F.col("content")), size=F.octet_length("content"))


def _malformed(document: Column) -> Column:
    """Whether a manifest names its media type, config or layers in a way that can't be read; what is absent is well."""
    proper = lambda d: is_digest(F.try_variant_get(d, "$.digest", "string"))
    media, config, layers = (F.try_variant_get(document, f"$.{k}", "variant") for k in ("mediaType", "config", "layers"))
    listed = F.try_variant_get(document, "$.layers", "array<variant>")
    return (
        F.coalesce(F.schema_of_variant(media) != "STRING", F.lit(False))
        | (config.isNotNull() & ~proper(config))
        | (layers.isNotNull() & listed.isNull())
        | F.coalesce(F.exists(listed, lambda d: ~proper(d)), F.lit(False))
    )


def named(requests: DataFrame) -> DataFrame:
    """requests: reference, body. Adds digest, tag and matches: a reference with a colon must be the body's digest, by its own
    algorithm; any other is a tag, and the digest is the body's SHA-256."""
    by_digest = F.instr("reference", ":") > 0
    out = requests.withColumn("digest", F.when(by_digest, F.lower("reference")).otherwise(digest_of("body")))
    out = out.withColumn("tag", F.when(~by_digest, F.col("reference")))
    return out.withColumn("matches", ~by_digest | (is_digest("reference") & matches_digest("body", "reference")))


def put_manifests(manifests: DataFrame, blobs: DataFrame) -> DataFrame:
    """manifests: repo, seq, digest, tag, content_type, body; blobs: repo, digest. Adds verdict: `too deep`, `invalid` (the
    body's media type isn't the header's or no string, the layers are no array, or the config or a layer has no proper
    digest), `blob unknown` (a config or layer that the repository lacks) or `accepted`. A
    body that isn't JSON refers to nothing and is accepted."""
    m = manifests.withColumn("_m", layout.parse())
    own = F.col("_m.mediaType")
    clash = ~media_types_agree(F.col("content_type"), own) | _malformed(F.try_parse_json("body"))
    needed = F.concat(F.array("_m.config"), F.coalesce("_m.layers", F.array()))
    refs = m.select("repo", F.col("digest").alias("manifest"), F.explode(F.transform(needed, lambda d: d["digest"])).alias("blob")).filter("blob IS NOT NULL")
    lacking = lookup.missing_references(refs, blobs).select("repo", F.col("manifest").alias("digest")).distinct().withColumn("_lacks", F.lit(True))
    verdict = F.when(json_depth(F.col("body")) > MAX_DEPTH, "too deep").when(F.coalesce(clash, F.lit(False)), "invalid").when(F.col("_lacks"), "blob unknown").otherwise("accepted")
    return m.join(lacking, ["repo", "digest"], "left").withColumn("verdict", verdict).drop("_m", "_lacks")


def manifest_records(accepted: DataFrame) -> DataFrame:
    """One put_manifest record a manifest, with its tag, references and subject: it is applied as a whole or not at all."""
    refs = layout.references(accepted).groupBy("repo", F.col("manifest").alias("digest")).agg(F.collect_list("blob").alias("_refs"))
    rows = accepted.join(refs, ["repo", "digest"], "left").withColumn("_m", layout.parse())
    return record(rows, "put_manifest", media_type=media_type(F.col("content_type")), tag=F.col("tag"), refs=F.col("_refs"), subject=F.col("_m.subject.digest"), artifact_type=artifact_type(F.col("body")))


def delete_manifests(requests: DataFrame) -> DataFrame:
    """requests: repo, seq, digest."""
    return record(requests, "delete_manifest")


def delete_blobs(requests: DataFrame) -> DataFrame:
    return record(requests, "delete_blob")


def mount(requests: DataFrame) -> DataFrame:
    """requests that routing.mountable found ok: the target's new blob rows. Bytes are shared, so only rows are copied."""
    return requests.filter("ok").select(F.col("target").alias("repo"), "digest").distinct()
