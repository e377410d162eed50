"""Point lookups in batch form: a table of requests joined to an index table, one row out for each request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the media type of a manifest about which nothing is recorded.
DEFAULT_MEDIA_TYPE = "application/vnd.oci.image.manifest.v1+json"


def resolve_tags(requests: DataFrame, tags: DataFrame) -> DataFrame:
    """requests: repo, tag. Adds digest and media_type, null where the tag doesn't exist."""
    return requests.join(tags.select("repo", "tag", "digest", "media_type"), ["repo", "tag"], "left")


def media_types(requests: DataFrame, manifests: DataFrame) -> DataFrame:
    """requests: repo, digest. Adds media_type, null for an unknown manifest."""
    return requests.join(manifests.select("repo", "digest", "media_type"), ["repo", "digest"], "left")


def has_referrer(requests: DataFrame, referrers: DataFrame) -> DataFrame:
    """requests: repo, digest. Adds found: whether anything refers to the digest. Subjects are made distinct before they
    move, so a subject with many referrers is one row."""
    subjects = referrers.select("repo", F.col("subject").alias("digest")).distinct().withColumn("found", F.lit(True))
    return requests.join(subjects, ["repo", "digest"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def backrefs(edges: DataFrame) -> DataFrame:
    """repo, blob, manifest: the manifests that refer to each blob, a row each. A base layer may have millions, so they are
    rows and not an array."""
    return edges.select("repo", "blob", "manifest").distinct()


def backrefs_of(edges: DataFrame, repo: str, blob: str) -> DataFrame:
    """manifest: those that refer to one blob, in byte order."""
    return edges.filter((F.col("repo") == repo) & (F.col("blob") == blob)).select("manifest").distinct().orderBy("manifest")


def backref_counts(edges: DataFrame) -> DataFrame:
    """repo, blob, n: how many different manifests refer to each blob. A repeated edge counts once."""
    return edges.select("repo", "blob", "manifest").distinct().groupBy("repo", "blob").agg(F.count("*").alias("n"))


def checksums(requests: DataFrame, recorded: DataFrame) -> DataFrame:
    """requests: repo, digest. Adds the recorded crc and size, null where none is."""
    return requests.join(recorded.select("repo", "digest", "crc", "size"), ["repo", "digest"], "left")


def blob_sizes(requests: DataFrame, recorded: DataFrame, listing: DataFrame) -> DataFrame:
    """requests: repo, digest. Adds exists and size; a recorded checksum answers before the listing does, so contents
    are never read."""
    a = recorded.select("repo", "digest", F.col("size").alias("_recorded"))
    b = listing.select("repo", "digest", F.col("size").alias("_listed"))
    out = requests.join(a, ["repo", "digest"], "left").join(b, ["repo", "digest"], "left").withColumn("size", F.coalesce("_recorded", "_listed"))
    return out.withColumn("exists", F.col("size").isNotNull()).drop("_recorded", "_listed")


def resolve_references(requests: DataFrame, tags: DataFrame, manifests: DataFrame, index_types: DataFrame) -> DataFrame:
    """requests: repo, reference. A reference with a colon is a digest, any other a tag. Adds digest and media_type; the
    latter from the manifest table, then the layout's index, then the default. Digests nothing knows have no digest."""
    t = tags.select("repo", F.col("tag").alias("reference"), F.col("digest").alias("_tagged"))
    is_digest = F.instr("reference", ":") > 0
    out = requests.join(t, ["repo", "reference"], "left").withColumn("digest", F.when(is_digest, F.col("reference")).otherwise(F.col("_tagged"))).drop("_tagged")
    m = manifests.select("repo", "digest", F.col("media_type").alias("_known"))
    i = index_types.select("repo", "digest", F.col("media_type").alias("_indexed"))
    out = out.join(m, ["repo", "digest"], "left").join(i, ["repo", "digest"], "left")
    known = F.col("_known").isNotNull() | F.col("_indexed").isNotNull()
    media = F.when(F.col("digest").isNotNull(), F.coalesce("_known", "_indexed", F.lit(DEFAULT_MEDIA_TYPE)))
    return out.withColumn("media_type", media).withColumn("recorded", known).drop("_known", "_indexed")


def due(candidates: DataFrame, now: Column, delay_s: int) -> DataFrame:
    """Candidates marked at least delay_s ago; the boundary counts."""
    return candidates.filter(F.unix_timestamp(now) - F.unix_timestamp("marked_at") >= delay_s)


def missing_references(edges: DataFrame, blobs: DataFrame) -> DataFrame:
    """repo, manifest, blob of references to blobs that their repository lacks."""
    return edges.select("repo", "manifest", "blob").join(blobs.select("repo", F.col("digest").alias("blob")), ["repo", "blob"], "left_anti").distinct()


def _mark() -> Column:
    return F.xxhash64(F.concat("repo", F.lit("\0"), "digest"))


def presence_filter(blobs: DataFrame) -> DataFrame:
    """mark: 64 bits for each blob (repo, digest), an index to ask before the listing, nine times smaller than digests."""
    return blobs.select(_mark().alias("mark")).distinct()


def maybe_present(requests: DataFrame, marks: DataFrame, capacity: int) -> DataFrame:
    """requests: repo, digest. Adds maybe: false is certain absence, true is to be verified. A filter with more marks than
    its capacity is no longer kept up and says true to everything; a request with a null is absent."""
    full = marks.agg((F.count("*") > capacity).alias("_full"))  # one row
    hits = requests.withColumn("mark", _mark()).join(marks.withColumn("_hit", F.lit(True)), "mark", "left")
    return hits.crossJoin(F.broadcast(full)).withColumn("maybe", F.col("_full") | F.coalesce("_hit", F.lit(False))).drop("mark", "_hit", "_full")
