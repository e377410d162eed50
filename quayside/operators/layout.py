"""Image layouts: index documents and manifests as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.functions.digests import is_digest
from quayside.operators.lookup import DEFAULT_MEDIA_TYPE

#: Fixed value: the annotation that names a tag.
REF_NAME = "org.opencontainers.image.ref.name"

_S = T.StringType()
DESCRIPTOR = T.StructType([T.StructField("mediaType", _S), T.StructField("digest", _S), T.StructField("size", T.LongType()), T.StructField("artifactType", _S), T.StructField("annotations", T.MapType(_S, _S)), T.StructField("subject", T.StructType([T.StructField("digest", _S)]))])
MANIFEST = T.StructType([T.StructField("schemaVersion", T.IntegerType()), T.StructField("mediaType", _S), T.StructField("artifactType", _S), T.StructField("config", DESCRIPTOR), T.StructField("layers", T.ArrayType(DESCRIPTOR)), T.StructField("manifests", T.ArrayType(DESCRIPTOR)), T.StructField("subject", DESCRIPTOR), T.StructField("annotations", T.MapType(_S, _S))])


def parse(body: str = "body") -> Column:
    """A manifest or index from JSON; null fields where the text isn't one. The schema is fixed, never inferred."""
    return F.from_json(F.col(body), MANIFEST, {"mode": "PERMISSIVE"})


def references(manifests: DataFrame) -> DataFrame:
    """manifests: repo, digest, body. repo, manifest, blob: config, layers, children and subject in this order; repeated
    references stay, bad digests are left out."""
    m = manifests.withColumn("_m", parse())
    all_ = F.concat(F.array("_m.config"), F.coalesce("_m.layers", F.array()), F.coalesce("_m.manifests", F.array()), F.array("_m.subject"))
    digests = F.transform(all_, lambda d: d["digest"])
    out = m.select("repo", F.col("digest").alias("manifest"), F.explode(digests).alias("blob"))
    return out.filter(is_digest("blob")).withColumn("blob", F.lower("blob"))


def entries(indexes: DataFrame) -> DataFrame:
    """indexes: repo, body. A row a descriptor: repo, pos, digest, media_type, artifact_type, size, annotations, tag, subject."""
    d = indexes.withColumn("_m", parse()).select("repo", F.posexplode("_m.manifests").alias("pos", "d"))
    return d.select("repo", "pos", "d.digest", F.col("d.mediaType").alias("media_type"), F.col("d.artifactType").alias("artifact_type"), "d.size", "d.annotations", F.col("d.annotations")[REF_NAME].alias("tag"), F.col("d.subject.digest").alias("subject"))


def tags(indexes: DataFrame) -> DataFrame:
    """repo, tag: the distinct tags of each index."""
    return entries(indexes).filter("tag IS NOT NULL").select("repo", "tag").distinct()


def referrers(indexes: DataFrame, artifact_type: str | None = None) -> DataFrame:
    """repo, subject, digest, artifact_type: of equal digests under a subject the first in the index."""
    e = entries(indexes).filter("subject IS NOT NULL")
    e = e if artifact_type is None else e.filter(F.col("artifact_type") == artifact_type)
    return e.groupBy("repo", "subject", "digest").agg(F.min_by("artifact_type", "pos").alias("artifact_type"))


def fallback_tag(digest: str) -> Column:
    """The tag under which a client without the referrers API keeps the list of a digest's referrers."""
    parts = F.split(F.col(digest), ":")
    return F.concat(parts[0], F.lit("-"), F.substring(parts[1], 1, 64))


def referrers_or_fallback(requests: DataFrame, referrers_: DataFrame, tags_: DataFrame, bodies: DataFrame) -> DataFrame:
    """requests: repo, subject. repo, subject, referrer, via: the recorded referrers, or where there are none the children
    of the index that the fallback tag names. bodies: repo, digest, body."""
    have = requests.join(referrers_.select("repo", "subject", "referrer").distinct(), ["repo", "subject"]).withColumn("via", F.lit("index"))
    rest = requests.join(referrers_.select("repo", "subject"), ["repo", "subject"], "left_anti").withColumn("tag", fallback_tag("subject"))
    at = rest.join(tags_.select("repo", "tag", "digest"), ["repo", "tag"]).join(bodies, ["repo", "digest"])
    listed = at.withColumn("d", F.explode(F.transform(parse()["manifests"], lambda d: d["digest"]))).select("repo", "subject", F.col("d").alias("referrer"), F.lit("tag").alias("via"))
    return have.unionByName(listed)


def foreign_tags(indexes: DataFrame, tags_: DataFrame) -> DataFrame:
    """repo, tag, digest, media_type of tags that only the index has, with a valid digest; the last of equal tags."""
    e = entries(indexes).filter(F.col("tag").isNotNull() & is_digest("digest"))
    last = e.groupBy("repo", "tag").agg(F.max_by(F.struct("digest", "media_type"), "pos").alias("d")).select("repo", "tag", "d.*")
    return last.join(tags_.select("repo", "tag"), ["repo", "tag"], "left_anti").withColumn("media_type", F.coalesce("media_type", F.lit(DEFAULT_MEDIA_TYPE)))


def warm_referrers(indexes: DataFrame, referrers_: DataFrame) -> DataFrame:
    """repo, subject, digest, artifact_type of links that only the indexes have."""
    return referrers(indexes).join(referrers_.select("repo", "subject", F.col("referrer").alias("digest")), ["repo", "subject", "digest"], "left_anti")


def rebuild(indexes: DataFrame, tags_: DataFrame, manifests: DataFrame, sizes: DataFrame) -> DataFrame:
    """repo, part, tag, digest, media_type, size: the entries of each repository's new index. Part 0 has a row a recorded
    tag, part 1 the untagged manifests, part 2 what the old index has of digests unknown to the records. Media types come
    from the records, then the old index; sizes from the old index, then from sizes (repo, digest, size)."""
    old = entries(indexes).groupBy("repo", "digest").agg(F.min_by(F.struct("media_type", "size", "tag"), "pos").alias("o")).select("repo", "digest", F.col("o.media_type").alias("_media"), F.col("o.size").alias("_size"), F.col("o.tag").alias("_tag"))
    none = F.lit(None).cast("string")
    tagged = tags_.select("repo", F.lit(0).alias("part"), "tag", "digest", "media_type")
    bare = manifests.join(tags_.select("repo", "digest"), ["repo", "digest"], "left_anti").select("repo", F.lit(1).alias("part"), none.alias("tag"), "digest", "media_type")
    foreign = old.join(manifests.select("repo", "digest"), ["repo", "digest"], "left_anti").select("repo", F.lit(2).alias("part"), F.col("_tag").alias("tag"), "digest", F.col("_media").alias("media_type"))
    out = tagged.unionByName(bare).unionByName(foreign).join(old.drop("_tag"), ["repo", "digest"], "left").join(sizes.select("repo", "digest", F.col("size").alias("_stat")), ["repo", "digest"], "left")
    return out.select("repo", "part", "tag", "digest", F.coalesce("media_type", "_media", F.lit(DEFAULT_MEDIA_TYPE)).alias("media_type"), F.coalesce("_size", "_stat").alias("size"))


def to_index(rows: DataFrame) -> DataFrame:
    """rows as rebuild() gives them. repo, body: each repository's index document, parts in order, by tag, then digest."""
    desc = F.struct(F.col("media_type").alias("mediaType"), "digest", "size", F.when(F.col("tag").isNotNull(), F.create_map(F.lit(REF_NAME), F.col("tag"))).alias("annotations"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", F.coalesce("tag", F.lit("")).alias("t"), F.col("digest").alias("g"), F.to_json(desc).alias("d")))), lambda x: x["d"])
    head = '{"schemaVersion":2,"mediaType":"application/vnd.oci.image.index.v1+json","manifests":['
    return rows.groupBy("repo").agg(F.concat(F.lit(head), F.array_join(ordered, ","), F.lit("]}")).alias("body"))


def latest_tag_places(indexes: DataFrame) -> DataFrame:
    """repo, tag, pos: where each tag stands last in its index."""
    w = Window.partitionBy("repo", "tag").orderBy(F.desc("pos"))
    return entries(indexes).filter("tag IS NOT NULL").withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("repo", "tag", "pos")
