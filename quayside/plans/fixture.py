"""The registry model as views of the star-schema tables, so that every operator has inputs of any scale.

Digests are hashes of keys, made after joins and DISTINCT have run on the integer keys; no view reads a column it
doesn't need. Each view is a lazy DataFrame of (spark, sf_dir).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Media types of manifests by key modulo 3.
MEDIA_TYPES = ["application/vnd.oci.image.manifest.v1+json", "application/vnd.oci.image.index.v1+json", "application/vnd.docker.distribution.manifest.v2+json"]
#: The method that an event stands for.
METHODS = {"view": "GET", "click": "HEAD", "purchase": "PUT", "signup": "POST", "error": "DELETE"}
#: Milliseconds after a put at which manifests of finished orders are deleted, and the factor that puts the order key into seq.
DELETE_AFTER_S, SEQ_SCALE = 30 * 86400, 100_000_000


def digest(prefix: str, key: str) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit(prefix), F.col(key).cast("string")), 256))


class Model:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        """n, customer, status, at, kind, repo: a manifest's key and properties."""
        places = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        repo = F.concat_ws("/", F.lower("r_name"), F.translate(F.lower("n_name"), "_", "-"), F.lower("c_mktsegment"))
        places = places.select(F.col("c_custkey").alias("customer"), repo.alias("repo"))
        o = self.table("orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("customer"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("at"), F.col("o_orderpriority").alias("kind"))
        return o.join(places, "customer")

    @cached_property
    def manifests(self) -> DataFrame:
        """repo, digest, media_type, n, status."""
        media = F.element_at(F.array(*[F.lit(m) for m in MEDIA_TYPES]), (F.col("n") % 3 + 1).cast("int"))
        return self.orders.select("repo", digest("order-", "n").alias("digest"), media.alias("media_type"), "n", "status")

    @cached_property
    def tags(self) -> DataFrame:
        """repo, tag, digest, media_type of the manifests that aren't pending."""
        return self.manifests.filter("status <> 'P'").select("repo", F.concat(F.lit("v"), "n").alias("tag"), "digest", "media_type")

    @cached_property
    def edge_keys(self) -> DataFrame:
        """repo, n, part, status: distinct references by key."""
        items = self.table("lineitem").select(F.col("l_orderkey").alias("n"), F.col("l_partkey").alias("part")).distinct()
        return items.join(self.orders.select("n", "repo", "status"), "n")

    def edges(self, keys: DataFrame | None = None) -> DataFrame:
        """repo, manifest, blob."""
        return (self.edge_keys if keys is None else keys).select("repo", digest("order-", "n").alias("manifest"), digest("part-", "part").alias("blob"))

    @cached_property
    def blob_keys(self) -> DataFrame:
        """repo, part, size."""
        sizes = self.table("part").select(F.col("p_partkey").alias("part"), (F.col("p_size").cast("long") * 1024).alias("size"))
        return self.edge_keys.select("repo", "part").distinct().join(sizes, "part")

    @cached_property
    def blobs(self) -> DataFrame:
        """repo, digest, size."""
        return self.blob_keys.select("repo", digest("part-", "part").alias("digest"), "size")

    @cached_property
    def referrers(self) -> DataFrame:
        """repo, subject, referrer, artifact_type: an order refers to the same customer's order before it."""
        w = Window.partitionBy("customer").orderBy("at", "n")
        rows = self.orders.select("repo", "n", "kind", F.lag("n").over(w).alias("before")).filter("before IS NOT NULL")
        return rows.select("repo", digest("order-", "before").alias("subject"), digest("order-", "n").alias("referrer"), F.col("kind").alias("artifact_type"))

    @cached_property
    def contents(self) -> DataFrame:
        """repo, digest, size, seq, content: the documents as blobs of their source's repository."""
        d = self.table("documents")
        return d.select(F.col("source").alias("repo"), F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("digest"), F.octet_length("text").cast("long").alias("size"), F.col("doc_id").alias("seq"), F.col("text").alias("content"))

    @cached_property
    def requests(self) -> DataFrame:
        """seq, at, client, method, seconds, status."""
        e = self.table("events")
        method = F.create_map(*[F.lit(x) for kv in METHODS.items() for x in kv])[F.col("event_type")]
        status = F.when(F.col("event_id") % 97 == 0, 500).when(F.col("event_id") % 13 == 0, 404).when(F.col("event_id") % 29 == 0, 304).otherwise(200)
        return e.select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("client"), F.coalesce(method, F.lit("GET")).alias("method"), (F.col("value") / 1000).alias("seconds"), status.alias("status"))

    @cached_property
    def log(self) -> DataFrame:
        """seq, op, repo, digest, media_type, tag, subject, artifact_type, crc, size, n: each order's put, and the later
        deletion of finished ones; a checksum for every second put. seq orders by time, then key."""
        second = F.unix_timestamp("at")
        base = self.orders.select("repo", digest("order-", "n").alias("digest"), F.element_at(F.array(*[F.lit(m) for m in MEDIA_TYPES]), (F.col("n") % 3 + 1).cast("int")).alias("media_type"), "status", second.alias("_s"), "n")
        none, number = F.lit(None).cast("string"), F.lit(None).cast("long")
        puts = base.select((F.col("_s") * SEQ_SCALE + F.col("n")).alias("seq"), F.lit("put_manifest").alias("op"), "repo", "digest", "media_type", F.when(F.col("status") != "P", F.concat(F.lit("t"), (F.col("n") % 50).cast("string"))).alias("tag"), number.alias("crc"), number.alias("size"), "n")
        sums = base.filter("n % 2 = 0").select((F.col("_s") * SEQ_SCALE + F.col("n")).alias("seq"), F.lit("put_checksum").alias("op"), "repo", "digest", none.alias("media_type"), none.alias("tag"), (F.col("n") * 7 % 4294967296).alias("crc"), (F.col("n") * 10).alias("size"), "n")
        gone = base.filter("status = 'F'").select(((F.col("_s") + DELETE_AFTER_S) * SEQ_SCALE + F.col("n")).alias("seq"), F.lit("delete_manifest").alias("op"), "repo", "digest", none.alias("media_type"), none.alias("tag"), number.alias("crc"), number.alias("size"), "n")
        return puts.unionByName(sums).unionByName(gone)

    @cached_property
    def log_references(self) -> DataFrame:
        """seq, repo, n, part: the references that each put carries, by key."""
        return self.edge_keys.join(self.orders.select("n", F.unix_timestamp("at").alias("_s")), "n").select((F.col("_s") * SEQ_SCALE + F.col("n")).alias("seq"), "repo", "n", "part")

    @cached_property
    def bench(self) -> DataFrame:
        """rep, registry, metric, value: line items as repetitions by line number, supplier class as registry, flag as metric."""
        li = self.table("lineitem")
        registry = F.element_at(F.array(F.lit("log"), F.lit("lmdb"), F.lit("other")), (F.col("l_suppkey") % 3 + 1).cast("int"))
        return li.groupBy(F.col("l_linenumber").alias("rep"), registry.alias("registry"), F.col("l_returnflag").alias("metric")).agg(F.avg("l_quantity").alias("value"))

    def rows(self, values: list[tuple], schema: str) -> DataFrame:
        """A small literal table."""
        return self.spark.createDataFrame(values, schema)
