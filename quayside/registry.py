"""A registry's tables behind one object; every method returns a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.digests import crc32c_col
from quayside.operators import accounting, collect, integrity, layout, lookup, paging, policy, replay, routing
from quayside.sources import layout as layout_source
from quayside.sources import wal


@dataclass
class Registry:
    """root: an image layout tree; log: the records of its metadata log (columns of operators.replay)."""

    spark: SparkSession
    root: str
    log: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, root: str, log_path: str, key: bytes | None = None) -> Registry:
        return cls(spark, root, wal.records(replay.valid_prefix(wal.read(spark, log_path, key), ["path"])))

    def tags(self) -> DataFrame:
        return replay.tags(self.log)

    def manifests(self) -> DataFrame:
        return replay.manifests(self.log)

    def edges(self) -> DataFrame:
        return replay.edges(self.log)

    def referrers(self) -> DataFrame:
        return replay.referrers(self.log)

    def checksums(self) -> DataFrame:
        return replay.checksums(self.log)

    def blobs(self, content: bool = False) -> DataFrame:
        return layout_source.blobs(self.spark, self.root, content)

    def repositories(self) -> DataFrame:
        return paging.catalog(self.manifests(), self.referrers()).unionAll(layout_source.repositories(self.spark, self.root)).distinct()

    def tags_page(self, repo: str, last: str | None = None, n: int | None = None) -> DataFrame:
        return paging.page(self.tags().filter(F.col("repo") == repo), "tag", last, paging.clamp(n))

    def referrers_page(self, repo: str, subject: str, artifact_type: str | None = None, last: str | None = None, n: int | None = None) -> DataFrame:
        return paging.referrers_page(self.referrers(), repo, subject, artifact_type, last, paging.clamp(n))

    def resolve(self, requests: DataFrame) -> DataFrame:
        index_types = layout.entries(layout_source.indexes(self.spark, self.root)).select("repo", "digest", "media_type").dropDuplicates(["repo", "digest"])
        return lookup.resolve_references(requests, self.tags(), self.manifests(), index_types)

    def gc_candidates(self) -> DataFrame:
        """Blobs that neither the log nor the index documents lead to; none of a repository that couldn't be read."""
        bodies = self.blobs(content=True)
        found = collect.rebuild_backrefs(layout_source.indexes(self.spark, self.root), self.manifests(), self.edges(), bodies)
        return collect.candidates(self.blobs(), found.edges, self.manifests(), found.roots, found.unsafe)

    def scrub(self) -> DataFrame:
        return integrity.classify(self.blobs(content=True), self.checksums(), crc32c_col(F.col("content")), F.octet_length("content")).drop("content")

    def quota(self) -> DataFrame:
        return accounting.usage(self.blobs())

    def dedupe(self) -> DataFrame:
        return routing.locate(self.blobs().withColumn("seq", F.col("changed_at")))

    def policy(self, rules: list[tuple[int, str]]) -> DataFrame:
        return policy.winning_rules(self.repositories(), rules)

    def index_documents(self) -> DataFrame:
        sizes = self.blobs().select("repo", "digest", "size")
        return layout.to_index(layout.rebuild(layout_source.indexes(self.spark, self.root), self.tags(), self.manifests(), sizes))

    def compact(self, path: str, generation: int, key: bytes | None = None) -> None:
        wal.write_image(replay.compact(self.manifests(), self.tags(), self.edges(), self.referrers(), self.checksums()), path, generation, key)

    def views(self, prefix: str = "registry_") -> None:
        """Registers the tables for SQL."""
        for name in ("tags", "manifests", "edges", "referrers", "checksums", "blobs"):
            getattr(self, name)().createOrReplaceTempView(f"{prefix}{name}")

    def due(self, marked: DataFrame, now: Column, delay_s: int) -> DataFrame:
        return lookup.due(marked, now, delay_s)
