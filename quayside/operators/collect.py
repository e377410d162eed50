"""Reachability and garbage collection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.digests import is_digest
from quayside.shared import written

#: Fixed value: the most bytes of a manifest that is read to find references.
MAX_MANIFEST_BYTES = 4 * 1024 * 1024


def candidates(blobs: DataFrame, edges: DataFrame, manifests: DataFrame, roots: DataFrame | None = None, unsafe_repos: DataFrame | None = None) -> DataFrame:
    """Blobs that no manifest of their repository refers to and that are no manifest or root there. A blob can be
    garbage in one repository and live in another. Repositories that couldn't be read are left alone."""
    key = ["repo", "digest"]
    out = blobs.join(edges.select("repo", F.col("blob").alias("digest")), key, "left_anti").join(manifests.select(*key), key, "left_anti")
    if roots is not None:
        out = out.join(roots.select(*key), key, "left_anti")
    if unsafe_repos is not None:
        out = out.join(unsafe_repos.select("repo"), "repo", "left_anti")
    return out


def sweep_totals(due: DataFrame) -> DataFrame:
    """repo, blobs, bytes of what a sweep would free."""
    return due.groupBy("repo").agg(F.count("*").alias("blobs"), F.sum("size").cast("long").alias("bytes"))


def reachable(roots: DataFrame, links: DataFrame, depth: int = 64) -> DataFrame:
    """node, hops: everything that links (parent, child) lead to from roots (node), with the least number of steps.

    A frontier moves one step a round and loses what was seen, so cycles end; the loop on the driver is over depth, not
    data. Each frontier is written to the shared folder, which keeps every round's plan short and lets it survive lost
    executors. Rounds stop at the first empty frontier; more than depth rounds is an error."""
    front = seen = written(roots.select("node").distinct().withColumn("hops", F.lit(0)))
    for hop in range(1, depth + 1):
        step = front.select(F.col("node").alias("parent")).join(links, "parent").select(F.col("child").alias("node")).distinct()
        front = written(step.join(seen.select("node"), "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            return seen
        seen = seen.unionAll(front)
    raise ValueError(f"links are more than {depth} deep")


def stale_uploads(uploads: DataFrame, now: Column, delay_s: int) -> DataFrame:
    """Unlocked upload sessions whose last change is at least delay_s ago."""
    return uploads.filter(~F.col("locked") & (F.unix_timestamp(now) - F.unix_timestamp("changed_at") >= delay_s))


class Rebuilt(NamedTuple):
    """edges (repo, manifest, blob): recorded and found ones; roots (repo, digest): manifests that only indexes or other
    manifests name; unsafe (repo): where something couldn't be read, so that nothing there may be collected."""

    edges: DataFrame
    roots: DataFrame
    unsafe: DataFrame


def _digests(document: Column, field: str) -> Column:
    """The digests of the descriptors in an array of a document; what isn't a descriptor is passed over."""
    found = F.try_variant_get(document, f"$.{field}", "array<variant>")
    return F.coalesce(F.transform(found, lambda d: F.try_variant_get(d, "$.digest", "string")), F.array().cast("array<string>"))


def _digest(document: Column, field: str) -> Column:
    return F.array(F.try_variant_get(document, f"$.{field}.digest", "string"))


def rebuild_backrefs(indexes: DataFrame, manifests: DataFrame, edges: DataFrame, bodies: DataFrame) -> Rebuilt:
    """What a registry refers to when its log is incomplete: a walk from recorded manifests and index entries through the
    children of manifests.

    indexes: repo, body; manifests: repo, digest; edges: repo, manifest, blob; bodies: repo, digest, size, content (binary
    or text). A repository is unsafe if its index, or a manifest on the walk, is missing, larger than MAX_MANIFEST_BYTES or
    no JSON; a repository without an index isn't. Entries that are no digests are passed over; digests count in lower case.
    Repeated rows count once.

    Each body up to the limit is read and parsed once, and only its digests are stored; the walk then moves digests alone.
    A body that can't be parsed leaves no row, just like one that is missing. JSON with repeated keys counts as unreadable."""
    listed = indexes.select("repo", F.try_parse_json("body").alias("_v"))
    unread = listed.filter("_v IS NULL").select("repo").distinct()
    named = listed.select("repo", F.explode(_digests(F.col("_v"), "manifests")).alias("digest"))
    starts = manifests.select("repo", "digest").unionByName(named).filter(is_digest("digest")).withColumn("digest", F.lower("digest"))
    starts = starts.distinct().join(unread, "repo", "left_anti")

    v = F.col("_v")
    small = bodies.filter(F.col("size") <= MAX_MANIFEST_BYTES).select("repo", F.lower("digest").alias("digest"), F.try_parse_json(F.col("content").cast("string")).alias("_v"))
    everything = F.concat(_digest(v, "config"), _digests(v, "layers"), _digests(v, "manifests"), _digest(v, "subject"))
    proper = lambda ds: F.transform(F.filter(ds, is_digest), F.lower)
    parsed = written(small.filter("_v IS NOT NULL").select("repo", "digest", proper(everything).alias("refs"), proper(_digests(v, "manifests")).alias("children")))

    node = lambda name: F.struct("repo", F.col(name).alias("digest"))
    links = parsed.select("repo", "digest", F.explode("children").alias("child")).select(node("digest").alias("parent"), node("child").alias("child"))
    seen = written(reachable(starts.select(node("digest").alias("node")), links).select("node.repo", "node.digest").distinct())
    key = ["repo", "digest"]
    lost = seen.join(parsed.select(*key), key, "left_anti").select("repo")
    found = parsed.join(seen, key, "left_semi").select("repo", F.col("digest").alias("manifest"), F.explode("refs").alias("blob"))
    return Rebuilt(
        edges.select("repo", "manifest", "blob").unionByName(found).distinct(),
        seen.join(manifests.select("repo", F.lower("digest").alias("digest")), key, "left_anti"),
        unread.unionByName(lost).distinct(),
    )


def marks(candidates: DataFrame, marked: DataFrame, now: Column) -> DataFrame:
    """repo, digest, marked_at: the marks after a check. Candidates keep the time of an earlier mark, new ones get now, and
    marks on what is no candidate any more go. candidates: repo, digest; marked: repo, digest, marked_at."""
    return candidates.select("repo", "digest").distinct().join(marked.select("repo", "digest", "marked_at"), ["repo", "digest"], "left").withColumn("marked_at", F.coalesce("marked_at", now))


def touch(marked: DataFrame, wanted: DataFrame, now: Column) -> DataFrame:
    """marked, its grace beginning again where a blob of wanted (repo, digest) is marked; nothing is marked by a touch."""
    asked = wanted.select("repo", "digest").distinct().withColumn("_asked", F.lit(True))
    return marked.join(asked, ["repo", "digest"], "left").withColumn("marked_at", F.when(F.col("_asked"), now).otherwise(F.col("marked_at"))).drop("_asked")


def left_without(deleted: DataFrame, edges: DataFrame, manifests: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """repo, digest: what the deletion of manifests (repo, digest) leaves without a reference and so marks: the manifests
    themselves and the blobs that they alone referred to, but for those that are manifests or roots still."""
    key = ["repo", "digest"]
    gone = deleted.select(*key).distinct()
    by = [edges["repo"] == gone["repo"], edges["manifest"] == gone["digest"]]
    own = edges.join(gone, by, "left_semi").select("repo", F.col("blob").alias("digest"))
    rest = edges.join(gone, by, "left_anti")
    kept = manifests.select(*key).join(gone, key, "left_anti")
    return candidates(own.unionByName(gone).distinct(), rest, kept, roots)
