"""Request paths, repository names and path components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A component of a repository name, and the most bytes of a name.
COMPONENT = r"[a-z0-9]+(?:(?:\.|__|_|-+)[a-z0-9]+)*"
MAX_NAME = 255


def is_repo_name(name: Column) -> Column:
    return F.coalesce(name.rlike(f"^{COMPONENT}(?:/{COMPONENT})*$") & (F.octet_length(name) <= MAX_NAME), F.lit(False))


def is_safe_component(part: Column) -> Column:
    """A file name that can't leave its folder: not empty, `.` or `..`, and without slashes, backslashes or NUL."""
    return F.coalesce(~part.rlike(r"^\.{0,2}$|[/\\\x00]"), F.lit(False))


def parse_path(path: Column) -> Column:
    """STRUCT<kind, repo, reference> of a path under /v2/. The verb is looked for at the right end, so a repository's name
    may contain verbs. kind: blob, manifest, tags, referrers, uploads, upload, unknown."""
    rest = F.regexp_extract(path, r"^/v2/(.*)$", 1)
    parts = F.split(rest, "/")
    n = F.size(parts)
    at = lambda k: F.coalesce(F.try_element_at(parts, F.lit(-k)), F.lit(""))
    name = lambda k: F.array_join(F.slice(parts, 1, F.greatest(n - k, F.lit(0))), "/")
    made = lambda kind, k, ref: F.struct(F.lit(kind).alias("kind"), name(k).alias("repo"), ref.alias("reference"))
    none = F.lit(None).cast("string")
    return (
        F.when((n >= 3) & (at(3) == "blobs") & (at(2) == "uploads"), F.when(at(1) == "", made("uploads", 3, none)).otherwise(made("upload", 3, at(1))))
        .when((n >= 2) & (at(2) == "blobs") & (at(1) == "uploads"), made("uploads", 2, none))
        .when((n >= 2) & (at(2) == "blobs"), made("blob", 2, at(1))).when((n >= 2) & (at(2) == "manifests"), made("manifest", 2, at(1)))
        .when((n >= 2) & (at(2) == "tags") & (at(1) == "list"), made("tags", 2, none)).when((n >= 2) & (at(2) == "referrers"), made("referrers", 2, at(1)))
        .otherwise(F.struct(F.lit("unknown").alias("kind"), none.alias("repo"), none.alias("reference")))
    )


def endpoint(path: Column) -> Column:
    """A label of few values for metrics. Any path that ends in tags/<x> counts as tags, though only tags/list is served."""
    last = lambda v: path.rlike(f"^/v2/(?:.*/)?{v}/[^/]*$")
    return (
        F.when(path.isin("/livez", "/readyz"), "health").when(path.isin("/v2", "/v2/"), "base")
        .when(path.rlike(r"^/v2/(?:.*/)?blobs/uploads(?:/[^/]*)?$"), "uploads").when(last("blobs"), "blobs").when(last("manifests"), "manifests").when(last("tags"), "tags").when(last("referrers"), "referrers").otherwise("other")
    )


def status_class(status: Column) -> Column:
    """2xx, 3xx, 4xx; everything else is 5xx, 1xx included."""
    return F.when(status.between(200, 299), "2xx").when(status.between(300, 399), "3xx").when(status.between(400, 499), "4xx").otherwise("5xx")


def quarantine_name(repo: Column, digest: Column, stamp: Column) -> Column:
    """The file name under which a corrupt blob is set aside."""
    return F.concat_ws("---", F.replace(repo, F.lit("/"), F.lit("__")), F.translate(digest, ":", "_"), stamp.cast("string"))


def entry_cost(key: Column, size: Column) -> Column:
    """Bytes that a cached value counts: key, value and 128 for the entry."""
    return F.octet_length(key) + size + 128
