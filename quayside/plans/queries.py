"""The queries: index reads, paging, joins, collection, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.functions import paths
from quayside.operators import accounting, collect, ingest, lookup, paging, policy, replay, routing, traffic
from quayside.plans.fixture import Model, digest
from quayside.plans.registry import query

REPO = "africa/nation-0/building"
ROUTES = [("africa", "s3-a"), ("africa/nation-0", "s3-b"), ("asia/nation-1", "fs-1"), ("europe", "fs-2"), ("europe/nation-3/furniture", "fs-3"), ("europe/nation", "never"), ("america/nation-1/machinery", "fs-4")]
ROUTES_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ROUTES) + ") AS routes(prefix, backend)"


# --- lookups ---------------------------------------------------------------------------------------------------------


@query("tag_resolve", "SELECT m.repo, 'v' || m.n AS tag, t.digest, t.media_type FROM manifests m LEFT JOIN tags t ON t.repo = m.repo AND t.tag = 'v' || m.n", "tags")
def tag_resolve(m: Model) -> DataFrame:
    return lookup.resolve_tags(m.orders.select("repo", F.concat(F.lit("v"), "n").alias("tag")), m.tags)


@query("media_type_lookup", "SELECT r.repo, r.digest, m.media_type FROM (SELECT repo, 'sha256:' || sha256('order-' || (n * 2)) AS digest FROM orders_) r LEFT JOIN manifests m ON m.repo = r.repo AND m.digest = r.digest", "manifests")
def media_type_lookup(m: Model) -> DataFrame:
    asked = m.orders.select("repo", (F.col("n") * 2).alias("n")).select("repo", digest("order-", "n").alias("digest"))
    return lookup.media_types(asked, m.manifests)


@query("has_referrer", "SELECT repo, digest, EXISTS (SELECT 1 FROM referrers r WHERE r.repo = m.repo AND r.subject = m.digest) AS found FROM manifests m", "manifests", "referrers")
def has_referrer(m: Model) -> DataFrame:
    return lookup.has_referrer(m.manifests.select("repo", "digest"), m.referrers)


@query("backrefs", "SELECT repo, blob, manifest FROM edges", "edges")
def backrefs(m: Model) -> DataFrame:
    return lookup.backrefs(m.edge_keys.select("repo", F.col("part").alias("blob"), F.col("n").alias("manifest"))).select("repo", digest("part-", "blob").alias("blob"), digest("order-", "manifest").alias("manifest"))


@query("backref_counts", "SELECT repo, blob, count(DISTINCT manifest) AS n FROM edges GROUP BY 1, 2", "edges")
def backref_counts(m: Model) -> DataFrame:
    keys = m.edge_keys.select("repo", F.col("part").alias("blob"), F.col("n").alias("manifest"))  # counted by key, hashed after
    return lookup.backref_counts(keys).select("repo", digest("part-", "blob").alias("blob"), "n")


@query("checksum_lookup", """SELECT m.repo, m.digest, c.crc, c.size FROM manifests m LEFT JOIN (SELECT repo, digest, crc, size FROM log l WHERE op = 'put_checksum'
    AND NOT EXISTS (SELECT 1 FROM log d WHERE d.repo = l.repo AND d.digest = l.digest AND d.op IN ('delete_manifest', 'delete_blob') AND d.seq > l.seq)) c ON c.repo = m.repo AND c.digest = m.digest""", "manifests", "log")  # fmt: skip
def checksum_lookup(m: Model) -> DataFrame:
    return lookup.checksums(m.manifests.select("repo", "digest"), replay.checksums(m.log))


@query("blob_exists", """SELECT r.repo, r.digest, b.digest IS NOT NULL AS "exists", b.size FROM (SELECT repo, 'sha256:' || sha256('part-' || (n % 2500)) AS digest FROM orders_) r LEFT JOIN blobs b ON b.repo = r.repo AND b.digest = r.digest""", "blobs")
def blob_exists(m: Model) -> DataFrame:
    asked = m.orders.select("repo", (F.col("n") % 2500).alias("p")).select("repo", digest("part-", "p").alias("digest"))
    recorded = m.blob_keys.filter("part % 2 = 0").select("repo", digest("part-", "part").alias("digest"), "size")
    return lookup.blob_sizes(asked, recorded, m.blobs).select("repo", "digest", "exists", "size")


@query("manifest_resolve", """SELECT r.repo, r.reference, CASE WHEN contains(reference, ':') THEN reference ELSE t.digest END AS digest,
    CASE WHEN contains(reference, ':') OR t.digest IS NOT NULL THEN coalesce(m.media_type, 'application/vnd.oci.image.manifest.v1+json') END AS media_type
    FROM (SELECT repo, CASE WHEN n % 4 = 0 THEN 'sha256:' || sha256('order-' || (n + 4 * (n % 8))) ELSE 'v' || n END AS reference FROM orders_) r
    LEFT JOIN tags t ON t.repo = r.repo AND t.tag = r.reference
    LEFT JOIN manifests m ON m.repo = r.repo AND m.digest = CASE WHEN contains(reference, ':') THEN reference ELSE t.digest END""", "tags")  # fmt: skip
def manifest_resolve(m: Model) -> DataFrame:
    asked = m.orders.withColumn("other", F.expr("n + 4 * (n % 8)")).select("repo", F.when(F.expr("n % 4 = 0"), digest("order-", "other")).otherwise(F.concat(F.lit("v"), "n")).alias("reference"))
    return lookup.resolve_references(asked, m.tags, m.manifests, m.manifests.limit(0)).drop("recorded")


@query("gc_due", "SELECT repo, digest FROM manifests JOIN orders_ USING (repo, n) WHERE date_diff('second', at_, TIMESTAMP '1998-01-01') >= 86400 * 365", "manifests")
def gc_due(m: Model) -> DataFrame:
    marked = m.orders.select("repo", digest("order-", "n").alias("digest"), F.col("at").alias("marked_at"))
    return lookup.due(marked, F.lit("1998-01-01").cast("timestamp"), 86400 * 365).select("repo", "digest")


@query("missing_references", "SELECT DISTINCT repo, manifest, blob FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges b WHERE b.repo = e.repo AND b.part = e.part AND b.part % 3 <> 0)", "edges")
def missing_references(m: Model) -> DataFrame:
    present = m.blob_keys.filter("part % 3 <> 0").select("repo", digest("part-", "part").alias("digest"))
    return lookup.missing_references(m.edges(), present)


@query("required_action", """SELECT seq, method, CASE WHEN seq % 5 IN (0, 1) AND method IN ('GET', 'HEAD') THEN 'pull' WHEN seq % 5 IN (2, 4) AND method = 'GET' THEN 'pull'
    WHEN seq % 5 = 1 AND method = 'PUT' THEN 'push' WHEN seq % 5 = 3 AND method = 'POST' THEN 'push' WHEN seq % 5 IN (0, 1) AND method = 'DELETE' THEN 'delete' END AS action FROM requests""", "requests")  # fmt: skip
def required_action(m: Model) -> DataFrame:
    paths_ = F.array(*[F.lit(f"/v2/{REPO}/{p}") for p in ("blobs/sha256:ab", "manifests/v1", "tags/list", "blobs/uploads/", "referrers/sha256:ab")])
    path = F.element_at(paths_, (F.col("seq") % 5 + 1).cast("int"))
    return m.requests.select("seq", "method", traffic.required_action(F.col("method"), path).alias("action"))


@query("path_parse", r"""SELECT page_id, CASE WHEN path LIKE '%/blobs/uploads' THEN 'uploads' ELSE 'manifest' END AS kind, regexp_replace(path, '^/v2/|/(blobs/uploads|manifests/[^/]*)$', '', 'g') AS repo
    FROM (SELECT page_id, '/v2/' || regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '[^a-z0-9.]', '-', 'g') || CASE WHEN page_id % 2 = 0 THEN '/blobs/uploads' ELSE '/manifests/v' || page_id END AS path FROM pages)""")
def path_parse(m: Model) -> DataFrame:
    host = F.regexp_replace(F.regexp_extract("url", "^https?://([^/]+)", 1), "[^a-z0-9.]", "-")
    end = F.when(F.expr("page_id % 2 = 0"), "/blobs/uploads").otherwise(F.concat(F.lit("/manifests/v"), "page_id"))
    p = paths.parse_path(F.concat(F.lit("/v2/"), host, end))
    return m.table("pages").select("page_id", p["kind"].alias("kind"), p["repo"].alias("repo"))


# --- paging ----------------------------------------------------------------------------------------------------------


@query("tags_page", f"SELECT tag, digest, (SELECT count(*) FROM tags WHERE repo = '{REPO}' AND tag > 'v2') > 20 AS more FROM tags WHERE repo = '{REPO}' AND tag > 'v2' ORDER BY tag LIMIT 20", "tags")
def tags_page(m: Model) -> DataFrame:
    return paging.page(m.tags.filter(F.col("repo") == REPO), "tag", "v2", 20).select("tag", "digest", "more")


@query("tags_first_page_per_repo", "SELECT repo, tag, digest, total > 10 AS more FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tag) AS k, count(*) OVER (PARTITION BY repo) AS total FROM tags) WHERE k <= 10", "tags")
def tags_first_page_per_repo(m: Model) -> DataFrame:
    keys = m.orders.filter("status <> 'P'").select("repo", F.concat(F.lit("v"), "n").alias("tag"), "n")
    return paging.first_pages(keys, ["repo"], "tag", 10).select("repo", "tag", digest("order-", "n").alias("digest"), "more")


@query("referrers_page", "SELECT repo, subject, referrer, total > 1 AS more FROM (SELECT *, row_number() OVER (PARTITION BY repo, artifact_type ORDER BY referrer) AS k, count(*) OVER (PARTITION BY repo, artifact_type) AS total FROM referrers) WHERE k <= 1", "referrers")
def referrers_page(m: Model) -> DataFrame:
    return paging.first_pages(m.referrers, ["repo", "artifact_type"], "referrer", 1).select("repo", "subject", "referrer", "more")


@query("referrers_by_type", "SELECT m.repo, m.digest AS subject, bool_or(r.referrer IS NOT NULL) AS known, count(*) FILTER (WHERE r.artifact_type = '1-URGENT') AS n FROM manifests m LEFT JOIN referrers r ON r.repo = m.repo AND r.subject = m.digest GROUP BY 1, 2", "manifests", "referrers")
def referrers_by_type(m: Model) -> DataFrame:
    asked = m.manifests.select("repo", F.col("digest").alias("subject"), F.lit("1-URGENT").alias("artifact_type"))
    return paging.subject_status(asked, m.referrers).select("repo", "subject", "known", "n")


@query("next_cursor", "SELECT repo, max(tag) AS cursor FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY tag) AS k, count(*) OVER (PARTITION BY repo) AS total FROM tags) WHERE k <= 25 AND total > 25 GROUP BY 1", "tags")
def next_cursor(m: Model) -> DataFrame:
    keys = m.orders.filter("status <> 'P'").select("repo", F.concat(F.lit("v"), "n").alias("tag"))
    return paging.next_cursor(paging.first_pages(keys, ["repo"], "tag", 25), ["repo"], "tag")


@query("repo_catalog", "SELECT repo FROM manifests UNION SELECT repo FROM referrers", "manifests", "referrers")
def repo_catalog(m: Model) -> DataFrame:
    referred = m.orders.select("repo", "customer").groupBy("repo", "customer").count().filter("count > 1")  # a second order refers to the first
    return paging.catalog(m.orders, referred)


@query("manifest_list", f"SELECT digest, media_type FROM manifests WHERE repo = '{REPO}'", "manifests")
def manifest_list(m: Model) -> DataFrame:
    return m.manifests.filter(F.col("repo") == REPO).select("digest", "media_type")


@query("tags_snapshot", "SELECT repo, tag, digest FROM tags", "tags")
def tags_snapshot(m: Model) -> DataFrame:
    return paging.tags_snapshot(m.tags)


@query("referrers_snapshot", "SELECT DISTINCT repo, subject, referrer, artifact_type FROM referrers", "referrers")
def referrers_snapshot(m: Model) -> DataFrame:
    return paging.referrers_snapshot(m.referrers)


@query("scrub_order", "SELECT repo, digest, k AS place_in_repo, row_number() OVER (ORDER BY k, repo) AS position FROM (SELECT repo, digest, row_number() OVER (PARTITION BY repo ORDER BY digest) AS k FROM blobs)", "blobs")
def scrub_order(m: Model) -> DataFrame:
    return paging.scrub_order(m.blobs.select("repo", "digest")).select("repo", "digest", F.col("place_in_repo").cast("long").alias("place_in_repo"), "position")


@query("scrub_adaptive", f"SELECT repo, digest, position, CASE WHEN repo = '{REPO}' THEN 0 ELSE 1 END AS turn FROM (SELECT repo, digest, row_number() OVER (ORDER BY k, repo) AS position FROM (SELECT repo, digest, row_number() OVER (PARTITION BY repo ORDER BY digest) AS k FROM blobs)) WHERE position > 5000", "blobs")
def scrub_adaptive(m: Model) -> DataFrame:
    return paging.adaptive_order(paging.scrub_order(m.blobs.select("repo", "digest")), F.lit(REPO), 5000).select("repo", "digest", "position", "turn")


@query("blob_maybe_present", "SELECT o.repo, 'sha256:' || sha256('part-' || (n % 3000)) AS digest, EXISTS (SELECT 1 FROM blobs b WHERE b.repo = o.repo AND b.digest = 'sha256:' || sha256('part-' || (n % 3000))) AS maybe FROM orders_ o", "blobs", "orders_")
def blob_maybe_present(m: Model) -> DataFrame:
    asked = m.orders.select("repo", (F.col("n") % 3000).alias("n")).select("repo", digest("part-", "n").alias("digest"))
    return lookup.maybe_present(asked, lookup.presence_filter(m.blobs), 1 << 40)


# --- joins and collection --------------------------------------------------------------------------------------------


@query("tag_to_blob_sizes", "SELECT t.repo, t.tag, count(*) AS blobs, CAST(sum(b.size) AS BIGINT) AS bytes FROM tags t JOIN edges e ON e.repo = t.repo AND e.manifest = t.digest JOIN blobs b ON b.repo = e.repo AND b.digest = e.blob GROUP BY 1, 2", "tags", "blobs")
def tag_to_blob_sizes(m: Model) -> DataFrame:
    sizes = m.table("part").select(F.col("p_partkey").alias("part"), (F.col("p_size").cast("long") * 1024).alias("size"))
    kept = m.edge_keys.filter("status <> 'P'").join(sizes, "part")
    return kept.groupBy("repo", F.concat(F.lit("v"), "n").alias("tag")).agg(F.count("*").alias("blobs"), F.sum("size").cast("long").alias("bytes"))


def _garbage(m: Model) -> DataFrame:
    """What is left without a reference once the manifests of finished orders are deleted, by key: the hashes and sizes of
    the few survivors come after the anti-join."""
    blobs = m.edge_keys.select("repo", F.col("part").alias("digest")).distinct()
    live = m.edge_keys.filter("status <> 'F'").select("repo", F.col("part").alias("blob"))
    return collect.candidates(blobs, live, m.orders.limit(0).select("repo", F.col("n").alias("digest")))


@query("gc_candidates", "SELECT repo, digest FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo = b.repo AND e.blob = b.digest AND e.status <> 'F') AND NOT EXISTS (SELECT 1 FROM manifests m WHERE m.repo = b.repo AND m.digest = b.digest)", "blobs", "manifests")
def gc_candidates(m: Model) -> DataFrame:
    return _garbage(m).select("repo", digest("part-", "digest").alias("digest"))


@query("gc_sweep_totals", "SELECT repo, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.repo = b.repo AND e.blob = b.digest AND e.status <> 'F') GROUP BY 1", "blobs")
def gc_sweep_totals(m: Model) -> DataFrame:
    sizes = m.table("part").select(F.col("p_partkey").alias("digest"), (F.col("p_size").cast("long") * 1024).alias("size"))
    return collect.sweep_totals(_garbage(m).join(sizes, "digest"))


@query("reachability", """WITH RECURSIVE links AS (SELECT o_orderkey AS parent, o_orderkey // 3 AS child FROM orders WHERE o_orderkey > 0), walk AS (SELECT o_orderkey AS node, 0 AS hops FROM orders WHERE o_orderkey % 1000 = 999
    UNION ALL SELECT child, hops + 1 FROM walk JOIN links ON parent = node) SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM walk GROUP BY 1""")
def reachability(m: Model) -> DataFrame:
    keys = m.table("orders").select(F.col("o_orderkey").alias("parent"))
    links = keys.filter("parent > 0").select("parent", F.expr("parent div 3").alias("child"))
    return collect.reachable(keys.filter("parent % 1000 = 999").select(F.col("parent").alias("node")), links)


@query("route_longest_prefix", f"SELECT repo, coalesce((SELECT backend FROM {ROUTES_SQL} WHERE o.repo = prefix OR starts_with(o.repo, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1), 'default') AS backend FROM (SELECT DISTINCT repo FROM orders_) o", "orders_")
def route_longest_prefix(m: Model) -> DataFrame:
    return routing.longest_prefix(m.orders.select("repo").distinct(), m.rows(ROUTES, "prefix string, backend string"))


_ROUTED = f"routed AS (SELECT repo, coalesce((SELECT backend FROM {ROUTES_SQL} WHERE o.repo = prefix OR starts_with(o.repo, prefix || '/') ORDER BY length(prefix) DESC LIMIT 1), 'default') AS backend FROM (SELECT DISTINCT repo FROM orders_) o)"


@query("mount_same_backend", f"WITH {_ROUTED} SELECT a.repo AS source, b.repo AS target, a.backend = b.backend AS same FROM routed a JOIN routed b ON split_part(a.repo, '/', 1) = split_part(b.repo, '/', 1) AND a.repo < b.repo", "orders_")
def mount_same_backend(m: Model) -> DataFrame:
    names = m.orders.select("repo", F.split_part("repo", F.lit("/"), F.lit(1)).alias("top")).distinct()
    pairs = names.select(F.col("repo").alias("source"), "top").join(names.select(F.col("repo").alias("target"), "top"), "top").filter("source < target").drop("top")
    return routing.same_backend(pairs, m.rows(ROUTES, "prefix string, backend string"))


@query("mountable", f"""WITH {_ROUTED}, asked AS (SELECT repo AS target, split_part(repo, '/', 1) || '/' || split_part(repo, '/', 2) || '/building' AS source, 'sha256:' || sha256('part-' || (n % 2000)) AS digest FROM orders_)
    SELECT source, target, digest, EXISTS (SELECT 1 FROM blobs b WHERE b.repo = source AND b.digest = asked.digest) AND source NOT LIKE 'asia/%' AND s.backend = t.backend AS ok FROM asked JOIN routed s ON s.repo = source JOIN routed t ON t.repo = target""", "blobs")
def mountable(m: Model) -> DataFrame:
    part = lambda k: F.split_part("repo", F.lit("/"), F.lit(k))
    asked = m.orders.select(F.concat_ws("/", part(1), part(2), F.lit("building")).alias("source"), F.col("repo").alias("target"), (F.col("n") % 2000).alias("p")).select("source", "target", digest("part-", "p").alias("digest"))
    known = m.orders.select(F.col("repo").alias("source")).distinct()
    readable = m.orders.filter("repo NOT LIKE 'asia/%'").select("repo")
    return routing.mountable(asked.join(known, "source"), m.blobs, readable, m.rows(ROUTES, "prefix string, backend string")).select("source", "target", "digest", "ok")


@query("dedupe_canonical", "SELECT digest, arg_min(repo, seq) AS canonical FROM contents GROUP BY 1", "contents")
def dedupe_canonical(m: Model) -> DataFrame:
    return routing.canonical(m.contents.select("repo", "digest", "seq"))


@query("dedupe_locate", "SELECT DISTINCT c.repo, c.digest, f.canonical FROM contents c JOIN (SELECT digest, arg_min(repo, seq) AS canonical FROM contents GROUP BY 1) f ON f.digest = c.digest WHERE c.repo <> f.canonical", "contents")
def dedupe_locate(m: Model) -> DataFrame:
    return routing.locate(m.contents.select("repo", "digest", "seq"))


@query("dedupe_savings", "SELECT CAST(sum(size) AS BIGINT) AS logical_bytes, (SELECT CAST(sum(size) AS BIGINT) FROM (SELECT DISTINCT digest, size FROM contents)) AS stored_bytes FROM (SELECT DISTINCT repo, digest, size FROM contents)", "contents")
def dedupe_savings(m: Model) -> DataFrame:
    return routing.savings(m.contents.select("repo", "digest", "size"))


# --- accounting ------------------------------------------------------------------------------------------------------


@query("quota_usage", "SELECT repo, CAST(sum(size) AS BIGINT) AS bytes FROM blobs GROUP BY repo UNION ALL SELECT NULL, CAST(sum(size) AS BIGINT) FROM blobs", "blobs")
def quota_usage(m: Model) -> DataFrame:
    return accounting.usage(m.blob_keys.select("repo", "size"))


@query("quota_running_usage", "SELECT repo, seq, size, CAST(sum(size) OVER (PARTITION BY repo ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM contents", "contents")
def quota_running_usage(m: Model) -> DataFrame:
    return accounting.running_usage(m.contents.select("repo", "seq", "size"))


_CAP, _TOTAL = 60_000, 150_000
_NUMBERED = "w AS MATERIALIZED (SELECT repo, seq, size, row_number() OVER ({0}ORDER BY seq) AS k FROM contents)"


@query("quota_admission", f"""WITH RECURSIVE {_NUMBERED.format('PARTITION BY repo ')}, fold AS (SELECT repo, seq, size, k, size <= {_CAP} AS admitted, CASE WHEN size <= {_CAP} THEN size ELSE 0 END AS used FROM w WHERE k = 1
    UNION ALL SELECT w.repo, w.seq, w.size, w.k, f.used + w.size <= {_CAP}, CASE WHEN f.used + w.size <= {_CAP} THEN f.used + w.size ELSE f.used END FROM fold f JOIN w ON w.repo = f.repo AND w.k = f.k + 1)
    SELECT repo, seq, size, admitted, used FROM fold""", "contents")
def quota_admission(m: Model) -> DataFrame:
    return accounting.admission(m.contents.select("repo", "seq", "size"), _CAP)


@query("quota_both_caps", f"""WITH RECURSIVE {_NUMBERED.format('')}, fold AS (SELECT CAST(0 AS BIGINT) AS k, MAP {{}}::MAP(VARCHAR, BIGINT) AS own, CAST(0 AS BIGINT) AS total, NULL::VARCHAR AS repo, NULL::BIGINT AS seq, NULL::BIGINT AS size, NULL::VARCHAR AS refused_by
    UNION ALL SELECT k, CASE WHEN verdict IS NULL THEN map_concat(own, MAP([repo], [used + size])) ELSE own END, CASE WHEN verdict IS NULL THEN total + size ELSE total END, repo, seq, size, verdict
    FROM (SELECT *, CASE WHEN used + size > {_CAP} THEN 'repository' WHEN total + size > {_TOTAL} THEN 'total' END AS verdict FROM (SELECT w.k, w.repo, w.seq, w.size, f.own, f.total, coalesce(f.own[w.repo], 0) AS used FROM fold f JOIN w ON w.k = f.k + 1)))
    SELECT repo, seq, size, refused_by FROM fold WHERE k > 0""", "contents")
def quota_both_caps(m: Model) -> DataFrame:
    return accounting.capped_admission(m.contents.select("repo", "seq", "size"), _CAP, _TOTAL)


@query("upload_sessions_capped", """WITH RECURSIVE w AS MATERIALIZED (SELECT event_id AS seq, CASE WHEN user_id % 3 < 2 THEN 1 ELSE -1 END AS delta, row_number() OVER (ORDER BY event_id) AS k FROM events WHERE event_type = 'purchase'),
    fold AS (SELECT CAST(0 AS BIGINT) AS k, NULL::BIGINT AS seq, 0 AS delta, true AS admitted, CAST(0 AS BIGINT) AS active
    UNION ALL SELECT w.k, w.seq, w.delta, w.delta < 0 OR f.active < 40, CASE WHEN w.delta < 0 THEN greatest(f.active - 1, 0) WHEN f.active < 40 THEN f.active + 1 ELSE f.active END FROM fold f JOIN w ON w.k = f.k + 1)
    SELECT seq, delta, admitted, active FROM fold WHERE k > 0""")
def upload_sessions_capped(m: Model) -> DataFrame:
    """Uploads begin with a put of most clients and end with the others'."""
    puts = m.requests.filter("method = 'PUT'").select("seq", F.when(F.expr("client % 3 < 2"), 1).otherwise(-1).alias("delta"))
    return accounting.admitted_sessions(puts, 40)


@query("upload_sessions_running", """SELECT method, seq, CAST(s - least(min(s) OVER (PARTITION BY method ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS active
    FROM (SELECT method, seq, sum(CASE WHEN client % 2 = 0 THEN 1 ELSE -1 END) OVER (PARTITION BY method ORDER BY seq ROWS UNBOUNDED PRECEDING) AS s FROM requests)""", "requests")  # fmt: skip
def upload_sessions_running(m: Model) -> DataFrame:
    events = m.requests.select(F.col("method").alias("repo"), "seq", F.when(F.expr("client % 2 = 0"), 1).otherwise(-1).alias("delta"))
    return accounting.sessions(events).select(F.col("repo").alias("method"), "seq", "active")


def _bucket_sql(key: str, rate: str, burst: str) -> str:
    """Token buckets as a recursion over the requests of a key."""
    return f"""WITH RECURSIVE w AS MATERIALIZED (SELECT {key} AS key, seq, CAST(epoch(at_) AS DOUBLE) AS "at", {rate} AS rate, {burst} AS burst, row_number() OVER (PARTITION BY {key} ORDER BY at_, seq) AS k FROM requests),
    fold AS (SELECT key, k, seq, "at", "at" AS last, burst - CASE WHEN burst >= 1 THEN 1 ELSE 0 END AS tokens, burst >= 1 AS admitted, CAST(CASE WHEN burst >= 1 THEN 0 ELSE ceil((1 - burst) / rate) END AS BIGINT) AS retry_after FROM w WHERE k = 1
    UNION ALL SELECT key, k, seq, "at", greatest(last, "at"), CASE WHEN have >= 1 THEN have - 1 ELSE have END, have >= 1, CAST(CASE WHEN have >= 1 THEN 0 ELSE ceil((1 - have) / rate) END AS BIGINT)
    FROM (SELECT w.*, f.last, least(w.burst, f.tokens + greatest(0.0::DOUBLE, w."at" - f.last) * w.rate) AS have FROM fold f JOIN w ON w.key = f.key AND w.k = f.k + 1))
    SELECT key, seq, "at", admitted, retry_after FROM fold"""  # fmt: skip


@query("rate_limit_decisions", _bucket_sql("CASE WHEN method IN ('PUT', 'DELETE') THEN method ELSE '*' END", "CAST(CASE method WHEN 'PUT' THEN 0.0005 WHEN 'DELETE' THEN 0.0002 ELSE 0.002 END AS DOUBLE)", "CAST(CASE method WHEN 'PUT' THEN 3.0 WHEN 'DELETE' THEN 2.0 ELSE 5.0 END AS DOUBLE)"), "requests")
def rate_limit_decisions(m: Model) -> DataFrame:
    rows = m.requests.select("method", "seq", (F.col("at").cast("double")).alias("at"))
    return traffic.by_method(rows, {"PUT": (0.0005, 3.0), "DELETE": (0.0002, 2.0)}, (0.002, 5.0))


@query("rate_limit_per_client", _bucket_sql("CAST(client AS VARCHAR)", "CAST(0.0001 AS DOUBLE)", "CAST(2.0 AS DOUBLE)"), "requests")
def rate_limit_per_client(m: Model) -> DataFrame:
    rows = m.requests.select(F.col("client").alias("key"), "seq", F.col("at").cast("double").alias("at"))
    return traffic.decisions(rows, {}, (0.0001, 2.0))


@query("cache_simulation", """WITH RECURSIVE w AS MATERIALIZED (SELECT client % 8 AS worker, seq, 'k' || (seq * 31 % 211) AS key, seq % 5000 AS size, row_number() OVER (PARTITION BY client % 8 ORDER BY seq) AS k FROM requests),
    fold AS (SELECT DISTINCT worker, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS key, NULL::BIGINT AS size, false AS hit, []::STRUCT(name VARCHAR, bytes BIGINT)[] AS held FROM w
    UNION ALL SELECT worker, k, seq, key, size, hit, list_filter(held, lambda x, i: coalesce(list_sum(list_transform(held[i:], lambda y: y.bytes)), 0) <= 50000)
    FROM (SELECT worker, k, seq, key, size, hit, CASE WHEN hit THEN list_filter(held, lambda x: x.name <> key) || list_filter(held, lambda x: x.name = key) WHEN size <= 4000 THEN held || [{'name': key, 'bytes': length(key) + size + 128}] ELSE held END AS held
        FROM (SELECT w.*, f.held, len(list_filter(f.held, lambda x: x.name = w.key)) > 0 AS hit FROM fold f JOIN w ON w.worker = f.worker AND w.k = f.k + 1)))
    SELECT worker, seq, key, size, hit FROM fold WHERE k > 0""", "requests")
def cache_simulation(m: Model) -> DataFrame:
    rows = m.requests.select((F.col("client") % 8).alias("worker"), "seq", F.concat(F.lit("k"), (F.col("seq") * 31 % 211).cast("string")).alias("key"), (F.col("seq") % 5000).alias("size"))
    return traffic.cache_hits(rows, 50_000, 4_000)


@query("credential_cache", """WITH RECURSIVE w AS MATERIALIZED (SELECT client % 8 AS worker, seq, seq AS second, sha256(client || chr(0) || seq % 2) AS credential, client % 11 <> 0 AS valid, row_number() OVER (PARTITION BY client % 8 ORDER BY seq) AS k FROM requests),
    fold AS (SELECT DISTINCT worker, CAST(0 AS BIGINT) AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS credential, false AS hit, []::STRUCT(name VARCHAR, until BIGINT)[] AS held FROM w
    UNION ALL SELECT worker, k, seq, credential, hit, CASE WHEN hit THEN held WHEN NOT valid THEN rest WHEN len(rest) >= 12 THEN [{'name': credential, 'until': second + 300}] ELSE rest || [{'name': credential, 'until': second + 300}] END
    FROM (SELECT w.*, f.held, list_filter(f.held, lambda x: x.name <> w.credential) AS rest, len(list_filter(f.held, lambda x: x.name = w.credential AND x.until > w.second)) > 0 AS hit FROM fold f JOIN w ON w.worker = f.worker AND w.k = f.k + 1))
    SELECT worker, seq, credential, hit FROM fold WHERE k > 0""", "requests")
def credential_cache(m: Model) -> DataFrame:
    """Seconds are the request's number; passwords alternate."""
    key = traffic.credential(F.col("client").cast("string"), (F.col("seq") % 2).cast("string"))
    rows = m.requests.select((F.col("client") % 8).alias("worker"), "seq", F.col("seq").alias("at"), key.alias("credential"), (F.col("client") % 11 != 0).alias("valid"))
    return traffic.credential_hits(rows, 300, 12).select("worker", "seq", "credential", "hit")


@query("policy_in_force", """WITH s AS (SELECT seq, CASE WHEN seq < 40 THEN 0 ELSE CAST(ceil(seq / 50.0) AS BIGINT) * 50 END AS since, seq % 3 <> 0 AS valid FROM requests WHERE seq % 350 IN (1, 17, 60, 140)),
    v AS (SELECT since, max(seq) AS version, arg_max(valid, seq) AS valid FROM s GROUP BY 1)
    SELECT seq, version FROM requests ASOF LEFT JOIN (SELECT since, version FROM v WHERE valid) ON seq >= since""", "requests")
def policy_in_force(m: Model) -> DataFrame:
    """Seconds are the request's number; the file is polled every 50, and its first writings are there at the start."""
    files = m.requests.filter("seq % 350 IN (1, 17, 60, 140)").select("seq", F.expr("CASE WHEN seq < 40 THEN 0 ELSE seq END").alias("at"), (F.col("seq") % 3 != 0).alias("valid"))
    return policy.in_force(m.requests.select("seq", F.col("seq").alias("at")), files, 50).select("seq", "version")


@query("upload_verdicts", """SELECT repo, seq, CASE WHEN size > 100000 THEN 'too large' WHEN seq % 13 = 0 THEN 'invalid digest' WHEN seq % 17 = 0 THEN 'mismatch' ELSE 'accepted' END AS verdict FROM contents""", "contents")
def upload_verdicts(m: Model) -> DataFrame:
    claimed = F.when(F.expr("seq % 13 = 0"), "none").when(F.expr("seq % 17 = 0"), digest("x", "seq")).otherwise(F.col("digest"))
    return ingest.put_blobs(m.contents.select("repo", "seq", claimed.alias("digest"), "content"), 100_000).select("repo", "seq", "verdict")
