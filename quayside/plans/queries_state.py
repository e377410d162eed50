"""The queries: log replay, layouts, policy, integrity, telemetry and benchmark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quayside.functions import digests
from quayside.operators import benchstats, collect, integrity, layout, policy, replay, telemetry
from quayside.plans.fixture import Model, digest
from quayside.plans.registry import query

_GONE = "NOT EXISTS (SELECT 1 FROM log d WHERE d.repo = {0}.repo AND d.digest = {0}.digest AND d.op = 'delete_manifest' AND d.seq > {0}.seq)"
_TAGS = f"SELECT repo, tag, digest, media_type FROM (SELECT *, row_number() OVER (PARTITION BY repo, tag ORDER BY seq DESC) AS k FROM log WHERE op = 'put_manifest' AND tag IS NOT NULL) p WHERE k = 1 AND {_GONE.format('p')}"
_MANIFESTS = f"SELECT repo, digest, media_type FROM (SELECT *, row_number() OVER (PARTITION BY repo, digest ORDER BY seq DESC) AS k FROM log WHERE op = 'put_manifest') p WHERE k = 1 AND {_GONE.format('p')}"
_EDGES = "SELECT DISTINCT repo, manifest, blob FROM edges WHERE status <> 'F'"
_SUMS = f"SELECT repo, digest, crc, size FROM log p WHERE op = 'put_checksum' AND {_GONE.format('p')}"


# --- log -------------------------------------------------------------------------------------------------------------


@query("wal_replay_tags", _TAGS, "log")
def wal_replay_tags(m: Model) -> DataFrame:
    return replay.tags(m.log)


@query("wal_replay_manifests", _MANIFESTS, "log")
def wal_replay_manifests(m: Model) -> DataFrame:
    return replay.manifests(m.log)


def _edges(m: Model) -> DataFrame:
    """The replay of references runs on keys; the digests of what is left come after."""
    log = m.log.select("seq", "op", "repo", F.col("n").alias("digest"))
    left = replay.edges(log, m.log_references.select("seq", "repo", F.col("n").alias("manifest"), F.col("part").alias("blob")))
    return left.select("repo", digest("order-", "manifest").alias("manifest"), digest("part-", "blob").alias("blob"))


@query("wal_cascade_edges", _EDGES, "edges")
def wal_cascade_edges(m: Model) -> DataFrame:
    return _edges(m)


@query("wal_replay_checksums", _SUMS, "log")
def wal_replay_checksums(m: Model) -> DataFrame:
    return replay.checksums(m.log)


@query("wal_replay_referrers", "SELECT r.repo, r.subject, r.referrer, r.artifact_type FROM referrers r JOIN manifests m ON m.repo = r.repo AND m.digest = r.referrer WHERE m.status <> 'F'", "referrers", "manifests")
def wal_replay_referrers(m: Model) -> DataFrame:
    # put at the time 0, so that every deletion comes after it
    puts = m.referrers.select(F.lit(0).cast("long").alias("seq"), F.lit("put_referrer").alias("op"), "repo", F.col("referrer").alias("digest"), "subject", "artifact_type")
    gone = m.log.filter("op = 'delete_manifest'").select("seq", "op", "repo", "digest", F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("artifact_type"))
    return replay.referrers(puts.unionByName(gone))


@query("wal_valid_prefix", "SELECT repo, seq, op FROM log l WHERE NOT EXISTS (SELECT 1 FROM log b WHERE b.repo = l.repo AND b.n % 1009 = 5 AND b.seq <= l.seq)", "log")
def wal_valid_prefix(m: Model) -> DataFrame:
    return replay.valid_prefix(m.log.select("repo", "seq", "op", (F.col("n") % 1009 != 5).alias("ok")), ["repo"]).select("repo", "seq", "op")


@query("untagged_manifests", f"SELECT repo, digest, media_type FROM ({_MANIFESTS}) m WHERE NOT EXISTS (SELECT 1 FROM ({_TAGS}) t WHERE t.repo = m.repo AND t.digest = m.digest)", "log")
def untagged_manifests(m: Model) -> DataFrame:
    return replay.untagged(replay.manifests(m.log), replay.tags(m.log))


@query("compact_image", f"""WITH t AS ({_TAGS}), mf AS ({_MANIFESTS}) SELECT 'put_manifest' AS op, repo, digest, tag, media_type, NULL AS other, NULL AS extra FROM t
    UNION ALL SELECT 'put_manifest', repo, digest, NULL, media_type, NULL, NULL FROM mf WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.repo = mf.repo AND t.digest = mf.digest)
    UNION ALL SELECT 'put_backrefs', repo, manifest, NULL, NULL, blob, NULL FROM ({_EDGES}) UNION ALL SELECT 'put_referrer', repo, referrer, NULL, NULL, subject, artifact_type FROM referrers
    UNION ALL SELECT 'put_checksum', repo, digest, NULL, NULL, CAST(crc AS VARCHAR), CAST(size AS VARCHAR) FROM ({_SUMS})""", "log", "edges", "referrers")  # fmt: skip
def compact_image(m: Model) -> DataFrame:
    return replay.compact(replay.manifests(m.log), replay.tags(m.log), _edges(m), m.referrers, replay.checksums(m.log))


@query("engine_diff", f"WITH a AS ({_TAGS}), b AS (SELECT * FROM a WHERE substr(digest, 8, 1) <> '0') SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)", "log")
def engine_diff(m: Model) -> DataFrame:
    a = replay.tags(m.log)
    return replay.difference(a, a.filter(F.substring("digest", 8, 1) != "0"))


# --- layouts ---------------------------------------------------------------------------------------------------------


def _indexes(m: Model) -> DataFrame:
    """repo, body: an index document for each repository, of the references of its orders in order of their keys."""
    entry = F.struct(F.lit(layout.DEFAULT_MEDIA_TYPE).alias("mediaType"), digest("order-", "n").alias("digest"), (F.col("n") * 10).alias("size"), F.col("kind").alias("artifactType"),
                     F.create_map(F.lit(layout.REF_NAME), F.concat(F.lit("t"), (F.col("n") % 40).cast("string"))).alias("annotations"),
                     F.when(F.expr("n % 3 = 1"), F.struct(digest("order-", "before").alias("digest"))).alias("subject"))
    rows = m.orders.withColumn("before", F.col("n") - 1).select("repo", "n", entry.alias("e"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("n", F.to_json("e").alias("e")))), lambda x: x["e"])
    return rows.groupBy("repo").agg(F.concat(F.lit('{"schemaVersion":2,"manifests":['), F.array_join(ordered, ","), F.lit("]}")).alias("body"))


_D = "'sha256:' || sha256('order-' || {})"


@query("layout_tags", "SELECT DISTINCT repo, 't' || (n % 40) AS tag FROM orders_", "orders_")
def layout_tags(m: Model) -> DataFrame:
    return layout.tags(_indexes(m))


@query("layout_referrers", f"SELECT repo, {_D.format('(n - 1)')} AS subject, {_D.format('n')} AS digest, kind AS artifact_type FROM orders_ WHERE n % 3 = 1", "orders_")
def layout_referrers(m: Model) -> DataFrame:
    return layout.referrers(_indexes(m))


@query("import_foreign_tags", f"SELECT repo, tag, {_D.format('n')} AS digest, 'application/vnd.oci.image.manifest.v1+json' AS media_type FROM (SELECT repo, 't' || (n % 40) AS tag, max(n) AS n FROM orders_ GROUP BY 1, 2) f WHERE NOT EXISTS (SELECT 1 FROM ({_TAGS}) t WHERE t.repo = f.repo AND t.tag = f.tag)", "log", "orders_")
def import_foreign_tags(m: Model) -> DataFrame:
    return layout.foreign_tags(_indexes(m), replay.tags(m.log))


@query("index_rebuild", f"""WITH t AS ({_TAGS}), mf AS ({_MANIFESTS}), parts AS (SELECT repo, 0 AS part, tag, digest, media_type FROM t
    UNION ALL SELECT repo, 1, NULL, digest, media_type FROM mf WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.repo = mf.repo AND t.digest = mf.digest)
    UNION ALL SELECT repo, 2, 't' || (n % 40), {_D.format('n')}, 'application/vnd.oci.image.manifest.v1+json' FROM orders_ o WHERE NOT EXISTS (SELECT 1 FROM mf WHERE mf.repo = o.repo AND mf.digest = {_D.format('o.n')}))
    SELECT p.repo, p.part, p.tag, p.digest, p.media_type, o.n * 10 AS size FROM parts p JOIN manifests o ON o.repo = p.repo AND o.digest = p.digest""", "log", "manifests")  # fmt: skip
def index_rebuild(m: Model) -> DataFrame:
    none = m.manifests.limit(0).select("repo", "digest", F.lit(0).cast("long").alias("size"))
    return layout.rebuild(_indexes(m), replay.tags(m.log), replay.manifests(m.log), none)


@query("manifest_references", """SELECT repo, manifest, blob FROM edges UNION ALL SELECT repo, 'sha256:' || sha256('order-' || n), 'sha256:' || sha256('config-' || n) FROM (SELECT DISTINCT repo, n FROM edges)
    UNION ALL SELECT repo, 'sha256:' || sha256('order-' || n), 'sha256:' || sha256('order-' || (n - 1)) FROM (SELECT DISTINCT repo, n FROM edges) WHERE n % 5 = 0""", "edges")  # fmt: skip
def manifest_references(m: Model) -> DataFrame:
    layers = F.transform("parts", lambda p: F.struct(F.concat(F.lit("sha256:"), F.upper(F.sha2(F.concat(F.lit("part-"), p.cast("string")), 256))).alias("digest")))
    bad = F.array(F.struct(F.lit("md5:0123").alias("digest")), F.struct(F.lit(None).cast("string").alias("digest")))
    rows = m.edge_keys.groupBy("repo", "n").agg(F.collect_list("part").alias("parts")).withColumn("before", F.col("n") - 1)
    body = F.to_json(F.struct(F.struct(digest("config-", "n").alias("digest")).alias("config"), F.concat(layers, bad).alias("layers"), F.when(F.expr("n % 5 = 0"), F.struct(digest("order-", "before").alias("digest"))).alias("subject")))
    return layout.references(rows.select("repo", digest("order-", "n").alias("digest"), body.alias("body")))


@query("referrers_fallback", f"""WITH asked AS (SELECT repo, {_D.format('n')} AS subject, n FROM orders_) SELECT a.repo, a.subject, r.referrer, 'index' AS via FROM asked a JOIN referrers r ON r.repo = a.repo AND r.subject = a.subject
    UNION ALL SELECT repo, subject, unnest([{_D.format("(n + 1)")}, {_D.format("(n + 2)")}]), 'tag' FROM asked a WHERE n % 20 = 0 AND NOT EXISTS (SELECT 1 FROM referrers r WHERE r.repo = a.repo AND r.subject = a.subject)""", "orders_", "referrers")  # fmt: skip
def referrers_fallback(m: Model) -> DataFrame:
    keys = m.orders.withColumn("a", F.col("n") + 1).withColumn("b", F.col("n") + 2)
    asked = keys.select("repo", digest("order-", "n").alias("subject"))
    listed = keys.filter("n % 20 = 0").select("repo", digest("order-", "n").alias("subject"), digest("list-", "n").alias("digest"), F.to_json(F.struct(F.array(F.struct(digest("order-", "a").alias("digest")), F.struct(digest("order-", "b").alias("digest"))).alias("manifests"))).alias("body"))
    tags = listed.select("repo", layout.fallback_tag("subject").alias("tag"), "digest")
    return layout.referrers_or_fallback(asked, m.referrers, tags, listed.select("repo", "digest", "body"))


_WALK = f"""RECURSIVE chain AS (SELECT repo, n, status, lag(n) OVER (PARTITION BY customer ORDER BY at_, n) AS before FROM orders_), bad AS (SELECT DISTINCT repo FROM orders_ WHERE n % 5003 = 77),
    walk AS (SELECT repo, n, before FROM chain WHERE status <> 'F' AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.repo = chain.repo)
        UNION SELECT c.repo, c.n, c.before FROM walk w JOIN chain c ON c.n = w.before WHERE w.n % 3 = 1 AND w.n % 4001 <> 7),
    lost AS (SELECT repo FROM bad UNION SELECT repo FROM walk WHERE n % 4001 = 7)"""


def _rebuilt(m: Model) -> collect.Rebuilt:
    """The log knows pending orders and no reference; the indexes name open ones. Every third order is an index whose child is
    the customer's order before. Some orders have no body, and some make their repository's index unreadable."""
    w = Window.partitionBy("customer").orderBy("at", "n")
    chain = m.orders.select("repo", "n", "status", F.lag("n").over(w).alias("before"))
    parts = m.edge_keys.groupBy("n").agg(F.transform(F.collect_list("part"), lambda p: F.struct(F.concat(F.lit("sha256:"), F.sha2(F.concat(F.lit("part-"), p.cast("string")), 256)).alias("digest"))).alias("layers"))
    child = F.when(F.expr("n % 3 = 1 AND before IS NOT NULL"), F.array(F.struct(digest("order-", "before").alias("digest"))))
    body = F.to_json(F.struct("layers", child.alias("manifests")))
    bodies = chain.filter("n % 4001 <> 7").join(parts, "n", "left").select("repo", digest("order-", "n").alias("digest"), body.alias("content")).withColumn("size", F.octet_length("content"))
    entry = F.when(F.col("status") == "O", F.struct(digest("order-", "n").alias("digest")))
    lists = chain.groupBy("repo").agg(F.to_json(F.struct(F.collect_list(entry).alias("manifests"))).alias("body"), F.max(F.expr("n % 5003 = 77")).alias("torn"))
    indexes = lists.select("repo", F.when(F.col("torn"), F.substring("body", 1, 20)).otherwise(F.col("body")).alias("body"))
    recorded = m.manifests.filter("status = 'P'").select("repo", "digest")
    return collect.rebuild_backrefs(indexes, recorded, m.edges().limit(0), bodies)


@query("gc_rebuilt_candidates", f"WITH {_WALK} SELECT repo, digest FROM blobs b WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN walk w ON w.n = e.n WHERE e.repo = b.repo AND e.blob = b.digest) AND repo NOT IN (SELECT repo FROM lost)", "blobs", "orders_")
def gc_rebuilt_candidates(m: Model) -> DataFrame:
    found = _rebuilt(m)
    recorded = m.manifests.filter("status = 'P'")
    return collect.candidates(m.blobs.select("repo", "digest"), found.edges, recorded, found.roots, found.unsafe)


@query("gc_unsafe_repos", f"WITH {_WALK} SELECT DISTINCT repo FROM lost", "orders_")
def gc_unsafe_repos(m: Model) -> DataFrame:
    return _rebuilt(m).unsafe


@query("gc_roots", f"WITH {_WALK} SELECT DISTINCT repo, {_D.format('n')} AS digest FROM walk w WHERE (SELECT status FROM orders_ o WHERE o.n = w.n) <> 'P'", "orders_")
def gc_roots(m: Model) -> DataFrame:
    return _rebuilt(m).roots


@query("gc_left_without", f"SELECT DISTINCT repo, blob AS digest FROM edges e WHERE status = 'F' AND NOT EXISTS (SELECT 1 FROM edges k WHERE k.repo = e.repo AND k.blob = e.blob AND k.status <> 'F') UNION SELECT repo, digest FROM manifests WHERE status = 'F'", "edges", "manifests")
def gc_left_without(m: Model) -> DataFrame:
    """What the deletion of all finished orders leaves."""
    return collect.left_without(m.manifests.filter("status = 'F'"), m.edges(), m.manifests)


# --- policy ----------------------------------------------------------------------------------------------------------

RULES = [(0, "**", 0, 1), (1, "asia/**", 1, 1), (2, "*/nation-1/*", 0, 3), (3, "**/machinery", 1, 3), (4, "europe/nation-3/furniture", 0, 7), (5, "america/*/building", 1, 1), (6, "america/*/b*", 0, 2), (7, "africa/nation-*/**", 1, 2)]
POLICIES = [(1, ["u1"], ["ops"], 2), (2, [], ["dev"], 4), (3, ["u2", "u3"], [], 4), (7, ["u1"], ["dev"], 4), (0, [], ["ops"], 2)]
GROUPS = [("dev", "u3"), ("dev", "u4"), ("ops", "u4")]
ADMINS = [("root",)]
USERS = [None, "u1", "u2", "u3", "u4", "u5", "root"]
#: The rules' patterns as the SQL side spells them.
_RX = ["^.*$", "^asia/.*$", "^[^/]*/nation-1/[^/]*$", "^(.*/)?machinery$", "^europe/nation-3/furniture$", "^america/[^/]*/building$", "^america/[^/]*/b[^/]*$", "^africa/nation-[^/]*/.*$"]
_LITERALS, _STARS = [0, 5, 10, 9, 25, 17, 10, 15], [1, 1, 2, 1, 0, 1, 2, 2]
_RULES_SQL = "rules(rule, rx, lit, stars, anon, auth) AS (VALUES " + ", ".join(f"({r[0]}, '{x}', {a}, {b}, {r[2]}, {r[3]})" for r, x, a, b in zip(RULES, _RX, _LITERALS, _STARS)) + ")"
_WON = "won AS (SELECT repo, (SELECT rule FROM rules WHERE regexp_matches(repo, rx) ORDER BY lit DESC, stars, rule LIMIT 1) AS rule FROM (SELECT DISTINCT repo FROM orders_))"


@query("policy_winning_rule", f"WITH {_RULES_SQL}, {_WON} SELECT repo, rule FROM won", "orders_")
def policy_winning_rule(m: Model) -> DataFrame:
    return policy.winning_rules(m.orders.select("repo").distinct(), [(r[0], r[1]) for r in RULES])


_NAMED = "named(rule, usr, bits) AS (VALUES " + ", ".join(f"({r}, '{u}', {a})" for r, users, groups, a in POLICIES for u in sorted({*users, *(x for g, x in GROUPS if g in groups)})) + ")"
_USERS = "users(usr) AS (VALUES " + ", ".join("(NULL)" if u is None else f"('{u}')" for u in USERS) + ")"


@query("policy_grants", f"""WITH {_RULES_SQL}, {_WON}, {_NAMED}, {_USERS} SELECT usr AS "user", repo, rule, CASE WHEN usr = 'root' THEN 7 WHEN usr IS NULL THEN anon
    ELSE anon | auth | coalesce((SELECT bit_or(bits) FROM named n WHERE n.rule = won.rule AND n.usr = users.usr), 0) END AS actions FROM won JOIN rules USING (rule), users""", "orders_")  # fmt: skip
def policy_grants(m: Model) -> DataFrame:
    repos = m.orders.select("repo").distinct()
    asked = repos.withColumn("user", F.explode(F.array(*[F.lit(u).cast("string") for u in USERS]))).select("user", "repo")
    rules = m.rows([(r[0], r[2], r[3]) for r in RULES], "rule int, anonymous int, authenticated int")
    policies = m.rows(POLICIES, "rule int, users array<string>, groups array<string>, actions int")
    won = policy.winning_rules(repos, [(r[0], r[1]) for r in RULES])
    return policy.grants(asked, won, rules, policies, m.rows(GROUPS, "name string, user string"), m.rows(ADMINS, "user string"))


@query("token_grants", """SELECT seq, CASE WHEN seq % 3 = 0 THEN 'a/b' WHEN seq % 3 = 1 THEN 'a' ELSE 'c' END AS repo, CASE WHEN method IN ('GET', 'HEAD') THEN 'pull' WHEN method = 'PUT' THEN 'push' ELSE 'delete' END AS action,
    (seq % 3 = 0 AND method IN ('GET', 'HEAD', 'PUT')) OR (seq % 3 = 2 AND method NOT IN ('GET', 'HEAD', 'PUT')) AS granted FROM requests""", "requests")  # fmt: skip
def token_grants(m: Model) -> DataFrame:
    entry = lambda name, *actions: F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, actions)).alias("actions"))
    repo = F.element_at(F.array(F.lit("a/b"), F.lit("a"), F.lit("c")), (F.col("seq") % 3 + 1).cast("int"))
    action = F.when(F.col("method").isin("GET", "HEAD"), "pull").when(F.col("method") == "PUT", "push").otherwise("delete")
    asked = m.requests.select("seq", repo.alias("repo"), action.alias("action"), F.array(entry("a/b", "pull"), entry("a/b", "push"), entry("c", "delete")).alias("entries"))
    return policy.token_grants(asked).drop("entries")


# --- integrity -------------------------------------------------------------------------------------------------------


def _scrubbed(m: Model) -> DataFrame:
    """Documents as blobs, some with a wrong digest, some without or with a wrong record. The fast checksum is the head of
    a hash here, as the SQL side knows no CRC-32C; that one is tested by known answers."""
    c = m.contents.withColumn("digest", F.when(F.expr("seq % 11 = 3"), digest("wrong-", "seq")).otherwise(F.col("digest"))).withColumn("repo", F.concat_ws("/", "repo", F.col("seq").cast("string")))
    fast = F.substring(F.sha2("content", 256), 1, 8)
    recorded = c.filter("seq % 5 <> 0").select("repo", "digest", F.when(F.expr("seq % 7 = 0"), "00000000").otherwise(fast).alias("crc"), "size")
    blobs = c.select("repo", "digest", "content")
    return integrity.classify(blobs, recorded, fast, F.octet_length("content"))


_CLASS = "CASE WHEN seq % 5 <> 0 AND seq % 7 <> 0 THEN 'ok' WHEN seq % 11 = 3 THEN 'corrupt' WHEN seq % 5 = 0 THEN 'ok' ELSE 'repaired' END"


@query("scrub_classify", f"SELECT repo || '/' || seq AS repo, CASE WHEN seq % 11 = 3 THEN 'sha256:' || sha256('wrong-' || seq) ELSE digest END AS digest, {_CLASS} AS result FROM contents", "contents")
def scrub_classify(m: Model) -> DataFrame:
    return _scrubbed(m).select("repo", "digest", "result")


@query("scrub_summary", f"SELECT {_CLASS} AS result, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM contents GROUP BY 1", "contents")
def scrub_summary(m: Model) -> DataFrame:
    return integrity.summary(_scrubbed(m), F.octet_length("content"))


@query("digest_verify", "SELECT seq, CASE WHEN size > 100000 THEN 'too large' WHEN seq % 13 = 0 THEN 'invalid digest' WHEN seq % 17 = 0 THEN 'mismatch' ELSE 'accepted' END AS verdict FROM contents", "contents")
def digest_verify(m: Model) -> DataFrame:
    claimed = F.when(F.expr("seq % 13 = 0"), F.concat(F.lit("md5:"), F.md5("content"))).when(F.expr("seq % 17 = 0"), digest("x", "seq")).when(F.expr("seq % 3 = 0"), digests.digest_of("content", "sha512")).otherwise(F.upper(F.col("digest")))
    claimed = F.regexp_replace(claimed, "^SHA256", "sha256")
    return integrity.verify(m.contents.select("seq", claimed.alias("digest"), "content"), 100_000).select("seq", "verdict")


@query("crc32c_documents")
def crc32c_documents(m: Model) -> DataFrame:
    return m.contents.select("repo", "digest", digests.crc32c_col(F.col("content").cast("binary")).alias("crc"), "size")


# --- telemetry -------------------------------------------------------------------------------------------------------


def _status_class() -> Column:
    from quayside.functions.paths import status_class

    return status_class(F.col("status"))


_CLS = "CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 300 AND 399 THEN '3xx' WHEN status BETWEEN 400 AND 499 THEN '4xx' ELSE '5xx' END"


def _buckets(rel: str, by: str, value: str, bounds: list[float]) -> str:
    les = "(VALUES " + ", ".join(f"(CAST({b} AS DOUBLE))" for b in bounds) + ", (NULL)) AS b(le)"
    return f"SELECT {by}, le, count(*) FILTER (WHERE le IS NULL OR {value} <= le) AS n, round(sum({value}), 6) AS total, count(*) AS samples FROM {rel}, {les} GROUP BY ALL"


@query("latency_histogram", _buckets(f"(SELECT method, {_CLS} AS class, seconds FROM requests)", "method, class", "seconds", telemetry.LATENCY_BOUNDS), "requests")
def latency_histogram(m: Model) -> DataFrame:
    rows = m.requests.select("method", _status_class().alias("class"), "seconds")
    return telemetry.histogram(rows, ["method", "class"], "seconds", telemetry.LATENCY_BOUNDS).withColumn("total", F.round("total", 6))


@query("wal_batch_histogram", _buckets("(SELECT batch % 4 AS part, CAST(n AS DOUBLE) AS n_ FROM (SELECT seq // 7 AS batch, count(*) * (1 + seq // 7 % 40) AS n FROM requests GROUP BY 1))", "part", "n_", telemetry.BATCH_BOUNDS).replace("count(*) * (1 + seq // 7 % 40) AS n FROM requests GROUP BY 1", "count(*) * (1 + (seq // 7) % 40) AS n FROM requests GROUP BY seq // 7"), "requests")
def wal_batch_histogram(m: Model) -> DataFrame:
    batches = m.requests.select(F.expr("seq div 7").alias("batch")).groupBy("batch").agg(F.count("*").alias("n"))
    rows = batches.select((F.col("batch") % 4).alias("part"), (F.col("n") * (1 + F.col("batch") % 40)).cast("double").alias("n_"))
    return telemetry.histogram(rows, ["part"], "n_", telemetry.BATCH_BOUNDS)


@query("counters_by_label", f"SELECT method, {_CLS} AS class, count(*) AS n, CAST(sum(client) AS BIGINT) AS amount FROM requests GROUP BY 1, 2", "requests")
def counters_by_label(m: Model) -> DataFrame:
    return telemetry.counters(m.requests.withColumn("class", _status_class()), ["method", "class"], F.col("client"))


@query("counter_monotonic", """SELECT method, seq, CAST(raw + sum(lost) OVER (PARTITION BY method ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total
    FROM (SELECT *, CASE WHEN raw < lag(raw) OVER (PARTITION BY method ORDER BY seq) THEN lag(raw) OVER (PARTITION BY method ORDER BY seq) ELSE 0 END AS lost FROM (SELECT method, seq, seq % 500 AS raw FROM requests))""", "requests")  # fmt: skip
def counter_monotonic(m: Model) -> DataFrame:
    return telemetry.monotone(m.requests.select("method", "seq", (F.col("seq") % 500).alias("raw")), ["method"], "seq", "raw").select("method", "seq", F.col("total").cast("long").alias("total"))


@query("phase_metrics", """WITH spans(phase, begins, ends) AS (VALUES ('idle', 0, 999), ('push', 1000, 4999), ('pull', 5000, 9000), ('none', 1000000000, 1000000001)), s AS (SELECT method AS series, seq AS t, client * 10 AS rss, seq * 3 AS cpu FROM requests)
    SELECT m.series, p.phase, CASE WHEN count(s.t) >= 2 THEN arg_max(s.cpu, s.t) - arg_min(s.cpu, s.t) END AS cpu_used, CASE WHEN count(s.t) >= 2 THEN max(s.rss) END AS peak_rss
    FROM (SELECT DISTINCT series FROM s) m CROSS JOIN spans p LEFT JOIN s ON s.series = m.series AND s.t BETWEEN p.begins AND p.ends GROUP BY 1, 2""", "requests")  # fmt: skip
def phase_metrics(m: Model) -> DataFrame:
    samples = m.requests.select(F.col("method").alias("series"), F.col("seq").alias("t"), (F.col("client") * 10).alias("rss"), (F.col("seq") * 3).alias("cpu"))
    spans = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(a).alias("begins"), F.lit(b).alias("ends")) for p, a, b in (("idle", 0, 999), ("push", 1000, 4999), ("pull", 5000, 9000), ("none", 10**9, 10**9 + 1))])
    return telemetry.phases(samples, samples.select("series").distinct().select("series", F.inline(spans)))


@query("latency_percentiles", "SELECT method, quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.9) AS p90, quantile_disc(seconds, 0.99) AS p99 FROM requests GROUP BY 1", "requests")
def latency_percentiles(m: Model) -> DataFrame:
    return telemetry.nearest_rank(m.requests, ["method"], "seconds", [50, 90, 99])


@query("latency_percentiles_rounded", "SELECT method, list_sort(list(seconds))[1 + CAST(floor(0.5 * (count(*) - 1) + 0.5) AS BIGINT)] AS p50, list_sort(list(seconds))[1 + CAST(floor(0.99 * (count(*) - 1) + 0.5) AS BIGINT)] AS p99 FROM requests GROUP BY 1", "requests")
def latency_percentiles_rounded(m: Model) -> DataFrame:
    return telemetry.rounded_rank(m.requests, ["method"], "seconds", [50, 99])


# --- benchmark statistics --------------------------------------------------------------------------------------------


def _rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("bench_summary", "SELECT metric, registry, round(median, 6) AS median, round(least, 6) AS least, round(most, 6) AS most, n, round(cv, 6) AS cv FROM summaries", "summaries")
def bench_summary(m: Model) -> DataFrame:
    return _rounded(benchstats.summary(m.bench), "median", "least", "most", "cv")


@query("bench_compare", "SELECT a.metric, a.registry, round(a.median / b.median, 6) AS ratio, a.least <= b.most AND b.least <= a.most AS overlaps, greatest(a.cv, b.cv) > 10 AS unstable FROM summaries a JOIN summaries b ON a.metric = b.metric AND b.registry = 'log' WHERE a.registry <> 'log'", "summaries")
def bench_compare(m: Model) -> DataFrame:
    return _rounded(benchstats.compare(benchstats.summary(m.bench), "log"), "ratio")


@query("bench_gaps", """WITH w AS (SELECT metric, registry, median * CASE WHEN registry = 'log' THEN 1 WHEN metric = 'N' THEN 1.05 WHEN metric = 'R' THEN 1.25 ELSE 0.75 END AS median FROM summaries),
    o AS (SELECT metric, registry, median, row_number() OVER (PARTITION BY metric ORDER BY CASE WHEN metric = 'A' THEN median ELSE -median END, registry) AS k FROM w WHERE registry <> 'log')
    SELECT a.metric, round(a.median, 6) AS ours, round(o.median, 6) AS best, o.registry AS competitor, round(CASE WHEN a.median = 0 THEN 'inf'::DOUBLE ELSE o.median / a.median END, 6) AS ratio,
        round(CASE WHEN a.metric = 'A' THEN CASE WHEN o.median = 0 THEN 'inf'::DOUBLE ELSE a.median / o.median END WHEN a.median = 0 THEN 'inf'::DOUBLE ELSE o.median / a.median END, 6) AS factor
    FROM w a JOIN o ON o.metric = a.metric AND k = 1 WHERE a.registry = 'log' AND CASE WHEN a.metric = 'A' THEN o.median < a.median * 0.9 ELSE o.median > a.median * 1.1 END""", "summaries")  # fmt: skip
def bench_gaps(m: Model) -> DataFrame:
    wide = m.bench.withColumn("value", F.col("value") * F.when(F.col("registry") == "log", 1.0).when(F.col("metric") == "N", 1.05).when(F.col("metric") == "R", 1.25).otherwise(0.75))
    return _rounded(benchstats.gaps(benchstats.summary(wide), "log", F.col("metric") == "A"), "ours", "best", "ratio", "factor")


@query("metrics_delta", """WITH a AS (SELECT method, status, count(*) AS n, sum(seconds) AS total FROM requests GROUP BY 1, 2), b AS (SELECT method, status, count(*) AS n, sum(seconds) AS total FROM requests WHERE seq < 5000 AND status <> 304 GROUP BY 1, 2)
    SELECT method, status, a.n - coalesce(b.n, 0) AS n, round(a.total - coalesce(b.total, 0), 6) AS total FROM a LEFT JOIN b USING (method, status) WHERE a.n > coalesce(b.n, 0)""", "requests")  # fmt: skip
def metrics_delta(m: Model) -> DataFrame:
    snap = lambda df: df.groupBy("method", "status").agg(F.count("*").alias("n"), F.sum("seconds").alias("total"))
    return _rounded(benchstats.delta(snap(m.requests.filter("seq < 5000 AND status <> 304")), snap(m.requests), ["method", "status"]), "total")


_STEPS = "steps AS (SELECT method AS endpoint, (seq // 200) * 100 + 100 AS rps, ((seq // 200) * 100 + 100) * (1 - 0.001 * (seq // 200)) AS rate, max(seconds) * 1000 / 30 AS p99, count(*) FILTER (WHERE status < 500 OR method = 'GET') * 1.0 / count(*) AS share FROM requests GROUP BY ALL)"


@query("max_sustained_rps", f"WITH {_STEPS}, j AS (SELECT *, share = 1 AND p99 <= 20 AND rate >= 0.95 * rps AS ok FROM steps) SELECT endpoint, coalesce(max(rps) FILTER (WHERE ok AND rps < (SELECT coalesce(min(rps), 1000000000) FROM j b WHERE b.endpoint = j.endpoint AND NOT b.ok)), 0) AS max_rps FROM j GROUP BY 1", "requests")
def max_sustained_rps(m: Model) -> DataFrame:
    step = F.expr("seq div 200")
    rows = m.requests.select("method", step.alias("k"), "seconds", ((F.col("status") < 500) | (F.col("method") == "GET")).alias("good"))
    rps = F.col("k") * 100 + 100
    steps = rows.groupBy("method", "k").agg((F.max("seconds") * 1000 / 30).alias("p99_ms"), (F.count_if("good") / F.count("*")).alias("status_share"))
    return benchstats.sustained(steps.select(F.col("method").alias("endpoint"), rps.alias("rps"), (rps * (1 - 0.001 * F.col("k"))).alias("rate"), "p99_ms", "status_share"))


_LEAF3 = "CASE seq % 3 WHEN 0 THEN 'sha256_block' WHEN 1 THEN 'tokio::poll' ELSE 'mdb_get' END"


@query("profile_top_frames", f"""WITH s AS (SELECT 'serve_' || lower(method) AS middle, {_LEAF3} AS leaf, client + 1 AS n FROM requests), own AS (SELECT leaf AS frame, sum(n) AS self FROM s GROUP BY 1),
    every AS (SELECT frame, sum(n) AS inclusive FROM (SELECT 'main' AS frame, n FROM s UNION ALL SELECT middle, n FROM s UNION ALL SELECT leaf, n FROM s) GROUP BY 1)
    SELECT frame, CAST(coalesce(self, 0) AS BIGINT) AS self, CAST(inclusive AS BIGINT) AS inclusive, round(100.0 * coalesce(self, 0) / (SELECT sum(n) FROM s), 6) AS self_pct
    FROM every LEFT JOIN own USING (frame) ORDER BY self DESC, inclusive DESC, frame LIMIT 15""", "requests")  # fmt: skip
def profile_top_frames(m: Model) -> DataFrame:
    frames = F.array(F.lit("main"), F.concat(F.lit("serve_"), F.lower("method")), F.when(F.expr("seq % 3 = 0"), "sha256_block").when(F.expr("seq % 3 = 1"), "tokio::poll").otherwise("mdb_get"))
    return _rounded(benchstats.top_frames(m.requests.select(frames.alias("frames"), (F.col("client") + 1).alias("n"))), "self_pct")


LEAVES = ["do_syscall_64_[k]", "sha256_block", "__memcpy_avx", "serde_json::de", "rustls::conn", "hyper::proto", "tokio::poll", "quay_serve", "core::fmt", "mdb_get"]
_CLASSES = ["kernel", "hashing", "copy/alloc", "json", "tls", "http", "runtime", "own", "std-other", "other"]


@query("profile_categories", "SELECT category, CAST(sum(n) AS BIGINT) AS n, round(100.0 * sum(n) / (SELECT sum(client + 1) FROM requests), 6) AS pct FROM (SELECT CASE seq % 10 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASSES)) + " END AS category, client + 1 AS n FROM requests) GROUP BY 1", "requests")
def profile_categories(m: Model) -> DataFrame:
    leaf = F.element_at(F.array(*map(F.lit, LEAVES)), (F.col("seq") % 10 + 1).cast("int"))
    return _rounded(benchstats.categories(m.requests.select(F.array(F.lit("main"), leaf).alias("frames"), (F.col("client") + 1).alias("n")), "quay_"), "pct")


@query("metrics_exposition", """SELECT 'registry_http_requests_total' AS name, 'registry_http_requests_total{class="' || class || '",method="' || method || '"} ' || n AS line FROM (SELECT status // 100 || 'xx' AS class, method, count(*) AS n FROM requests GROUP BY 1, 2)
    UNION ALL SELECT 'registry_http_requests_total', '# HELP registry_http_requests_total Requests by method and status class.' || chr(10) || '# TYPE registry_http_requests_total counter'""", "requests")  # fmt: skip
def metrics_exposition(m: Model) -> DataFrame:
    counted = telemetry.counters(m.requests.withColumn("class", _status_class()), ["method", "class"])
    points = counted.select(F.lit("registry.http.requests").alias("name"), F.create_map(F.lit("method"), F.col("method"), F.lit("class"), F.col("class")).alias("labels"), F.col("n").alias("value"))
    return telemetry.exposition(points, "counter", "Requests by method and status class.")


_BOUNDS = [0.025, 0.1, 0.5, 1.0]
_LE = "(VALUES " + ", ".join(f"({b}, '{b:g}')" for b in _BOUNDS) + ", (1e300, '+Inf')) AS bounds(most, le)"


@query("histogram_exposition", f"""WITH s AS (SELECT method, CAST(round(seconds * 1000) AS BIGINT) AS v FROM requests)
    SELECT 'registry_wait' AS name, 'registry_wait_bucket{{method="' || method || '",le="' || le || '"}} ' || count(*) FILTER (v <= most * 1000) AS line FROM s, {_LE} GROUP BY method, le
    UNION ALL SELECT 'registry_wait', 'registry_wait_sum{{method="' || method || '"}} ' || sum(v) FROM s GROUP BY method UNION ALL SELECT 'registry_wait', 'registry_wait_count{{method="' || method || '"}} ' || count(*) FROM s GROUP BY method
    UNION ALL SELECT 'registry_wait', '# HELP registry_wait Waits.' || chr(10) || '# TYPE registry_wait histogram'""", "requests")  # fmt: skip
def histogram_exposition(m: Model) -> DataFrame:
    """Waits in whole milliseconds, so that sums are the same in any order; bounds stand for seconds."""
    waits = m.requests.select("method", F.round(F.col("seconds") * 1000).cast("long").alias("v"))
    hist = telemetry.histogram(waits, ["method"], "v", [b * 1000 for b in _BOUNDS]).withColumn("le", F.col("le") / 1000)
    return telemetry.histogram_exposition(hist.select(F.lit("registry.wait").alias("name"), F.create_map(F.lit("method"), F.col("method")).alias("labels"), "le", "n", "total", "samples"), "Waits.")
