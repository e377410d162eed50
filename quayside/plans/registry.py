"""Registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quayside.plans.fixture import DELETE_AFTER_S, MEDIA_TYPES, METHODS, SEQ_SCALE, Model

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_media = "CASE n % 3 WHEN 0 THEN '{}' WHEN 1 THEN '{}' ELSE '{}' END".format(*MEDIA_TYPES)
_method = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METHODS.items()) + " ELSE 'GET' END"

#: The model of fixture.py in SQL; a view may use those before it.
VIEWS = {
    "orders_": "SELECT o_orderkey AS n, o_custkey AS customer, o_orderstatus AS status, o_orderdate AS at_, o_orderpriority AS kind, lower(r_name) || '/' || replace(lower(n_name), '_', '-') || '/' || lower(c_mktsegment) AS repo FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "manifests": f"SELECT repo, 'sha256:' || sha256('order-' || n) AS digest, {_media} AS media_type, n, status FROM orders_",
    "tags": "SELECT repo, 'v' || n AS tag, digest, media_type FROM manifests WHERE status <> 'P'",
    "edges": "SELECT DISTINCT repo, 'sha256:' || sha256('order-' || n) AS manifest, 'sha256:' || sha256('part-' || l_partkey) AS blob, n, status, l_partkey AS part FROM lineitem JOIN orders_ ON l_orderkey = n",
    "blobs": "SELECT DISTINCT repo, blob AS digest, CAST(p_size AS BIGINT) * 1024 AS size FROM edges JOIN part p ON p.p_partkey = edges.part",
    "referrers": "SELECT repo, 'sha256:' || sha256('order-' || before) AS subject, 'sha256:' || sha256('order-' || n) AS referrer, kind AS artifact_type FROM (SELECT *, lag(n) OVER (PARTITION BY customer ORDER BY at_, n) AS before FROM orders_) WHERE before IS NOT NULL",
    "contents": "SELECT source AS repo, 'sha256:' || sha256(text) AS digest, CAST(octet_length(encode(text)) AS BIGINT) AS size, doc_id AS seq, text AS content FROM documents",
    "requests": f"SELECT event_id AS seq, ts AS at_, user_id AS client, {_method} AS method, value / 1000 AS seconds, CASE WHEN event_id % 97 = 0 THEN 500 WHEN event_id % 13 = 0 THEN 404 WHEN event_id % 29 = 0 THEN 304 ELSE 200 END AS status FROM events",
    "log": f"""SELECT CAST(epoch(at_) AS BIGINT) * {SEQ_SCALE} + n AS seq, 'put_manifest' AS op, repo, 'sha256:' || sha256('order-' || n) AS digest, {_media} AS media_type, CASE WHEN status <> 'P' THEN 't' || (n % 50) END AS tag, NULL::BIGINT AS crc, NULL::BIGINT AS size, n FROM orders_
        UNION ALL SELECT CAST(epoch(at_) AS BIGINT) * {SEQ_SCALE} + n, 'put_checksum', repo, 'sha256:' || sha256('order-' || n), NULL, NULL, n * 7 % 4294967296, n * 10, n FROM orders_ WHERE n % 2 = 0
        UNION ALL SELECT (CAST(epoch(at_) AS BIGINT) + {DELETE_AFTER_S}) * {SEQ_SCALE} + n, 'delete_manifest', repo, 'sha256:' || sha256('order-' || n), NULL, NULL, NULL, NULL, n FROM orders_ WHERE status = 'F'""",
    "bench": "SELECT l_linenumber AS rep, CASE l_suppkey % 3 WHEN 0 THEN 'log' WHEN 1 THEN 'lmdb' ELSE 'other' END AS registry, l_returnflag AS metric, avg(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "summaries": "SELECT metric, registry, median(value) AS median, min(value) AS least, max(value) AS most, count(*) AS n, CASE WHEN count(*) > 1 AND avg(value) <> 0 THEN stddev_samp(value) / abs(avg(value)) * 100 ELSE 0 END AS cv FROM bench GROUP BY 1, 2",
}


def sql(body: str, *views: str) -> str:
    """body with the views it names, and those that they name, before it."""
    need: set[str] = set()

    def add(name: str) -> None:
        for v in VIEWS:
            if v != name and v in VIEWS[name].replace(",", " ").replace("(", " ").replace(")", " ").replace(".", " ").split() and v not in need and list(VIEWS).index(v) < list(VIEWS).index(name):
                add(v)
        need.add(name)

    for v in views:
        add(v)
    with_ = ", ".join(f"{v} AS ({VIEWS[v]})" for v in VIEWS if v in need)
    extra = body.lstrip()
    if extra.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_}, {extra[len('WITH RECURSIVE ') :]}" if with_ else extra
    if extra.upper().startswith("WITH "):
        return f"WITH {with_}, {extra[len('WITH ') :]}" if with_ else extra
    return f"WITH {with_} {extra}" if with_ else extra


def query(name: str, body: str | None = None, *views: str):
    """Registers a function of the model under name, with its SQL."""

    def put(f: Callable[[Model], DataFrame]) -> Callable[[Model], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
        if body is not None:
            SQL[name] = sql(body, *views)
        return f

    return put
