"""Rate limits: token buckets over a request log."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass
class Bucket:
    """Starts full, refills at rate a second up to burst; a request takes one token or is told when to come back."""

    rate: float
    burst: float
    tokens: float
    at: float

    def take(self, now: float) -> tuple[bool, int]:
        self.tokens = min(self.burst, self.tokens + max(0.0, now - self.at) * self.rate)
        self.at = max(self.at, now)
        if self.tokens >= 1:
            self.tokens -= 1
            return True, 0
        return False, -int(-(1 - self.tokens) // self.rate) if self.rate > 0 else 1 << 31


DECISION = "key string, seq long, at double, admitted boolean, retry_after long"


def decisions(requests: DataFrame, limits: dict[str, tuple[float, float]], default: tuple[float, float] | None = None) -> DataFrame:
    """requests: key, seq, at (seconds). Adds admitted and retry_after: one bucket a key, with the key's (rate, burst), else
    the default; a key without either is unlimited. A refused request takes nothing, so it is a fold in order of time."""

    def fold(batches):
        import pandas as pd

        key, bucket = None, None
        for frame in batches:
            ok, after = [], []
            for k, now in zip(frame["key"], frame["at"]):
                if k != key:
                    key, spec = k, limits.get(k, default)
                    bucket = Bucket(spec[0], spec[1], spec[1], now) if spec else None
                admitted, wait = bucket.take(now) if bucket else (True, 0)
                ok.append(admitted)
                after.append(wait)
            yield pd.DataFrame({"key": frame["key"], "seq": frame["seq"], "at": frame["at"], "admitted": ok, "retry_after": after})

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"))
    return rows.repartition("key").sortWithinPartitions("key", "at", "seq").mapInPandas(fold, DECISION)


def by_method(requests: DataFrame, limits: dict[str, tuple[float, float]], default: tuple[float, float] | None = None) -> DataFrame:
    """requests: method, seq, at. All requests without a limit of their own share the default bucket."""
    key = F.when(F.col("method").isin(list(limits)), F.col("method")).otherwise(F.lit("*"))
    return decisions(requests.withColumn("key", key), limits | ({"*": default} if default else {}))


def cache_hits(requests: DataFrame, budget: int, most: int) -> DataFrame:
    """requests: worker, seq, key, size. Adds hit: a least-recently-used cache a worker, for values up to most bytes, within
    a budget of bytes (key, value and 128 for the entry)."""
    schema = T.StructType([*requests.select("worker", "seq", "key", "size").schema.fields, T.StructField("hit", T.BooleanType())])

    def fold(batches):
        from collections import OrderedDict

        worker, cache, used = None, OrderedDict(), 0
        for frame in batches:
            hits = []
            for w, key, size in zip(frame["worker"], frame["key"], frame["size"]):
                if w != worker:
                    worker, cache, used = w, OrderedDict(), 0
                hits.append(key in cache)
                if key in cache:
                    cache.move_to_end(key)
                elif size <= most:
                    cache[key] = len(str(key)) + size + 128
                    used += cache[key]
                    while used > budget:
                        used -= cache.popitem(last=False)[1]
            yield frame.assign(hit=hits)

    return requests.select("worker", "seq", "key", "size").repartition("worker").sortWithinPartitions("worker", "seq").mapInPandas(fold, schema)


def credential(user: Column, password: Column) -> Column:
    """What a login is remembered by, so that no password moves or is kept."""
    return F.sha2(F.concat(user, F.lit("\0"), password), 256)


def credential_hits(logins: DataFrame, ttl: int, capacity: int = 4096) -> DataFrame:
    """logins: worker, seq, at, credential, valid (what the user directory would say). Adds hit: the credential was accepted
    less than ttl ago and is remembered still. Each worker remembers accepted ones only, forgets one that is found expired,
    and forgets all when another is to be kept beside capacity of them; hits don't prolong. A ttl of 0 remembers nothing.
    One fold a worker in order of at and seq (nulls first), which holds capacity entries; a null valid is a refusal, a null
    credential or at is never remembered."""
    names = ["worker", "seq", "at", "credential", "valid"]
    rows = logins.select(*names).withColumn("valid", F.coalesce("valid", F.lit(False)) & F.col("credential").isNotNull() & F.col("at").isNotNull())
    schema = T.StructType([*rows.schema.fields, T.StructField("hit", T.BooleanType())])

    def fold(batches):
        worker, until = None, {}
        for frame in batches:
            hits = []
            for w, at, key, valid in zip(frame["worker"], frame["at"], frame["credential"], frame["valid"]):
                if w != worker:
                    worker, until = w, {}
                hit = key in until and until[key] > at
                hits.append(hit)
                if not hit:
                    until.pop(key, None)
                    if valid and ttl > 0:
                        if len(until) >= capacity:
                            until.clear()
                        until[key] = at + ttl
            yield frame.assign(hit=hits)

    return rows.repartition("worker").sortWithinPartitions("worker", "at", "seq").mapInPandas(fold, schema)


def required_action(method: Column, path: Column) -> Column:
    """pull, push or delete that a request needs on its repository; null for paths without one."""
    from quayside.functions.paths import parse_path

    kind = parse_path(path)["kind"]
    return (
        F.when(kind.isin("blob", "manifest") & method.isin("GET", "HEAD") | kind.isin("tags", "referrers") & (method == "GET"), "pull")
        .when((kind == "uploads") & (method == "POST") | (kind == "upload") & method.isin("GET", "PATCH", "PUT") | (kind == "manifest") & (method == "PUT"), "push")
        .when(kind.isin("blob", "manifest") & (method == "DELETE"), "delete")
    )
