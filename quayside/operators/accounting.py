"""Quota, sessions and admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quayside.operators.ordered import running_floor, running_sum


def usage(blobs: DataFrame) -> DataFrame:
    """repo, bytes: what each repository holds, and in the row of a null repo the sum of all. Shared blobs count in each."""
    return blobs.rollup("repo").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def running_usage(writes: DataFrame) -> DataFrame:
    """writes: repo, seq, size. Adds used: the repository's bytes after each write, all writes admitted."""
    return running_sum(writes, ["repo"], "seq", "size", "used").withColumn("used", F.col("used").cast("long"))


def admission(writes: DataFrame, repo_cap: int) -> DataFrame:
    """writes: repo, seq, size. Adds admitted and used. A write is admitted if used + size <= cap (0: no cap); a rejected
    one doesn't count, so this is a fold in order of seq, one pass over each repository's sorted rows."""
    schema = T.StructType([*writes.select("repo", "seq", "size").schema.fields, T.StructField("admitted", T.BooleanType()), T.StructField("used", T.LongType())])

    def fold(batches):
        import pandas as pd

        repo, used = None, 0
        for frame in batches:
            ok, total = [], []
            for r, size in zip(frame["repo"], frame["size"]):
                if r != repo:
                    repo, used = r, 0
                fits = repo_cap == 0 or used + size <= repo_cap
                used += size * fits
                ok.append(bool(fits))
                total.append(used)
            yield pd.DataFrame({"repo": frame["repo"], "seq": frame["seq"], "size": frame["size"], "admitted": ok, "used": total})

    return writes.select("repo", "seq", "size").repartition("repo").sortWithinPartitions("repo", "seq").mapInPandas(fold, schema)


def total_admission(writes: DataFrame, total_cap: int) -> DataFrame:
    """The same under one cap for all repositories. Every decision depends on all before it, so the fold is one task by
    nature; only seq and size go through it."""
    one = writes.select(F.lit("").alias("repo"), "seq", "size").coalesce(1)
    return writes.join(admission(one, total_cap).drop("repo", "size"), "seq")


def capped_admission(writes: DataFrame, repo_cap: int, total_cap: int) -> DataFrame:
    """writes: repo, seq, size. Adds refused_by: `repository`, `total` or null where the write is admitted; the repository's cap
    is asked first, and a refused write is charged to neither. 0 is no cap.

    Under a total cap every decision depends on all before it, so it is one fold in order of seq that holds a number a
    repository. Where all writes together stay within the total cap it can refuse nothing, and repositories fold apart."""
    schema = T.StructType([*writes.select("repo", "seq", "size").schema.fields, T.StructField("refused_by", T.StringType())])
    if total_cap == 0 or (writes.agg(F.sum("size")).first()[0] or 0) <= total_cap:
        return admission(writes, repo_cap).select("repo", "seq", "size", F.when(~F.col("admitted"), "repository").alias("refused_by"))

    def fold(batches):
        used, total = {}, 0
        for frame in batches:
            verdicts = []
            for repo, size in zip(frame["repo"], frame["size"]):
                own = used.get(repo, 0)
                over = "repository" if repo_cap and own + size > repo_cap else "total" if total + size > total_cap else None
                if over is None:
                    used[repo], total = own + size, total + size
                verdicts.append(over)
            yield frame.assign(refused_by=verdicts)

    return writes.select("repo", "seq", "size").coalesce(1).sortWithinPartitions("seq").mapInPandas(fold, schema)


def release(used: DataFrame, freed: DataFrame) -> DataFrame:
    """used: repo, bytes; freed: repo, size. What stays: never under 0, nothing for an unknown repository, no row at 0."""
    sums = freed.groupBy("repo").agg(F.sum("size").alias("_freed"))
    left = F.greatest(F.col("bytes") - F.coalesce("_freed", F.lit(0)), F.lit(0))
    return used.join(sums, "repo", "left").withColumn("bytes", left.cast("long")).drop("_freed").filter("bytes > 0")


def sessions(events: DataFrame) -> DataFrame:
    """events: repo, seq, delta (+1 begins, -1 ends). Adds active: the sessions open after each event, never under 0."""
    return running_floor(events, ["repo"], "seq", "delta", "active").withColumn("active", F.col("active").cast("long"))


def admitted_sessions(events: DataFrame, cap: int) -> DataFrame:
    """events: seq, delta. Adds admitted and active under one cap (0: none) for all sessions of the server: a begin beyond it
    is refused and changes nothing, an end is always admitted. Each decision depends on all before it, so this is one fold in
    order of seq, and only seq and delta go through it."""

    def fold(batches):
        import pandas as pd

        active = 0
        for frame in batches:
            ok, open_ = [], []
            for delta in frame["delta"]:
                fits = delta < 0 or cap == 0 or active < cap
                active = max(0, active + int(delta) * fits)
                ok.append(bool(fits))
                open_.append(active)
            yield pd.DataFrame({"seq": frame["seq"], "delta": frame["delta"], "admitted": ok, "active": open_})

    rows = events.select(F.col("seq").cast("long").alias("seq"), F.col("delta").cast("int").alias("delta"))
    return rows.coalesce(1).sortWithinPartitions("seq").mapInPandas(fold, "seq long, delta int, admitted boolean, active long")


def upload_offsets(chunks: DataFrame) -> DataFrame:
    """chunks: session, seq, offset, size. Adds accepted: the chunk starts where the accepted ones before it end, as a
    fold in order; others are refused and change nothing."""
    schema = T.StructType([*chunks.select("session", "seq", "offset", "size").schema.fields, T.StructField("accepted", T.BooleanType())])

    def fold(batches):
        session, end = None, 0
        for frame in batches:
            ok = []
            for s, offset, size in zip(frame["session"], frame["offset"], frame["size"]):
                if s != session:
                    session, end = s, 0
                ok.append(bool(offset == end))
                end += size * ok[-1]
            yield frame.assign(accepted=ok)

    return chunks.select("session", "seq", "offset", "size").repartition("session").sortWithinPartitions("session", "seq").mapInPandas(fold, schema)
