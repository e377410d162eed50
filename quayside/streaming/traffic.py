"""Request streams: rate-limit decisions with state, and windowed counts (an extension of our own)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quayside.operators.traffic import DECISION, Bucket


def decisions(requests: DataFrame, limits: dict[str, tuple[float, float]], default: tuple[float, float] | None = None) -> DataFrame:
    """requests: key, seq, at, as a stream. The batch operator's decisions, with each key's bucket kept between batches.

    Requests of a key are taken in order of time within a batch; one that comes in a later batch but is older finds the
    bucket as it is and refills nothing. Where the reference would forget the least recent client, a bucket that has
    been idle for an hour is dropped: it would be full again."""

    def step(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spec = limits.get(key[0], default)
        rows = pd.concat(list(frames)).sort_values(["at", "seq"])
        if spec is None:
            yield rows.assign(admitted=True, retry_after=0)[["key", "seq", "at", "admitted", "retry_after"]]
            return
        bucket = Bucket(spec[0], spec[1], *state.get) if state.exists else Bucket(spec[0], spec[1], spec[1], float(rows["at"].iloc[0]))
        taken = [bucket.take(t) for t in rows["at"]]
        state.update((bucket.tokens, bucket.at))
        state.setTimeoutDuration(3_600_000)
        yield rows.assign(admitted=[t[0] for t in taken], retry_after=[t[1] for t in taken])[["key", "seq", "at", "admitted", "retry_after"]]

    rows = requests.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"))
    return rows.groupBy("key").applyInPandasWithState(step, DECISION, "tokens double, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(requests: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Extension. requests: at (timestamp), method, seconds. Counts and mean latency a window and method, final once late
    data of the window is no longer waited for."""
    w = requests.withWatermark("at", late).groupBy(F.window("at", size), "method")
    return w.agg(F.count("*").alias("n"), F.avg("seconds").alias("mean_s")).select(F.col("window.start").alias("begins"), "method", "n", "mean_s")


def stale_sessions(chunks: DataFrame, idle: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """chunks: session, at, size, as a stream. Upload sessions that got nothing for the idle time: begins, ends, bytes."""
    w = chunks.withWatermark("at", late).groupBy(F.session_window("at", idle), "session")
    return w.agg(F.sum("size").alias("bytes")).select("session", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "bytes")
