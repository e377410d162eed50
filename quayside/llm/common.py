"""What the operators of this folder share: tables, shared storage and vectorised word access."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.shared import folder as shared_folder

#: Fixed value: the words of every contract are runs of anything but these bytes.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1
#: Fixed value: the most buckets that Spark gives a table by default.
MAX_BUCKETS = 100_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_id(col: str = "doc_id") -> Column:
    """The id to order and compare by; a null id stands after all others."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NO_ID))


def text_key(col: str = "text") -> list[Column]:
    """t1, t2: 128 bits that tell texts apart; null is the empty text."""
    text = F.coalesce(F.col(col), F.lit(""))
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may be gone at exit
        pass


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class _Cleaning:
    """While any write of a session runs, shuffle files go with the query that made them; then its own setting is back."""

    lock = threading.Lock()
    open_: dict[SparkSession, tuple[int, str]] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        with self.lock:
            n, was = self.open_.get(self.spark, (0, self.spark.conf.get(_CLEAN, "false")))
            self.open_[self.spark] = n + 1, was
            self.spark.conf.set(_CLEAN, "true")

    def __exit__(self, *_: object) -> None:
        with self.lock:
            n, was = self.open_.pop(self.spark)
            if n > 1:
                self.open_[self.spark] = n - 1, was
            else:
                self.spark.conf.set(_CLEAN, was)


class Stored:
    """A DataFrame written as Parquet to the shared folder: it cuts the lineage and survives lost executors.

    The shuffle files of the write go when it ends, as nothing can read them any more. drop() deletes the table as soon
    as nothing will read it; the rest goes when the driver exits.

    With keys, it is a table bucketed by them, into as many buckets as the session has shuffle partitions: what joins it on
    the keys comes to its rows, which aren't shuffled again."""

    def __init__(self, df: DataFrame, keys: list[str] | None = None):
        self.spark = df.sparkSession
        self.name = f"quayside_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(self.spark)}/{self.name}"
        self.bucketed = keys is not None
        with _Cleaning(self.spark):
            if keys:
                n = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), MAX_BUCKETS)
                df.write.bucketBy(n, *keys).option("path", self.path).option("compression", "zstd").saveAsTable(self.name)
            else:
                df.write.parquet(self.path)
        self.df = self.spark.table(self.name) if keys else self.spark.read.schema(df.schema).parquet(self.path)
        self._hook = lambda s=self.spark, p=self.path: _delete_quietly(s, p)
        atexit.register(self._hook)

    def drop(self) -> None:
        if self.bucketed:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)
        atexit.unregister(self._hook)


def store(df: DataFrame) -> DataFrame:
    return Stored(df).df


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished phases now rather than at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions_for(spark: SparkSession, rows: int, per_task: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


#: Bytes of the batches in which Spark hands texts to Python, at most; the JVM and the worker each hold a few of them.
BATCH_BYTES = "8m"


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """df.mapInArrow(run, schema) in bounded memory: the session's Arrow batches hold BATCH_BYTES at most, as a count of rows
    bounds nothing where texts are long, and workers, which live on, give back what a task needed."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    m = re.fullmatch(r"(\d+)([kmg]?)b?", conf.get(key, "64m").lower())
    if not m or not 0 < int(m[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2]] <= 8 << 20:
        conf.set(key, BATCH_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return df.mapInArrow(whole, schema)


def text_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows of about most_bytes of text each (a longer single text is a range of its own)."""
    if len(texts) == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64)
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most_bytes:
            yield first, i
            first, total = i, 0
        total += n
    yield first, len(texts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row and the len + 1 borders between them; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_spans(raw: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and len + 1 borders of the texts in words."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(borders), np.int64)
    inside = ~_SPACE[raw]
    fresh = np.empty(n, dtype=bool)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    cuts = borders[(borders > 0) & (borders < n)]
    fresh[cuts] = True
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last[cuts - 1] = True
    starts = np.flatnonzero(inside & fresh)
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, borders)


def _power(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each span, which depends on nothing but these values."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    terms = values.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _power("up", _R, n)
    np.cumsum(terms, out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * _power("down", _R_INV, n + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(raw, starts, ends)
