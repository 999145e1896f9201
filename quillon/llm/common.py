"""What the training-data operators share: tables, folders, vectorised words."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: Bytes of text that one vectorised step looks at; a longer text is one step of its own.
CHUNK_BYTES = 1 << 19
#: Rows and bytes of an Arrow batch between Spark and Python, in place of Spark's 10,000 rows and 64 MB: these buffers lie outside the heap.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Bytes whose words are hashed at once; a longer word is hashed alone.
SPAN_BYTES = 1 << 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder is made and kept
    in the session if all runs on one machine (local masters); on a cluster executors wouldn't see it: ValueError."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("quillon.shared.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("quillon.shared.dir", root)
    return root


def small_batches(spark: SparkSession) -> None:
    """Sets the session's limits of an Arrow batch to BATCH_ROWS and BATCH_BYTES at most; smaller ones of the user stay. No result depends on them."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key))
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back, which cuts its lineage. The files go when the application ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def fold(col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % parts, F.lit(0))


def give_back() -> None:
    """Returns what this worker no longer uses to the system: Python workers live on, and what they keep counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # another C library
        pass


_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], T]) -> T:
    """What this worker keeps from task to task under a key whose first part names its owner; chunks for another owner drops it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each piece stay near limit bytes. Python workers go from one operator's tasks to another's, so
    what the worker keeps for any other owner than `keep` is dropped first."""
    for key in [k for k in _kept if k[0] != keep]:
        del _kept[key]
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        at, done = 0, 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, end - at)
            at, done = end, int(size[end - 1])
        give_back()


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, and where each begins (and the last ends). Null: empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if at else np.zeros(1, np.int64)
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BYTE[_SPACE] = 0
_BASE = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2 ** 64, for i below n; kept for spans, not for longer words."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        made.append(np.cumprod(steps))
    if n <= SPAN_BYTES:
        _POWERS[:] = made
    return made[0], made[1]


@dataclass
class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of many texts, with A-Z lower-cased: a 64-bit hash and the
    first byte of each; text i has words first[i] to first[i + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    first: np.ndarray

    def of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    starts = np.flatnonzero(begins)
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return Words(np.zeros(0, np.uint64), starts, first)
    hashes, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):  # in spans of whole words, so that powers stay few
        begin = starts[at]
        end = max(at + 1, int(np.searchsorted(starts, begin + SPAN_BYTES, "right")) - 1)
        end = len(starts) if n - begin <= SPAN_BYTES else end
        span, own = data[begin : starts[end] if end < len(starts) else n], starts[at:end] - begin
        up, down = _powers(len(span))
        hashes[at:end] = np.add.reduceat(_BYTE[span] * up[: len(span)], own) * down[own]
        at = end
    return Words(mix(hashes), starts, first)


_SHINGLE = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words within each text, repeats included, and where each text's begin.
    A text with fewer words has its whole sequence as one; a text without words has none."""
    n = np.diff(w.first)
    total = len(w.hashes)
    out = np.zeros(total, np.uint64)
    for k in range(size):
        out[: total - k] += w.hashes[k:] * _SHINGLE[k]
    keep = np.ones(total, bool)
    last = w.first[1:]
    for k in range(1, size):
        at = last - k
        keep[at[n >= k]] = False
    for i in np.flatnonzero((n > 0) & (n < size)):
        a, b = w.first[i], w.first[i + 1]
        keep[a] = True
        out[a] = (w.hashes[a:b] * _SHINGLE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
    counts = np.where(n >= size, n - size + 1, (n > 0).astype(n.dtype))
    return mix(out[keep]), np.concatenate([[0], np.cumsum(counts)])


def distinct_per_text(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each text, and where each text's begin."""
    parts, sizes = [], np.zeros(len(first) - 1, np.int64)
    for i in range(len(first) - 1):
        own = np.sort(values[first[i] : first[i + 1]])
        if len(own) > 1:
            fresh = np.empty(len(own), bool)
            fresh[0] = True
            np.not_equal(own[1:], own[:-1], out=fresh[1:])
            own = own[fresh]
        parts.append(own)
        sizes[i] = len(own)
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)])


def per_text_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text (0 for a text that has none)."""
    out = np.zeros(len(first) - 1, values.dtype)
    own = np.flatnonzero(np.diff(first))
    if len(own):
        out[own] = np.add.reduceat(values, first[own])
    return out
