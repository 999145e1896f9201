"""Harmonic packing: tokenised documents in sequences of bounded length, with little padding and few cuts.

Lengths fall into reciprocal-capacity classes: class k holds lengths above capacity / (k + 1) and up to capacity / k, and a bin of
class k takes exactly k of them, whatever they are. A document gives full sequences first; while its rest is above
capacity / WHOLE, the largest class size capacity // k that fits is cut off; what is left then is a piece as it is. So pieces of
the large classes fill their bins but for fewer than k ids, and those of classes from WHOLE on leave at most one part in
WHOLE + 1 of a bin. Each worker fills the bins of its own partition, in the order of its rows, without any shuffle; it
holds fewer than k pieces a class, that is less than a bin of ids a class. At its end it lays those pieces end to end and cuts
them into full sequences; the last stretch is cut into lengths that are powers of two, which take no padding.

Null and empty texts: the end id alone. Very long texts give many pieces of one row. A null doc_id stays null; repeated rows are
packed once each (their pieces tell apart by sequence and offset). Empty table: no rows. Clashing further columns are not read.
A sequence's number is the partition's number * 2 ** 33 + its number there, so a task that runs again gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_vocabulary
from .common import chunks, small_batches, table
from .op4_bpe import tokenizer_path

CAPACITY = 2048
#: Classes from this one on take pieces as they are.
WHOLE = 16
END_ID = 1
#: ids: little-endian unsigned 32-bit.
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_NAMES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


def cuts(n: int, capacity: int = CAPACITY, whole: int = WHOLE) -> list[int]:
    """The lengths of the pieces of a document of n ids, in its order."""
    out, rest = [capacity] * (n // capacity), n % capacity
    while rest > max(1, capacity // whole):
        size = capacity // -(-capacity // rest)
        out.append(size)
        rest -= size
    return [*out, rest] if rest else out


def powers(n: int) -> list[int]:
    """n as a sum of powers of two, the largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Bins:
    """The open bins of one worker. A piece is (doc_id, start, ids, ids of the document)."""

    def __init__(self, number: int, capacity: int):
        self.next, self.capacity = number << 33, capacity
        self.open: dict[int, list[tuple]] = {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, total in pieces:
            yield doc_id, start, len(ids), ids.tobytes(), total, self.next, offset
            offset += len(ids)
        self.next += 1

    def put(self, piece: tuple) -> Iterator[tuple]:
        """Rows of the bin that this piece fills, if it does."""
        k = self.capacity // len(piece[2])
        held = self.open.setdefault(k, [])
        held.append(piece)
        if len(held) == k:
            self.open[k] = []
            yield from self._sequence(held)

    def rest(self) -> Iterator[tuple]:
        """What is held, end to end: full sequences, then powers of two."""
        held = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        total = sum(len(p[2]) for p in held)
        sizes = [self.capacity] * (total // self.capacity) + powers(total % self.capacity)
        own: list[tuple] = []
        room = 0
        for doc_id, start, ids, all_ids in held:
            at = 0
            while at < len(ids):
                room = room or sizes.pop(0)
                part = ids[at : at + room]
                own.append((doc_id, start + at, part, all_ids))
                at, room = at + len(part), room - len(part)
                if not room:
                    yield from self._sequence(own)
                    own = []


def _rows(path: str, capacity: int, whole: int, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    coder, bins = byte_vocabulary(path, True), Bins(TaskContext.get().partitionId(), capacity)
    for piece in chunks(batches, "text"):
        for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
            ids = np.append(coder.encode(text) if text else np.zeros(0, np.uint32), np.uint32(end_id)).astype("<u4")
            start = 0
            for size in cuts(len(ids), capacity, whole):
                # a copy, as a piece that waits must not keep its whole document
                yield from bins.put((doc_id, start, ids[start : start + size].copy(), len(ids)))
                start += size
    yield from bins.rest()


def _batches(rows: Iterator[tuple], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[3]) + 64
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _NAMES, strict=True)], names=[n for n, _ in _NAMES])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), _NAMES, strict=True)], names=[n for n, _ in _NAMES])


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, whole: int = WHOLE, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs (doc_id, text): doc_id, start (its document's ids before it), length, ids (little-endian unsigned
    32-bit), doc_tokens (with the end id), sequence_id and offset (in the sequence, gapless from 0). Each id lies in one piece."""
    if capacity < 1 or whole < 1:
        raise ValueError("capacity and whole must be at least 1")
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(lambda batches: _batches(_rows(path, capacity, whole, end_id, batches)), PIECES)


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (padded to capacity unless their number is a power of two) and n_ids of each sequence of pack's pieces.
    A sequence has at most capacity pieces, so its group is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_join(F.transform(parts, lambda x: F.hex(x["ids"])), "").alias("h"))
    even = F.pow(F.lit(2.0), F.floor(F.log2("n_ids"))) == F.col("n_ids")
    pad = F.lit(pad_id.to_bytes(4, "little").hex().upper())
    filled = F.when(even, F.col("h")).otherwise(F.concat("h", F.repeat(pad, (F.lit(capacity) - F.col("n_ids")).cast("int"))))
    return whole.select("sequence_id", F.unhex(filled).alias("ids"), "n_ids")


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
