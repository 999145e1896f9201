"""Cross-tokenizer alignment by pointer jumping.

Both tokenizers cut the same bytes. Every token points to the farthest-right token that overlaps it: the other
tokenizer's token that holds its last byte, or itself if no token reaches further. Successors are doubled (next = next[next]) for
all tokens of a stretch of texts at once until nothing changes; every token then points to the terminal token of its
component, which is its group. Groups end where tokens of both end.

Links are the overlapping pairs of token occurrences; each link is one distinct token end. How many documents hold a
pair of ids is counted over all documents. Those counts come back to the documents in two exact ways: pairs held by at least
one FREQUENT-th of all (document, pair) entries, of which there can be FREQUENT at most, go out to every task, and their best by
id with them; all other pairs, none of which is hot by that bound, are joined.

Null and empty texts, and texts whose tokens don't spell space + text (control of U+2581, unknown pieces), have no tokens: zeros
and an empty column. Very long texts are one step each. A null doc_id stays null; each row counts as a document of its own, so
repeated rows count twice. Empty table: no rows. Clashing further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_vocabulary, piece_vocabulary
from .common import chunks, give_back, small_batches, stored, table
from .op4_bpe import tokenizer_path

#: Pairs whose counts go out to every task: at most this many, 16 bytes each.
FREQUENT = 1 << 19
#: Distinct pairs that a task counts before it hands them on.
HELD_PAIRS = 1 << 20
#: key: of the row. pairs and times: links of the document by id pair (id of A * size of B + id of B), as planes of 64-bit numbers.
LINKED = "doc_id long, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
GROUPED = "doc_id long, a_ids array<int>, b_ids array<int>, a_groups array<int>, b_groups array<int>"
COUNTED = "pair long, n long"


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By pointer jumping: the terminal token of each token of A and of B, as a place in B. The last ends are equal."""
    n = len(ends_a)
    holds_a, holds_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    own = np.arange(len(ends_b))
    follow = np.concatenate([n + holds_a, np.where(ends_a[holds_b] > ends_b, holds_b, n + own)])
    while True:
        further = follow[follow]
        if np.array_equal(further, follow):
            return follow[:n] - n, follow[n:] - n
        follow = further


class Stretch:
    """The tokens of a stretch of texts, all laid end to end; texts without tokens have none of either kind."""

    def __init__(self, texts: list[str | None], path_a: str, path_b: str):
        a, b = byte_vocabulary(path_a, False), piece_vocabulary(path_b)
        spelled = [f" {t}" if t else "" for t in texts]
        coded_b = b.encode([t or "" for t in texts])
        ids_a, ids_b = [], []
        for text, ib in zip(spelled, coded_b, strict=True):
            data = text.encode()
            ia = a.encode(text) if text else np.zeros(0, np.uint32)
            fits = data and b"".join([a.pieces[i] for i in ia.tolist()]) == data and b"".join([b.pieces[i] for i in ib]) == data
            ids_a.append(ia if fits else ia[:0])
            ids_b.append(np.array(ib if fits else [], np.int64))
        self.first_a, self.first_b = (np.concatenate([[0], np.cumsum([len(x) for x in ids])]) for ids in (ids_a, ids_b))
        self.a, self.b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        self.ends_a, self.ends_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        self.size_b, self.size = b.size, max(a.size, b.size)
        last_a, last_b = terminals(self.ends_a, self.ends_b)
        closes = np.flatnonzero(last_b == np.arange(len(last_b)))  # the terminal tokens, one a group
        self.group_a, self.group_b = np.searchsorted(closes, last_a), np.searchsorted(closes, last_b)
        self.n_groups = np.diff(np.searchsorted(closes, self.first_b))

    def __len__(self) -> int:
        return len(self.first_a) - 1

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Links of each text; and its distinct pairs with their occurrences, ordered by text and pair: text, pair, times."""
        ends = np.sort(np.concatenate([self.ends_a, self.ends_b]), kind="stable")
        ends = ends[np.diff(ends, prepend=0) > 0]
        in_a = np.searchsorted(self.ends_a, ends)
        pair = self.a[in_a] * self.size_b + self.b[np.searchsorted(self.ends_b, ends)]
        text = np.searchsorted(self.first_a, in_a, "right") - 1
        order = np.lexsort((pair, text))
        text, pair = text[order], pair[order]
        fresh = np.flatnonzero(np.concatenate([[True], (np.diff(text) != 0) | (np.diff(pair) != 0)])) if len(pair) else np.zeros(0, np.int64)
        return np.bincount(text, minlength=len(self)), text[fresh], pair[fresh], np.diff(np.append(fresh, len(pair)))

    def written(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        in_a, in_b = (np.bincount(g, minlength=self.n_groups.sum()) for g in (self.group_a, self.group_b))
        until_a, until_b = np.cumsum(in_a), np.cumsum(in_b)
        n, m = len(self.a), len(self.b)
        place_a = np.arange(n) + (until_b - in_b)[self.group_a]
        place_b = np.arange(m) + until_a[self.group_b]
        ids, mark = np.empty(n + m, np.int64), np.full(n + m, 0)
        ids[place_a], ids[place_b] = self.a, self.b
        mark[place_a[until_a - 1]], mark[place_b[until_b - 1]] = 1, 2
        ends = (self.first_a + self.first_b)[1:]
        mark[ends[np.diff(self.first_a) > 0] - 1] = 3
        words, lengths = _written(self.size)
        which = ids * 4 + mark
        long, flat = lengths[which], words[which]
        data = flat[np.arange(flat.shape[1]) < long[:, None]].tobytes()
        cut = np.concatenate([[0], np.cumsum(long)])[np.concatenate([[0], ends])]
        return [data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


_words: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _written(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids below size in decimal, each with `,`, `|`, `;` or nothing behind it: bytes and their number."""
    if size not in _words:
        made = np.array([f"{i}{c}" for i in range(size) for c in (",", "|", ";", "")], "S")
        _words[size] = made.view(np.uint8).reshape(len(made), -1), np.char.str_len(made)
    return _words[size]


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers as eight planes of bytes, the low bytes first, which compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unplaned(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def _batch(columns: dict, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    types = [c.split()[1] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns.values(), types, strict=True)], names=list(columns))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def grouped(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, the ids of both tokenizers, and the group (from 0, in order) of every token, of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            s = Stretch(piece.column("text").to_pylist(), path_a, path_b)
            base = np.concatenate([[0], np.cumsum(s.n_groups)])
            of_a, of_b = s.group_a - np.repeat(base[:-1], np.diff(s.first_a)), s.group_b - np.repeat(base[:-1], np.diff(s.first_b))
            part = lambda x, f: [x[i:j] for i, j in zip(f[:-1], f[1:], strict=True)]
            yield _batch({"doc_id": piece.column("doc_id"), "a_ids": part(s.a, s.first_a), "b_ids": part(s.b, s.first_b), "a_groups": part(of_a, s.first_a), "b_groups": part(of_b, s.first_b)}, GROUPED)

    return _texts(docs).mapInArrow(run, GROUPED)


def linked(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The columns LINKED of each row of docs (doc_id, text). Keys follow from partition and place there: store it before it is used twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for piece in chunks(batches, "text"):
            s = Stretch(piece.column("text").to_pylist(), path_a, path_b)
            n, text, pair, times = s.links()
            first = np.searchsorted(text, np.arange(len(s) + 1))
            part = lambda x, f=first: [planes(x[i:j]) for i, j in zip(f[:-1], f[1:], strict=True)]
            yield _batch({
                "doc_id": piece.column("doc_id"), "key": np.arange(key, key + len(s)), "n_a": np.diff(s.first_a), "n_b": np.diff(s.first_b), "n_groups": s.n_groups, "n_links": n,
                "groups_sha256": [hashlib.sha256(w).hexdigest() if w else "" for w in s.written()], "pairs": part(pair), "times": part(times),
            }, LINKED)
            key += len(s)

    return _texts(docs).mapInArrow(run, LINKED)


def _summed(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(pairs, kind="stable")
    pairs, n = pairs[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
    return pairs[first], np.add.reduceat(n, first)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by pair, summed within the task in bounded memory."""
    held, size, sums = [], 0, (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        for data in batch.column("pairs").to_pylist():
            held.append(unplaned(data))
            size += len(held[-1])
            if size >= HELD_PAIRS:
                fresh = np.concatenate([sums[0], *held])
                sums = _summed(fresh, np.concatenate([sums[1], np.ones(size, np.int64)]))
                held, size = [], 0
                if len(sums[0]) >= HELD_PAIRS:
                    yield _batch({"pair": sums[0], "n": sums[1]}, COUNTED)
                    sums = sums[0][:0], sums[1][:0]
    if size or len(sums[0]):
        sums = _summed(np.concatenate([sums[0], *held]), np.concatenate([sums[1], np.ones(size, np.int64)]))
        for at in range(0, len(sums[0]), 1 << 16):
            yield _batch({"pair": sums[0][at : at + (1 << 16)], "n": sums[1][at : at + (1 << 16)]}, COUNTED)
    give_back()


def link_counts(links: DataFrame) -> DataFrame:
    """pair and n (documents that hold it linked) over stored rows of linked."""
    return links.select("pairs").mapInArrow(_counted, COUNTED).groupBy("pair").agg(F.sum("n").alias("n"))


def scored(links: DataFrame, size_b: int) -> DataFrame:
    """key, n_best and count_sum of each row of stored links."""
    spark = links.sparkSession
    counts = stored(link_counts(links), "link-counts").withColumn("a", F.floor(F.col("pair") / size_b).cast("long"))
    by_id = counts.groupBy("a").agg(F.max("n").alias("best"), F.sum("n").alias("n"))  # a row per id of A's vocabulary at most
    own = by_id.toArrow()
    best = np.zeros(int(max(own.column("a").to_numpy(), default=0)) + 1, np.int64)
    best[own.column("a").to_numpy()] = own.column("best").to_numpy()
    total = int(own.column("n").to_numpy().sum())
    least = total // FREQUENT + 1  # that many entries or more: fewer than FREQUENT pairs
    often = counts.where(F.col("n") >= least).select("pair", "n").orderBy("pair").toArrow()
    sent = spark.sparkContext.broadcast((often.column("pair").to_numpy(), often.column("n").to_numpy(), best))

    def looked_up(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs stand among the frequent, and whether they do."""
        known = sent.value[0]
        if not len(known):
            return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
        at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
        return at, known[at] == pairs

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pairs, times in zip(*(batch.column(c).to_pylist() for c in ("pairs", "times")), strict=True):
                pairs, times = unplaned(pairs), unplaned(times)
                at, there = looked_up(pairs)
                n = np.where(there, sent.value[1][at] if len(sent.value[1]) else 0, 0)
                out.append((int(times[there & (n == sent.value[2][pairs // size_b])].sum()), int((times * n).sum())))
            yield _batch({"key": batch.column("key"), "n_best": [o[0] for o in out], "count_sum": [o[1] for o in out]}, "key long, n_best long, count_sum long")

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [unplaned(p) for p in batch.column("pairs").to_pylist()]
            many = np.array([len(p) for p in pairs])
            pair = np.concatenate(pairs)
            times, key = np.concatenate([unplaned(t) for t in batch.column("times").to_pylist()]), np.repeat(batch.column("key").to_numpy(), many)
            left = ~looked_up(pair)[1]
            yield _batch({"key": key[left], "pair": pair[left], "times": times[left], "best": sent.value[2][pair[left] // size_b]}, "key long, pair long, times long, best long")

    known = links.select("key", "pairs", "times").mapInArrow(frequent, "key long, n_best long, count_sum long")
    others = links.select("key", "pairs", "times").mapInArrow(rare, "key long, pair long, times long, best long")
    found = others.join(counts.where(F.col("n") < least).select("pair", "n"), "pair")
    sums = found.groupBy("key").agg(F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return known.union(sums).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each row of docs (doc_id, text)."""
    links = stored(linked(docs, path_a, path_b), "links")
    both = links.drop("pairs", "times").join(scored(links, piece_vocabulary(path_b).size), "key")
    return both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
