"""Benchmark decontamination: rare gapped seeds, then Smith-Waterman alignment of words.

A document is contaminated by an item of n words if their alignment (match 2, mismatch and gap -1) reaches half of the score of a
verbatim copy. Then, of the alignment's words, at most n lie between its matches, at least half of the item's words are matched, and of
the n - 1 pairs of neighbours in the item at least n / 3 - 1 are matched by words at most REACH apart: u words at the item's ends,
v within it and w put in cost 2 u + 3 v + w <= n together, and take at most u + 2 v + w / REACH pairs away.

So an item's seeds are its pairs of neighbours, and one pass over the documents counts how often each stands there. If no copy
keeps fewer than p of q seeds, every copy has at least k of the q - p + k rarest: these alone are looked for, at distances up to
REACH, and stretches of 2 n words with k of them are candidates. Items too short for that have single words as seeds, of which every copy
keeps half. Candidates with too few of the item's words for the least score are left out, all others aligned. Every
step is a bound, so nothing that the alignment would accept is lost, however frequent its words are.

The benchmark goes out in blocks of at most about BLOCK_WORDS words, two scans each, so that
what is broadcast is bounded; no document text is shuffled. Null or blank texts and items, and items of
fewer than three words, match nothing. A null doc_id is reported as null. Repeated documents are all
reported. Empty tables: no rows. Clashing further columns are not read by matches; clean keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, mix, small_batches, table, utf8, words

#: Fewest words of an item.
LEAST_WORDS = 3
#: Words that two words of a seed may be apart in a document.
REACH = 3
MATCH, MISS, GAP = 2, -1, -1
LEAST_SCORE = 0.5
BLOCK_WORDS = 1 << 18
MATCHES = "doc_id long, item_id long, score double, n_seeds int, from_word int, to_word int"
_BITS = 22
_ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _ONE + second * _TWO)


def _single(word: np.ndarray) -> np.ndarray:
    return mix(word ^ _TWO)


def kept_pairs(n: int) -> int:
    """How many of its pairs of neighbours every copy of an item of n words keeps within REACH."""
    return -(-n // 3) - 1


class _Items:
    """Benchmark items of a block: their words and their seeds. rare chooses the seeds that are looked for."""

    def __init__(self, ids: list[int], texts: list[str]):
        w = words(*utf8(pa.array(texts, pa.string())))
        fine = np.flatnonzero(np.diff(w.first) >= LEAST_WORDS)
        self.ids = np.array(ids, np.int64)[fine]
        self.words = [w.hashes[w.first[i] : w.first[i + 1]] for i in fine]
        #: The distinct words of each item, for the bound.
        self.kinds = [np.unique(x) for x in self.words]
        #: An alignment of score s has at least s / MATCH matches.
        self.least = [int(np.ceil(LEAST_SCORE * len(x))) for x in self.words]
        self.paired = [kept_pairs(len(x)) >= 1 for x in self.words]
        self._own = [_pair(x[:-1], x[1:]) if p else _single(x) for x, p in zip(self.words, self.paired, strict=True)]
        self._hold(self._own)

    def _hold(self, own: list[np.ndarray]) -> None:
        seeds = np.concatenate(own) if own else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.seeds, place = np.unique(seeds, return_inverse=True)
        held = np.unique(np.column_stack([place, item]), axis=0) if len(item) else np.zeros((0, 2), np.int64)
        #: Items of seed k: item[first[k] : first[k + 1]].
        self.first, self.item = np.searchsorted(held[:, 0], np.arange(len(self.seeds) + 1)), held[:, 1]
        self.known = np.zeros(1 << _BITS, bool)
        self.known[self.seeds >> np.uint64(64 - _BITS)] = True
        self.singles, self.pairs = not all(self.paired), any(self.paired)

    def rare(self, counts: np.ndarray) -> None:
        """Keeps of each item the rarest seeds, as few as every copy must hold `need` of. counts: of self.seeds, in the documents."""
        own, self.need = [], []
        for seeds, paired, x, least in zip(self._own, self.paired, self.words, self.least, strict=True):
            kept = kept_pairs(len(x)) if paired else least
            need = -(-kept // 2)
            order = np.lexsort((seeds, counts[np.searchsorted(self.seeds, seeds)]))
            own.append(seeds[order[: len(seeds) - kept + need]])
            self.need.append(need)
        self._hold(own)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Positions of words at which a seed begins, and its number; a seed that is there at several distances is there once."""
        text, at, seed = w.of(), [], []
        for d in range(REACH + 1):
            if d and self.pairs:
                found = _pair(w.hashes[:-d], w.hashes[d:])
                found[text[:-d] != text[d:]] = 0
            elif not d and self.singles:
                found = _single(w.hashes)
            else:
                continue
            there = np.flatnonzero(self.known[found >> np.uint64(64 - _BITS)])
            place = np.searchsorted(self.seeds, found[there])
            place[place == len(self.seeds)] = 0
            good = self.seeds[place] == found[there] if len(self.seeds) else np.zeros(len(there), bool)
            at.append(there[good])
            seed.append(place[good])
        if not at:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.column_stack([np.concatenate(at), np.concatenate(seed)]), axis=0)
        return both[:, 0], both[:, 1]

    def stretches(self, i: int, text: np.ndarray, begin: int, end: int) -> list[tuple[int, int]]:
        """The parts of text[begin:end] that lie in a window of twice the item's length with words enough of item i for the least score."""
        own, wide = self.kinds[i], 2 * len(self.words[i])
        part = text[begin:end]
        there = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
        sums = np.concatenate([[0], np.cumsum(there)])
        starts = np.arange(max(1, len(part) - wide + 1))
        good = starts[sums[np.minimum(starts + wide, len(part))] - sums[starts] >= self.least[i]]
        if not len(good):
            return []
        cut = np.flatnonzero(np.diff(good) > wide) + 1
        return [(begin + int(g[0]), begin + min(len(part), int(g[-1]) + wide)) for g in np.split(good, cut)]


def smith_waterman(windows: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each window with its item, all pairs at once: score, and one past the
    window's last aligned word."""
    pairs, wide, long = len(windows), max(map(len, items)), max(map(len, windows))
    a = np.zeros((pairs, wide), np.uint64)
    b = np.ones((pairs, long), np.uint64)
    for k in range(pairs):
        a[k, : len(items[k])], b[k, : len(windows[k])] = items[k] | np.uint64(2), windows[k] | np.uint64(2)
    steps = GAP * np.arange(1, wide + 1)
    held = np.zeros((pairs, wide + 1), np.int64)
    best, end = np.zeros(pairs, np.int64), np.zeros(pairs, np.int64)
    for t in range(long):
        fresh = np.maximum(held[:, :-1] + np.where(a == b[:, t : t + 1], MATCH, MISS), held[:, 1:] + GAP)
        fresh = np.maximum(np.maximum.accumulate(np.maximum(fresh, 0) - steps, axis=1) + steps, 0)
        held[:, 1:] = fresh
        most = fresh.max(1)
        end[most > best] = t + 1
        best = np.maximum(best, most)
    return best, end


def _found(own: _Items, texts: pa.Array) -> dict[tuple[int, int], tuple[float, int, int, int]]:
    """By text and item, both as positions: the alignments that reach the least score."""
    w = words(*utf8(texts))
    at, seed = own.hits(w)
    many = own.first[seed + 1] - own.first[seed]
    entry = np.repeat(own.first[seed], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at, seed, item = np.repeat(at, many), np.repeat(seed, many), own.item[entry]
    doc = np.searchsorted(w.first, at, "right") - 1
    order = np.lexsort((at, item, doc))
    at, seed, item, doc = at[order], seed[order], item[order], doc[order]
    wide, need = 2 * np.array([len(x) for x in own.words], np.int64), np.array(own.need, np.int64)
    # a hit that is the first of enough hits of its text and item within the reach of a copy
    last = np.arange(len(at)) + (need[item] - 1 if len(at) else 0)
    inside = np.minimum(last, max(len(at) - 1, 0))
    opens = np.flatnonzero((last < len(at)) & (doc[inside] == doc) & (item[inside] == item) & (at[inside] - at < wide[item])) if len(at) else last
    cases, at_end = [], (-1, -1, -1)
    for k in opens:
        d, i = int(doc[k]), int(item[k])
        base, size = int(w.first[d]), int(w.first[d + 1] - w.first[d])
        begin, end = max(0, int(at[k]) - base - int(wide[i])), min(size, int(at[last[k]]) - base + int(wide[i]) + REACH)
        if at_end[:2] == (d, i) and begin <= at_end[2]:
            cases[-1][3] = max(cases[-1][3], end)
        else:
            cases.append([d, i, begin, end])
        at_end = (d, i, cases[-1][3])
    parts = []
    for d, i, begin, end in cases:
        text = w.hashes[w.first[d] : w.first[d + 1]]
        for x, y in own.stretches(i, text, begin, end):
            parts.append((d, i, x, text[x:y]))
    got: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    parts.sort(key=lambda c: len(c[3]))
    for k in range(0, len(parts), 256):
        part = parts[k : k + 256]
        score, end = smith_waterman([c[3] for c in part], [own.words[c[1]] for c in part])
        for (d, i, begin, _), s, e in zip(part, score, end, strict=True):
            rel = float(s) / (MATCH * len(own.words[i]))
            if rel >= LEAST_SCORE and rel > got.get((d, i), (0.0,))[0]:
                own_hits = slice(*np.searchsorted(doc, [d, d + 1]))
                kinds = len(np.unique(seed[own_hits][item[own_hits] == i]))
                got[d, i] = (rel, kinds, begin, int(begin + e - 1))
    return got


def _count(items: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        sums = np.zeros(len(own.seeds), np.int64)
        for piece in chunks(batches, "text"):
            sums += np.bincount(own.hits(words(*utf8(piece.column("text"))))[1], minlength=len(sums))
        there = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(sums[there])], names=["seed", "n"])

    return run


def _align(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            if got := _found(items.value, piece.column("text")):
                rest = list(zip(*got.values(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id").take(pa.array([d for d, _ in got])), pa.array([items.value.ids[i] for _, i in got], pa.int64()), pa.array(rest[0], pa.float64()), *(pa.array(x, pa.int32()) for x in rest[1:])],
                    names=["doc_id", "item_id", "score", "n_seeds", "from_word", "to_word"],
                )

    return run


def _without(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            stay = np.ones(piece.num_rows, bool)
            stay[[d for d, _ in _found(items.value, piece.column("text"))]] = False
            yield piece.filter(pa.array(stay))

    return run


def _blocks(benchmark: DataFrame, docs: DataFrame) -> Iterator[Broadcast]:
    """The benchmark in blocks of bounded size, each with the seeds that are rarest in docs (text), sent to every task."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = -(-total // BLOCK_WORDS)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id").collect()
        own = _Items([r[0] for r in rows], [r[1] for r in rows])
        if len(own.ids):
            sent = spark.sparkContext.broadcast(own)
            # a row a seed of the block at most
            found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_count(sent), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
            sent.unpersist()
            counts = np.zeros(len(own.seeds), np.int64)
            counts[found.column("seed").to_numpy()] = found.column("n").to_numpy()
            own.rare(counts)
            yield spark.sparkContext.broadcast(own)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score (1: verbatim), n_seeds, from_word and to_word (the stretch that was
    aligned, up to the last aligned word) of every document of docs (doc_id, text) that holds an item of
    benchmark (item_id, text), a row per document and item."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], MATCHES)
    for own in _blocks(benchmark, docs):
        out = out.union(docs.mapInArrow(_align(own), MATCHES))
    best = F.max(F.struct("score", "n_seeds", "from_word", "to_word")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text holds no item of benchmark. Rows are judged where
    they lie; none is shuffled."""
    out = docs
    for own in _blocks(benchmark, docs):
        out = out.mapInArrow(_without(own), docs.schema)
    return out


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
