"""Keyword search by BM25 over a stored inverted index, and its fusion with other rankings.

A word is a run of letters and digits, in lower case. The index holds a posting (term, id, tf, long) for every word of every document
and a row (term, df, parts) for every term. A file has all postings of its documents, sorted by term, so that a search reads the row groups of its
terms and sums a document's score where it reads it. Where the queries hold more than SENT words, a term
of more than PART postings has several parts, and queries meet each part on its own, so no frequent word is one task. Documents without a
word, and null texts, are no documents here; rows of one id are one document. Scores are rounded to 6 digits before they
are ranked, so that the order of a sum decides nothing; ties go to the smaller id.

KeywordIndex.search makes a row of every query and document that share a word, which is right for few queries. search_many is for tables of
queries: packed blocks of documents stream past packed blocks of queries, and a task keeps k documents a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .blocks import swept
from .indexes import ranked
from .search import CELLS, best

WORD = r"[\p{L}\p{N}]+"
#: Postings of one part of a term.
PART = 1 << 16
#: Words of all queries, each with its weight, that are sent to every task; more are met by shuffles.
SENT = 1 << 18
#: Words of a packed block of documents, its documents, and about the queries of a packed block, at most; a document with more words is a block of its own.
BLOCK, DOCS, QUERIES = 1 << 22, 4096, 256
#: A word met by more than 1 / DENSE of a block's pairs of query and document is multiplied out, others are added up pair by pair.
DENSE = 128


def words(text: Column | str) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def postings(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """term, id, tf and long (words of the document) of every word of every document. The texts are dealt by id once; nothing is shuffled after that."""
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("text IS NOT NULL").repartition("id")
    own = dealt.select("id", F.explode(words("text")).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return own.withColumn("long", F.sum("tf").over(Window.partitionBy("id"))).select("term", "id", "tf", "long")


class KeywordIndex:
    """An inverted index in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str = "doc_id", text: str = "text", part: int = PART) -> KeywordIndex:
        out = cls(docs.sparkSession, folder)
        rows = postings(docs.where(F.col(id_col).isNotNull()), id_col, text)
        rows.sortWithinPartitions("term", "id").write.parquet(f"{folder}/postings")
        terms = out.postings().groupBy("term").agg(F.count("*").alias("df"))
        terms.withColumn("parts", F.ceil(F.col("df") / part).cast("int")).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{folder}/terms")
        whole = out.postings().groupBy("id").agg(F.first("long").alias("long")).agg(F.count("*").alias("n"), F.coalesce(F.sum("long"), F.lit(0)).alias("words"))
        whole.coalesce(1).write.parquet(f"{folder}/whole")
        return out

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/postings")

    def terms(self) -> DataFrame:
        """term, df and parts."""
        return self.spark.read.parquet(f"{self.folder}/terms")

    def scores(self, queries: DataFrame, query_id: str = "query_id", text: str = "text", k1: float = 1.2, b: float = 0.75, among: DataFrame | None = None) -> DataFrame:
        """query_id, id and score of every document that holds a word of a query. among (id): only these documents take part;
        frequencies are those of the whole index."""
        n, total = self.spark.read.parquet(f"{self.folder}/whole").first()
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(text))).alias("term"))
        weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        wanted = stored(asked.join(self.terms(), "term").select("query_id", "term", weight.alias("weight"), "parts"), "wanted")
        held = self.postings() if among is None else self.postings().join(among.select("id"), "id", "left_semi")
        size = k1 * (1 - b + b * F.col("long") / F.lit(total / n if n else 1.0))
        one = F.col("weight") * (F.col("tf") * (k1 + 1)) / (F.col("tf") + size)
        if wanted.count() <= SENT:  # a task has all postings of its documents, so what it gives is a row a query and document
            found = self.postings().join(F.broadcast(wanted.drop("parts")), "term")
            found = found.groupBy("query_id", "id").agg(F.round(F.sum(one), 6).alias("score"))
            return found if among is None else found.join(among.select("id"), "id", "left_semi").select("query_id", "id", "score")
        wanted = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        parts = held.join(wanted.select("term", "parts").distinct(), "term").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
        found = parts.join(wanted.drop("parts"), ["term", "part"])
        return found.groupBy("query_id", "id").agg(F.round(F.sum(one), 6).alias("score"))

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", text: str = "text", k1: float = 1.2, b: float = 0.75, among: DataFrame | None = None) -> DataFrame:
        """query_id, rank (from 1), id and score of the k best documents."""
        if k < 1 or k1 < 0 or not 0 <= b <= 1:
            raise ValueError("k must be at least 1, k1 at least 0, and b between 0 and 1")
        return ranked(self.scores(queries, query_id, text, k1, b, among), k)


_PACKED = "ids binary, long binary, terms array<string>, df binary, docs binary, tf binary"


def packed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of all documents in blocks of whole documents, about six bytes a posting: ids and long of the documents, then the words of the
    block, in how many of its documents each stands, and those documents (by place) and frequencies, word by word. The texts are dealt by id once."""
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL").repartition("id").sortWithinPartitions("id")

    def block(ids: np.ndarray, sizes: np.ndarray, found: pa.Array) -> pa.RecordBatch:
        own, doc = np.unique(ids, return_inverse=True)
        terms = found.dictionary_encode()
        pairs, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(own) + np.repeat(doc, sizes), return_counts=True)
        long = np.bincount(doc, sizes, len(own)).astype(np.int64)
        df = np.bincount(pairs // len(own), minlength=len(terms.dictionary))
        held = [pa.array([x.tobytes()], pa.binary()) for x in (own, long, df.astype("<i4"), (pairs % len(own)).astype("<u2"), tf.astype("<i4"))]
        return pa.RecordBatch.from_arrays([*held[:2], pa.array([terms.dictionary], pa.list_(pa.string())), *held[2:]], names=["ids", "long", "terms", "df", "docs", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in chain(batches, [None]):  # None: there are no more
            held += [] if b is None else [b]
            if b is not None and sum(len(x.column("words").flatten()) for x in held) <= BLOCK or not held:
                continue
            ids = np.concatenate([x.column("id").to_numpy() for x in held])
            found = pa.concat_arrays([x.column("words") for x in held])
            ends = np.append(np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids))  # rows of one id are one document
            sizes = found.value_lengths().to_numpy()
            upto, at = np.cumsum(sizes)[ends - 1], 0
            while at < len(ends):
                low = ends[at - 1] if at else 0
                n = min(int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BLOCK, "right")), at + DOCS)
                n = max(at + 1, n)
                if n == len(ends) and b is not None:  # the block, or its last document, may go on
                    break
                part = slice(low, ends[n - 1])
                some = sizes[part] > 0
                if some.any():
                    yield block(ids[part][some], sizes[part][some], found[part].flatten())
                at = n
            rest = int(ends[at - 1]) if at else 0
            held = [pa.RecordBatch.from_arrays([pa.array(ids[rest:]), found[rest:]], names=["id", "words"])] if rest < len(ids) else []

    return dealt.select("id", words("text").alias("words")).mapInArrow(run, _PACKED)


def search_many(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", query_id: str = "query_id", text: str = "text", query_text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """What KeywordIndex.search gives over all docs, for many queries: query_id, rank, id and score. Every query meets every document, so the work is
    their product, but no pair leaves a task: what is written is the packed blocks, and k rows a query of each share of the documents."""
    if k < 1 or k1 < 0 or not 0 <= b <= 1:
        raise ValueError("k must be at least 1, k1 at least 0, and b between 0 and 1")
    blocks = stored(packed(docs, id_col, text), "packed")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                df = np.frombuffer(batch.column("df")[n].as_py(), "<i4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("terms")[n].values, pa.array(df)], names=["term", "df"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("long")]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in long], pa.int64()), pa.array([int(x.sum()) for x in long], pa.int64())], names=["n", "words"])

    n, total = blocks.select("long").mapInArrow(summed, "n long, words long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    mean = total / n if n else 1.0
    asked = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(words(query_text))).alias("term")).distinct()
    df = blocks.select("terms", "df").mapInArrow(counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    many = max(1, -(-queries.count() // QUERIES))

    def bound(t: pa.Table) -> pa.Table:
        ids, own = np.unique(t.column("query_id").to_numpy(), return_inverse=True)
        found = t.column("term").combine_chunks().dictionary_encode()
        code = found.indices.to_numpy()
        order, place = np.argsort(code, kind="stable"), np.zeros(len(found.dictionary))
        place[code] = t.column("weight").to_numpy()
        held = [pa.array([x.tobytes()], pa.binary()) for x in (ids, place, np.bincount(code, minlength=len(place)).astype("<i4"), own[order].astype("<i4"))]
        return pa.table([t.column("_q")[:1], held[0], pa.array([found.dictionary], pa.list_(pa.string())), *held[1:]], names=["q_block", "q_ids", "q_terms", "q_weight", "q_many", "q_own"])

    wanted = asked.join(df, "term").select("query_id", "term", weight.alias("weight"), F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int").alias("_q"))
    held = wanted.groupBy("_q").applyInArrow(bound, "q_block int, q_ids binary, q_terms array<string>, q_weight binary, q_many binary, q_own binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, _Best] = {}
        for batch in batches:
            for r in range(batch.num_rows):
                one = {c: batch.column(c)[r] for c in batch.schema.names}
                key = one["q_block"].as_py()
                if key not in top:
                    top[key] = _Best(k, np.frombuffer(one["q_ids"].as_py(), np.int64))
                ids = np.frombuffer(one["ids"].as_py(), np.int64)
                top[key].add(ids, _products(one, len(top[key].ids), k1, b, mean))
        for found in top.values():
            yield from found.rows()

    return ranked(swept(blocks, stored(held, "asked"), run, "query_id long, id long, score double", many), k)


def _products(one: dict[str, pa.Scalar], queries: int, k1: float, b: float, mean: float) -> np.ndarray:
    """The scores of a block of queries (rows) and a block of documents (columns), 0 where they share no word."""
    blob = lambda c, kind: np.frombuffer(one[c].as_py(), kind)
    long, df, doc, tf = blob("long", np.int64), blob("df", "<i4"), blob("docs", "<u2"), blob("tf", "<i4")
    weight, many, own = blob("q_weight", np.float64), blob("q_many", "<i4"), blob("q_own", "<i4")
    place = pc.index_in(one["terms"].values, value_set=one["q_terms"].values)
    shared = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
    to = place.fill_null(-1).to_numpy()[shared]
    start, q_start = (np.cumsum(df) - df)[shared], (np.cumsum(many) - many)[to]
    size, q_size = df[shared].astype(np.int64), many[to].astype(np.int64)
    norm = k1 * (1 - b + b * long / mean)
    flat = lambda at, n: np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    wide = len(long)
    s = np.zeros((queries, wide))
    often = size * q_size * DENSE > queries * wide
    dense = np.flatnonzero(often)
    step = max(1, CELLS // max(queries, wide))
    for at in range(0, len(dense), step):
        part = dense[at : at + step]
        left, right = np.zeros((queries, len(part))), np.zeros((len(part), wide))
        left[own[flat(q_start[part], q_size[part])], np.repeat(np.arange(len(part)), q_size[part])] = np.repeat(weight[to[part]], q_size[part])
        where = flat(start[part], size[part])
        at_doc, times = doc[where], tf[where]
        right[np.repeat(np.arange(len(part)), size[part]), at_doc] = times * (k1 + 1) / (times + norm[at_doc])
        s += left @ right
    rest = np.flatnonzero(~often)
    cells = size[rest] * q_size[rest]
    ends, at = np.cumsum(cells), 0
    while at < len(rest):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")))
        part = rest[at:upto]
        where = flat(start[part], size[part])
        at_doc, times = doc[where].astype(np.int64), tf[where]
        value = np.repeat(weight[to[part]], size[part]) * (times * (k1 + 1) / (times + norm[at_doc]))
        each = np.repeat(q_size[part], size[part])  # a posting meets all queries of its word
        row = own[flat(np.repeat(q_start[part], size[part]), each)].astype(np.int64)
        s += np.bincount(row * wide + np.repeat(at_doc, each), np.repeat(value, each), queries * wide).reshape(queries, wide)
        at = upto
    return s


class _Best:
    """The k best documents of each query of a block so far."""

    def __init__(self, k: int, ids: np.ndarray):
        self.k, self.ids, self.least = k, ids, np.zeros(len(ids))
        self.row, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, own: np.ndarray, s: np.ndarray) -> None:
        """Scores s, 0 where no word is shared, of all queries with the documents own."""
        found = s > 0
        s = np.rint(s * 1e6) / 1e6
        found &= s >= self.least[:, None]
        if np.count_nonzero(found) > 4 * self.k * len(s) and self.k < s.shape[1]:
            kth = np.partition(np.where(found, s, -1.0), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            found &= s >= kth[:, None]
        row, col = np.nonzero(found)
        row, id_, score = np.concatenate([self.row, row]), np.concatenate([self.id, own[col]]), np.concatenate([self.score, s[row, col]])
        keep = best(row, id_, score, self.k)
        self.row, self.id, self.score = row[keep], id_[keep], score[keep]
        full = np.bincount(self.row, minlength=len(self.ids)) == self.k
        worst = np.full(len(self.ids), np.inf)
        np.minimum.at(worst, self.row, self.score)
        self.least = np.where(full, worst, 0.0)

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.id), pa.array(self.score)], names=["query_id", "id", "score"])


def fused(rankings: list[DataFrame], k: int = 10, damp: int = 60, weights: list[float] | None = None) -> DataFrame:
    """Reciprocal-rank fusion: query_id, rank, id and score of the k best by the sum of weight / (damp + rank) over rankings
    (query_id, id, rank). A row that a ranking lacks gets nothing from it."""
    weights = weights or [1.0] * len(rankings)
    if not rankings or len(weights) != len(rankings):
        raise ValueError("there must be a ranking, and a weight for each")
    shares = [r.select("query_id", "id", (F.lit(float(w)) / (damp + F.col("rank"))).alias(f"_{n}")) for n, (r, w) in enumerate(zip(rankings, weights, strict=True))]
    both = reduce(lambda a, b: a.join(b, ["query_id", "id"], "full_outer"), shares)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"_{n}"), F.lit(0.0)) for n in range(len(rankings))])
    return ranked(both.select("query_id", "id", total.alias("score")), k)
