"""Approximate, keyword and hybrid search over the tables.

Vector searches take every vec_id divisible by 100 as a query, keyword searches every benchmark item. Indexes hold all rows;
they are built for the query in the folder that driver and executors share. What is approximate has no SQL and is held against the
exact search by tests/test_indexes.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, indexes, keywords, layouts, search
from ..sources import scratch
from ..sources.readers import table
from .registry import Registry
from .retrieval import _rounded, _sides, _sql

plans = Registry()

#: Lists of the index of inverted lists, and the recall that its probes are chosen for.
LISTS, RECALL = 16, 0.95


def _lists(rows: DataFrame, metric: str = "cosine") -> indexes.InvertedLists:
    return indexes.InvertedLists.build(rows, scratch.folder(rows.sparkSession, "lists"), LISTS, metric)


@plans.query()
def search_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best in as many lists as reach a recall of RECALL on the queries measured."""
    asked, rows = _sides(spark, sf)
    lists = _lists(rows)
    return _rounded(lists.search(asked, 10, lists.probes_for(rows, RECALL)))


@plans.query(_sql())
def search_ivf_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    asked, rows = _sides(spark, sf)
    return _rounded(_lists(rows).search(asked, 10, LISTS))


@plans.query(_sql("-list_distance(q.e, c.e)", k=5))
def search_ivf_l2_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    asked, rows = _sides(spark, sf)
    return _rounded(_lists(rows, "l2").search(asked, 5, LISTS))


@plans.query()
def search_product_codes(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best of a hundred candidates by their codes, in the lists that search_ivf takes."""
    asked, rows = _sides(spark, sf)
    lists = _lists(rows)
    codes = indexes.ProductCodes.build(lists, scratch.folder(spark, "codes"))
    return _rounded(codes.search(asked, 10, lists.probes_for(rows, RECALL)))


@plans.query()
def search_hyperplanes(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best in the buckets of eight tables, eight buckets a table."""
    asked, rows = _sides(spark, sf)
    return _rounded(indexes.HyperplaneTables.build(rows, scratch.folder(spark, "planes"), 8, 5).search(asked, 10, 8))


@plans.query()
def search_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best that a beam reaches in a graph of nearest neighbours."""
    asked, rows = _sides(spark, sf)
    return _rounded(graphs.NeighbourGraph.build(rows, scratch.folder(spark, "graph")).search(asked, 10))


_WORDS = r"""
w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT id, term, count(*) AS tf, CAST(sum(count(*)) OVER (PARTITION BY id) AS BIGINT) AS long FROM w GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
g AS (SELECT count(*) AS n, CAST(sum(long) AS DOUBLE) / count(*) AS mean FROM (SELECT DISTINCT id, long FROM p)),
b AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * long / mean))), 6) AS score
      FROM (SELECT DISTINCT query_id, term FROM a) JOIN df USING (term) JOIN p USING (term), g GROUP BY query_id, id)
"""
_ITEMS = r"WITH a AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark), "
_KEYWORD_RANKS = "r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, score FROM b {where})"


def _index(spark: SparkSession, sf: str) -> keywords.KeywordIndex:
    return keywords.KeywordIndex.build(table(spark, sf, "documents"), scratch.folder(spark, "keywords"))


@plans.query(_ITEMS + _WORDS + ", " + _KEYWORD_RANKS.format(where="") + " SELECT * FROM r WHERE rank <= 10")
def search_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each benchmark item by BM25."""
    return _index(spark, sf).search(table(spark, sf, "benchmark"), 10, "item_id")


@plans.query(_ITEMS + _WORDS + ", " + _KEYWORD_RANKS.format(where="JOIN documents d ON d.doc_id = b.id WHERE d.lang = 'en'") + " SELECT * FROM r WHERE rank <= 5")
def search_keywords_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The filter is applied before the search."""
    english = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return _index(spark, sf).search(table(spark, sf, "benchmark"), 5, "item_id", among=english)


@plans.query("WITH " + _WORDS.split("g AS")[0].strip().rstrip(",") + " SELECT term, df FROM df")
def keyword_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """In how many documents each word stands."""
    return _index(spark, sf).terms().select("term", "df")


@plans.query(
    r"WITH a AS (SELECT doc_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE doc_id % 100 = 0), "
    + _WORDS
    + ", "
    + _KEYWORD_RANKS.format(where="")
    + """, v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.e, c.e) DESC, c.vec_id) AS rank FROM v q JOIN v c ON q.vec_id % 100 = 0),
f AS (SELECT coalesce(k.query_id, s.query_id) AS query_id, coalesce(k.id, s.id) AS id, coalesce(CAST(1 AS DOUBLE) / (60 + k.rank), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + s.rank), 0) AS score
      FROM (SELECT * FROM r WHERE rank <= 50) k FULL JOIN (SELECT * FROM s WHERE rank <= 50) s ON k.query_id = s.query_id AND k.id = s.id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank, id, round(score, 6) AS score FROM f QUALIFY rank <= 10"""
)
def search_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the words and the vector of every document whose id is divisible by 100, both rankings fused by their ranks."""
    asked, rows = _sides(spark, sf)
    docs = table(spark, sf, "documents")
    by_word = keywords.search_many(docs, docs.where("doc_id % 100 = 0"), 50, query_id="doc_id")
    return _rounded(keywords.fused([by_word, search.top_k(asked, rows, 50)], 10))


def _feedback(rounds: int, hits: int, against: int, keep: float, toward: float, away: float) -> str:
    out = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
v AS (SELECT id, list_transform(x, lambda y: y / sqrt(list_inner_product(x, x))) AS v FROM e WHERE list_inner_product(x, x) > 0),
q0 AS (SELECT id AS query_id, v FROM v WHERE id % 100 = 0)"""
    for n in range(rounds):
        out += f""", s{n} AS (SELECT q.query_id, c.id, c.v, row_number() OVER (PARTITION BY q.query_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.id) AS rank FROM q{n} q, v c),
u{n} AS (SELECT query_id, pos, sum(x) FILTER (rank <= {hits}) / count(*) FILTER (rank <= {hits}) AS good, coalesce(sum(x) FILTER (rank > {hits}) / nullif(count(*) FILTER (rank > {hits}), 0), 0) AS bad
  FROM (SELECT query_id, rank, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM s{n} WHERE rank <= {hits + against}) GROUP BY query_id, pos),
m{n} AS (SELECT query_id, list({keep} * q.v[pos] + {toward} * good - {away} * bad ORDER BY pos) AS v FROM u{n} JOIN q{n} q USING (query_id) GROUP BY query_id),
q{n + 1} AS (SELECT query_id, list_transform(v, lambda y: y / sqrt(list_inner_product(v, v))) AS v FROM m{n})"""
    return (
        out
        + f""" SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.id) AS INTEGER) AS rank, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score
FROM q{rounds} q, v c QUALIFY rank <= 10"""
    )


@plans.query(_feedback(2, 5, 5, 1.0, 0.75, 0.15))
def search_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best after two rounds in which each query moves toward its five best rows and away from the five behind them."""
    asked, rows = _sides(spark, sf)
    moved = search.expanded(asked, rows, 5, 5, 2)
    return _rounded(search.top_k(moved.withColumnRenamed("v", "embedding"), rows, 10, query_id="query_id"))


@plans.query()
def plane_layout(spark: SparkSession, sf: str) -> DataFrame:
    """A map of all vectors in the plane."""
    placed = layouts.layout(_sides(spark, sf)[1])
    return placed.select(F.col("id").alias("vec_id"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
