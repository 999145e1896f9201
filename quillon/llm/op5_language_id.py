"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts up to three bytes long is trained on a sample of about
SAMPLE whole documents at most (those of the smallest hash of the id, taken a 64th of a sample at a time); then its statistics are frozen. A
byte seen after its longest known context costs -log2(n / (total + kinds)) bits; else an escape,
-log2(kinds / (total + kinds)), is paid and the next shorter context asked, down to 1 / 256 for a byte
never seen. The exact code length of the whole text is summed under each language's tree, and the
shortest wins (ties: the first language in order). score is the posterior share of that language
under equal priors.

Texts are lower-cased; runs of white space, digits and ASCII punctuation count as one space. Null, empty
and letterless texts, and all texts where there is nothing to learn from, get `und` and score 0. A null doc_id
is passed through and counts as not held out. Repeated rows are all predicted. Empty table: no rows. Clashing
further columns are not read by predict; keep_languages returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, fold, per_text_sum, small_batches, table, utf8

#: Training documents per language, the bound of the fitted sample.
SAMPLE = 400
ORDER = 3
UNKNOWN = "und"
RAW = 8.0
PREDICTED = "doc_id long, lang_pred string, score double, bits_per_byte double"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]


def contexts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit code per byte of the normalised texts (three context bytes, then the byte), and where each text's begin."""
    data, offsets = utf8(pc.utf8_lower(texts))
    data = _FOLD[data]
    blank = data == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    keep[begins] |= blank[begins]
    first = np.concatenate([[0], np.cumsum(keep)])[offsets]
    data = data[keep].astype(np.uint32)
    code = data.copy()
    place = np.arange(len(data)) - np.repeat(first[:-1], np.diff(first))
    for k in range(1, ORDER + 1):
        before = np.full(len(data), 32, np.uint32)
        before[k:] = data[:-k]
        before[place < k] = 32
        code |= before << np.uint32(8 * k)
    return code, first


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in chunks(batches, "text"):
        langs = np.array(piece.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            code, _ = contexts(piece.column("text").filter(pa.array(langs == lang)))
            codes, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])


class Tree:
    """The frozen context tree of one language: by order, the costs of known symbols and escapes."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.symbols, self.escapes = [], []
        for k in range(ORDER + 1):
            own, at = np.unique(codes & np.uint32(2 ** (8 * (k + 1)) - 1), return_inverse=True)
            n = np.bincount(at, counts)
            above, group = np.unique(own >> np.uint32(8), return_inverse=True)
            total, kinds = np.bincount(group, n), np.bincount(group)
            self.symbols.append((own, np.log2((total + kinds)[group] / n).astype(np.float32)))
            self.escapes.append((above, np.log2((total + kinds) / kinds).astype(np.float32)))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The code length of the last byte of each code."""
        cost = np.full(len(codes), 8, np.float32)
        for k in range(ORDER + 1):
            code = codes & np.uint32(2 ** (8 * (k + 1)) - 1)
            known, own = _look(self.symbols[k], code)
            met, escape = _look(self.escapes[k], code >> np.uint32(8))
            cost = np.where(known, own, cost + np.where(met, escape, np.float32(0)))
        return cost


def _look(where: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(where[0], keys), len(where[0]) - 1)
    return where[0][at] == keys, where[1][at]


def chosen(labelled: DataFrame, sample: int) -> DataFrame:
    """Rows of labelled (doc_id, lang, ...) whose id's hash is among the smallest of its language: at most `sample` rows a
    language, but for less than a 64th of it. Counts by language and by step of the hash set the limits, so no language
    meets in one task and nothing is ranked."""
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("size"))  # a row a language
    # steps of the hash such that 64 of them are expected to hold a sample; 256 of them are looked at
    step = F.floor(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / float(1 << 40) * F.col("size") * (64.0 / sample)).cast("long")
    near = labelled.join(F.broadcast(sizes), "lang").withColumn("step", F.least(step, F.lit(256)))
    steps = near.where("step < 256").groupBy("lang", "step").agg(F.count("*").alias("n")).collect()  # 256 rows a language at most
    limits: dict[str, tuple[int, int]] = {}
    for r in sorted(steps, key=lambda r: (r["lang"], r["step"])):
        limit, taken = limits.get(r["lang"], (-1, 0))
        if taken >= 0:
            fits = taken + r["n"] <= sample or limit < 0
            limits[r["lang"]] = (r["step"], taken + r["n"]) if fits else (limit, -1)
    rows = labelled.sparkSession.createDataFrame([(k, v[0]) for k, v in limits.items()], "lang string, limit long")
    return near.join(F.broadcast(rows), "lang").where("step <= limit").drop("size", "step", "limit")


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, Tree]:
    """A tree per language of docs (doc_id, text, lang); about `sample` whole documents of each are used at most."""
    small_batches(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text")
    counts = chosen(labelled, sample).select("lang", "text").mapInArrow(_tally, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["lang", "code"])
    return {lang: Tree(own["code"].to_numpy().astype(np.uint32), own["n"].to_numpy()) for lang, own in counts.groupby("lang", sort=True)}


def judge(text: pa.Array, langs: list[str], trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, posterior share and bits per byte of each text."""
    code, first = contexts(text)
    distinct, back = np.unique(code, return_inverse=True)
    lengths = np.full((len(text), max(1, len(langs))), np.inf)
    for k, tree in enumerate(trees):
        lengths[:, k] = per_text_sum(tree.bits(distinct).astype(np.float64)[back], first)
    least = lengths.min(1)
    worded = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False) & (len(langs) > 0)
    with np.errstate(invalid="ignore"):
        share = 1 / np.exp2(np.maximum(least[:, None] - lengths, -1000)).sum(1)
    names = np.array([*langs, UNKNOWN], object)[np.where(worded, lengths.argmin(1), len(langs))]
    return names, np.where(worded, share, 0.0), np.where(worded, least / np.maximum(1, np.diff(first)), 8.0)


def predict(docs: DataFrame, trees: dict[str, Tree]) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte (of the normalised text) of every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast((sorted(trees), [trees[k] for k in sorted(trees)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            names, share, bits = judge(piece.column("text"), *model.value)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(share), pa.array(bits)], names=["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PREDICTED)


def held_out() -> Column:
    return fold("doc_id", 3) == 1


def keep_languages(docs: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the languages keep (default: any learned
    one); letterless, empty and null texts go, and those that their best language codes in RAW bits a byte or more, which
    is longer than without any model. Learns from docs itself; no row is shuffled."""
    trees = train(docs.where(~held_out()), sample)
    model = docs.sparkSession.sparkContext.broadcast((sorted(trees), [trees[k] for k in sorted(trees)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "text"):
            names, _, bits = judge(piece.column("text"), *model.value)
            yield piece.filter(pa.array([(n in keep if keep is not None else n != UNKNOWN) and b < RAW for n, b in zip(names, bits, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs.where(~held_out()))).withColumn("held_out", held_out())
