"""A corpus pipeline of five of the training-data operators: each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import op2_near_dedup, op4_bpe, op5_language_id, op6_pii, op8_decontaminate
from quillon.llm.common import stored, table

#: SQL can express neither the models nor the signatures of the stages; they are tested stage by stage.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; null, empty and letterless texts go."""
    return op5_language_id.keep_languages(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by shingles of five words and a similarity of 0.8."""
    return op2_near_dedup.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return op8_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it generalised or removed; n_chars follows."""
    return op6_pii.sanitise(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded of all documents."""
    coded = op4_bpe.encode(docs, op4_bpe.tokenizer_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language ID", language), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("PII", pii), ("BPE encoding and decoding", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
