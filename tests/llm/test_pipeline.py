"""The pipeline stage by stage, on the smallest documents and on odd rows."""

from __future__ import annotations

import odd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quillon.llm import op2_near_dedup, op4_bpe, op5_language_id, op8_decontaminate


def ids(df):
    return sorted(str(r["doc_id"]) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("rows", ["table", "odd"])
def test_stages(spark, sf, rows):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs if rows == "table" else odd.documents(spark).select(docs.columns)
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    columns, held = docs.columns, []
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        if len(held) < 4:
            assert out.columns == columns
        docs = cp.stored(out, "stage")
        held.append(docs)
    first, second, third, fourth, last = held
    before = spark.read.parquet(f"{sf}/documents.parquet") if rows == "table" else odd.documents(spark)
    langs = op5_language_id.predict(before, op5_language_id.train(before.where(~op5_language_id.held_out())))
    assert ids(first) == ids(langs.where("lang_pred <> 'und'"))
    assert ids(second) == ids(op2_near_dedup.near_duplicates(first).where("kept OR doc_id IS NULL"))
    bad = {str(r["doc_id"]) for r in op8_decontaminate.matches(second, benchmark).collect()}
    assert ids(third) == [i for i in ids(second) if i not in bad]
    assert ids(fourth) == ids(third) == ids(last)
    t = Tokenizer.from_file(op4_bpe.tokenizer_path())
    t.no_truncation()
    texts = {str(r["doc_id"]): r["text"] for r in fourth.collect()}
    for r in last.collect():
        assert r["ids"] == t.encode(texts[str(r["doc_id"])], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run(spark, sf):
    assert 0 < cp.run(spark, sf).count() < spark.read.parquet(f"{sf}/documents.parquet").count()
