"""Packing: every id in one piece, sequences without gaps, ids as the tokenizers library has them, padding."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import odd
import pytest
from tokenizers import Tokenizer

from quillon.llm import op12_packing as op12
from quillon.llm.op4_bpe import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")


def ids_of(texts):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def whole(pieces):
    """Checks the sequences and gives the documents' ids, put together from their pieces."""
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    padding = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= op12.CAPACITY
        padding += 0 if at & (at - 1) == 0 else op12.CAPACITY - at
        total += at
    return by_doc, padding / max(1, total)


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = docs.select("doc_id", "text").collect()
    by_doc, padding = whole(op12.pack(docs, PATH).collect())
    for r, ids in zip(rows, ids_of([r["text"] for r in rows]), strict=True):
        parts = sorted(by_doc[r["doc_id"]])
        assert sum((p[1] for p in parts), []) == ids
        assert [p[0] for p in parts] == np.cumsum([0, *(len(p[1]) for p in parts)])[:-1].tolist() and {p[2] for p in parts} == {len(ids)}
    assert padding < 0.01


def test_query(spark, sf):
    got = op12.op12_packing(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    docs = {r["doc_id"]: i for r, i in zip(rows, ids_of([r["text"] for r in rows]), strict=True)}
    for r in got.collect():
        ids = docs[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(docs[r["doc_id"]])


def test_same_rows_again(spark, sf):
    pieces = op12.op12_packing(spark, sf)
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, pieces.collect()))


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 2048])
def test_cuts(capacity):
    for n in range(1, 5000, 7):
        parts = op12.cuts(n, capacity)
        assert sum(parts) == n and all(0 < p <= capacity for p in parts)
        assert sum(p < capacity for p in parts) <= 6


def test_classes_take_a_fixed_number():
    bins = op12.Bins(0, 64)
    rows = [r for k in range(200) for r in bins.put((k, 0, np.zeros(9, np.uint32), 9))]  # class 7
    assert len(rows) == 196 and all(sum(r[5] == s for r in rows) == 7 for s in {r[5] for r in rows})
    rest = list(bins.rest())
    assert sum(r[2] for r in rest) == 36 and sorted({s: sum(r[2] for r in rest if r[5] == s) for s in {r[5] for r in rest}}.values()) == [4, 32]


def test_odd_rows(spark):
    docs = odd.documents(spark)
    by_doc, padding = whole(op12.pack(docs, PATH).collect())
    n = {i: sum(len(p[1]) for p in parts) for i, parts in by_doc.items()}
    rows = docs.select("doc_id", "text").collect()
    want = defaultdict(int)
    for r, ids in zip(rows, ids_of([r["text"] for r in rows]), strict=True):
        want[r["doc_id"]] += len(ids)
    assert n == want and n[2] == n[3] == 1 and padding < 0.02
    assert op12.pack(odd.documents(spark, empty=True), PATH).count() == 0
    with pytest.raises(ValueError):
        op12.pack(docs, PATH, 0)


def test_sequences(spark, sf):
    pieces = spark.createDataFrame(op12.pack(spark.read.parquet(f"{sf}/documents.parquet"), PATH).collect(), op12.PIECES)
    held = defaultdict(dict)
    for r in pieces.collect():
        held[r["sequence_id"]][r["offset"]] = bytes(r["ids"])
    got = op12.sequences(pieces, pad_id=9).collect()
    assert len(got) == len(held)
    for r in got:
        ids = b"".join(held[r["sequence_id"]][k] for k in sorted(held[r["sequence_id"]]))
        n = len(ids) // 4
        assert r["n_ids"] == n and bytes(r["ids"]) == (ids if n & (n - 1) == 0 else ids + (2048 - n) * b"\x09\x00\x00\x00")
