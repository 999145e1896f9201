"""BPE against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import struct
import time

import odd
from tokenizers import Tokenizer

from quillon.llm import common
from quillon.llm import op4_bpe as op4

STRINGS = ["", " ", "Hello, WORLD!", "don't  can't I'LL", "naïve café Σίσυφος ΟΔΟΣ", "İstanbul ǅ ﬁ", "日本語 テスト", "a<|endoftext|>b <|startoftext|>", "<|EndOfText|>", "😀👩‍👩‍👧 x", "é é", "12345 6.7e-8", "aaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "\x00\x01​﻿", "ﷺ ǰ ß ẞ"]


def brute(texts):
    t = Tokenizer.from_file(op4.tokenizer_path())
    t.no_truncation()
    t.no_padding()
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def digest(ids, text):
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def strings():
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz" * 3 + "éüßñ'’.-_0123456789 \n" + "日한Ж"
    return STRINGS + ["".join(r.choices(letters, k=r.randint(1, 80))) for _ in range(1500)]


def test_strings():
    texts = strings()
    own = list(op4._coded(op4.tokenizer_path(), iter([batch(texts)])))
    for text, (_, coded, decoded), ids, back in zip(texts, own, *brute(texts), strict=True):
        assert memoryview(coded).cast("I").tolist() == ids, text
        assert decoded == back


def batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def test_documents_and_odd_rows(spark, sf):
    path = op4.tokenizer_path()
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd.documents(spark)):
        rows = docs.collect()
        want = sorted([(str(r["doc_id"]), *digest(i, t)) for r, i, t in zip(rows, *brute([r["text"] for r in rows]), strict=True)])
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op4.digests(docs, path).collect()) == want
    assert op4.digests(odd.documents(spark, empty=True), path).count() == 0


def test_decode(spark, sf):
    path = op4.tokenizer_path()
    coded = op4.encode(spark.read.parquet(f"{sf}/documents.parquet"), path)
    held = {r["doc_id"]: r["decoded"] for r in coded.collect()}
    assert held == {r["doc_id"]: r["text"] for r in op4.decode(coded, path).collect()}
    assert op4.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), path).first()["text"] == ""


def test_long_words_in_linear_time():
    """A word four times as long takes about four times as long, and is encoded right."""
    trie = op4.coder(op4.tokenizer_path()).trie
    r = random.Random(8)
    took = []
    for n in (50_000, 200_000, 800_000):
        word = "".join(r.choices("abcdefghijk", k=n))
        began = time.process_time()
        tokens = trie.encode([word])[word]
        took.append(time.process_time() - began)
        assert "".join(tokens) == word + trie.end
    assert took[2] < 10 * took[1] + 1 and took[1] < 10 * took[0] + 1
    text = "".join(r.choices("abcdefghijk", k=20_000))
    ((_, coded, _),) = op4._coded(op4.tokenizer_path(), iter([batch([text])]))
    assert memoryview(coded).cast("I").tolist() == brute([text])[0][0]


def test_cache_is_bounded_and_dropped(monkeypatch):
    """Small caches give the same ids, and another operator's task frees the coder."""
    monkeypatch.setattr(op4, "CACHE_BYTES", 4000)
    monkeypatch.setattr(op4, "CACHE_PAIRS", 50)
    list(common.chunks(iter([batch(["x"])]), "text"))
    own, texts, most = op4.coder(op4.tokenizer_path()), strings(), 0
    for (text, row), ids in zip(zip(texts, op4._coded(op4.tokenizer_path(), (batch([t]) for t in texts)), strict=True), brute(texts)[0], strict=True):
        assert memoryview(row[1]).cast("I").tolist() == ids, text
        most = max(most, len(own.known) + len(own.older), len(own.trie.follows))
    assert most < 200 and op4.coder(op4.tokenizer_path()) is own
    list(common.chunks(iter([batch(["x"])]), "text"))
    assert op4.coder(op4.tokenizer_path()) is not own
