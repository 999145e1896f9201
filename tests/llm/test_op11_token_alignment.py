"""Cross-tokenizer alignment against a plain version on the libraries' own encodings."""

from __future__ import annotations

import functools
import hashlib
import random
from collections import Counter

import numpy as np
import odd
import sentencepiece
from tokenizers import Tokenizer

from quillon.llm import op11_token_alignment as op11
from quillon.llm.byte_bpe import ByteVocabulary
from quillon.llm.op4_bpe import alphabet, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
STRINGS = ["Hello, world!", " leading and trailing ", "a▁b", "<s>x</s> <unk> <0x41>", "<|endoftext|> here", "naïve Σίσυφος ß ﬁ", "日本語 テスト", "😀👩‍👩‍👧 x", "a\x00b\r\n\tc", "  two   spaces", "\n\n", "é é", "x" * 700]


@functools.cache
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text):
    """(id, bytes) of both tokenizers; nothing where they don't spell space + text."""
    if not text:
        return [], []
    t, s = libraries()
    byte = {c: b for b, c in enumerate(alphabet())}
    a = [(i, bytes(byte[c] for c in t.id_to_token(i))) for i in t.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()) for i in s.encode(text) for p in [s.id_to_piece(i)]]
    whole = (" " + text).encode()
    return (a, b) if all(b"".join(x for _, x in y) == whole for y in (a, b)) else ([], [])


def spans(coded):
    at, out = 0, []
    for i, x in coded:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def brute(texts):
    docs = []
    for text in texts:
        a, b = map(spans, tokens(text))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 2000 else merged(a, b)
        common = sorted({x[2] for x in a} & {y[2] for y in b})
        at, groups = 0, []
        for end in common:
            groups.append(",".join(str(x[0]) for x in a if at < x[2] <= end) + "|" + ",".join(str(y[0]) for y in b if at < y[2] <= end))
            at = end
        docs.append((len(a), len(b), len(common), links, ";".join(groups)))
    held = Counter(p for d in docs for p in set(d[3]))
    best: dict[int, int] = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return [(d[0], d[1], d[2], len(d[3]), sum(held[p] == best[p[0]] for p in d[3]), sum(held[p] for p in d[3]), hashlib.sha256(d[4].encode()).hexdigest() if d[4] else "") for d in docs]


def merged(a, b):
    """The links of long texts, by walking along both."""
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        x, y = a[i][2], b[j][2]
        i, j = i + (x <= y), j + (y <= x)
    return out


def check(docs, a=A, b=B):
    rows = docs.collect()
    want = sorted((str(r["doc_id"]), *w) for r, w in zip(rows, brute([r["text"] for r in rows]), strict=True))
    got = sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in op11.aligned(docs, a, b).collect())
    assert got == want


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_strings(spark):
    r = random.Random(3)
    made = ["".join(r.choices("abcdefghij    ..,éß日\n", k=r.randint(1, 60))) for _ in range(120)]
    check(frame(spark, STRINGS + made + made[:30]))


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    check(docs)


def test_rare_pairs_are_joined(spark, monkeypatch):
    """With few pairs sent out and short buffers, the rest comes by the join, with the same rows."""
    monkeypatch.setattr(op11, "FREQUENT", 8)
    monkeypatch.setattr(op11, "HELD_PAIRS", 16)
    check(frame(spark, ["the cat sat on the mat"] * 9 + ["the dog sat", "a cat and a dog"] + STRINGS))


def test_odd_rows(spark):
    docs = odd.documents(spark).where("doc_id IS NULL OR doc_id < 6 OR doc_id = 7")
    check(docs)
    long = {r["doc_id"]: r for r in op11.aligned(odd.documents(spark), A, B).collect()}
    assert long[6]["n_links"] >= long[6]["n_a"] > 200_000 and long[8]["n_groups"] > 0
    assert op11.aligned(odd.documents(spark, empty=True), A, B).count() == 0


def test_groups(spark):
    docs = frame(spark, STRINGS)
    texts = dict(map(tuple, docs.collect()))
    for r in op11.grouped(docs, A, B).collect():
        a, b = map(spans, tokens(texts[r["doc_id"]]))
        assert (r["a_ids"], r["b_ids"]) == ([x[0] for x in a], [x[0] for x in b])
        common = sorted({x[2] for x in a} & {y[2] for y in b})
        for groups, own in ((r["a_groups"], a), (r["b_groups"], b)):
            assert groups == [sum(c < x[2] for c in common) for x in own]


def test_doubling():
    """Tokens chained over the whole text: a component as long as there can be."""
    n = 5000
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    last_a, last_b = op11.terminals(a, b)
    assert set(last_a) == set(last_b) == {n}


def test_vocabulary_falls_back():
    """Where one library's pattern runs out of its stack, the other gives the ids."""
    t = Tokenizer.from_file(A)
    for special in (True, False):
        t.encode_special_tokens = not special
        for text in ("\n" * 2_000_000 + "a", "a<|endoftext|>b", " <|endoftext|><|endoftext|>"):
            assert ByteVocabulary(A, special).encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
