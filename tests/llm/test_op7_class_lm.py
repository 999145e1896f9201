"""Class language model: base scores against plain counting, classes of a toy language, odd rows."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import odd
import pyarrow as pa

from quillon.llm import op7_class_lm as op7


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), None]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check(rows, got):
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    total, kinds = sum(c.values()), len(c)
    want = sorted((str(i), len(t := tokens(text)), sum(c[x] > 0 for x in t), total, round(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in t), 5)) for i, text in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want


def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op7.op7_class_lm(spark, sf).collect()
    check(rows, got)
    assert all(r["held_out"] == held(r["doc_id"]) and r["score"] < 0 for r in got)
    assert sum(r["score"] - r["base_score"] for r in got if r["held_out"]) > 0


def brute(rows, model, classes, counts):
    """Scores worked out plainly from the class of each word: a word is an item if the model's lexicon has it."""
    items = set(model.items.known.tolist())
    own = lambda t: classes.get(t)
    coded = [(i, hashes(text)) for i, text in rows]
    total, kinds = sum(counts.values()), len(counts)
    mass, once = np.zeros(op7.CLASSES), np.zeros(op7.CLASSES)
    for t, n in counts.items():
        mass[own(t)] += n + 1
        once[own(t)] += n == 1
    assert once[model.unknown] == once.max()
    mass[model.unknown] += 1
    steps = np.full((op7.CLASSES + 1, op7.CLASSES), 0.1)
    for i, ts in coded:
        if held(i):
            continue
        for k, t in enumerate(ts):
            before = ts[k - 1] if k else None
            if before is None:
                steps[op7.CLASSES, own(t)] += 1
            elif before in items or t in items:
                steps[own(before), own(t)] += 1
    steps[:, mass == 0] = 0
    steps /= steps.sum(1, keepdims=True)
    out = []
    for i, ts in coded:
        last, s = op7.CLASSES, 0.0
        for t in ts:
            c = own(t) if t in counts else model.unknown
            s += math.log10((counts.get(t, 0) + 1) * (op7.MIX * steps[last, c] / mass[c] + (1 - op7.MIX) / (total + kinds + 1)))
            last = c
        out.append((str(i), round(s, 4)))
    return sorted(out)


def hashes(text):
    return op7._tokens(pa.array([text], pa.string()))[0].tolist()


def fitted(spark, rows, most):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model, others = op7.train(docs.where(~(op7.fold("doc_id", 7) == 2)), most)
    counts = Counter(t for i, text in rows if not held(i) for t in hashes(text))
    classes = dict(zip(model.items.known.tolist(), model.own[model.items.value].tolist(), strict=True))
    assert all(counts[t] == n for t, n in zip(model.items.known.tolist(), model.counts[model.items.value].tolist(), strict=True))
    for r in others.collect():
        t = int(np.array([r["word"]], np.int64).view(np.uint64)[0])
        assert t not in classes and counts[t] == r["n"]
        classes[t] = r["class"]
    assert set(classes) == set(counts)
    return docs, model, others, classes, counts


def test_scores_equal_plain_ones(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(None, None), (7, "unseen0 unseen1 the"), (9, "unseen0 unseen2 the")]
    for most in (op7.ITEMS, 700):  # with few items most words get their classes by their contexts
        docs, model, others, classes, counts = fitted(spark, rows, most)
        assert len(model.items.known) <= most
        got = op7.score(docs, model, others).collect()
        check(rows, got)
        assert sorted((str(r["doc_id"]), round(r["score"], 4)) for r in got) == brute(rows, model, classes, counts)


def test_probabilities_sum_to_one(spark):
    _, model, _, classes, counts = fitted(spark, [(0, "a b c a b d e"), (3, "b c a x y z"), (4, "")], 5)
    mass = np.zeros(op7.CLASSES)
    for t, n in counts.items():
        mass[classes[t]] += n + 1
    mass[model.unknown] += 1
    assert np.allclose((10.0**model.factor * mass).sum(1), 1)


def test_words_of_one_class_come_together(spark):
    """Texts go round four kinds of words; what is learned keeps the kinds apart, for items and for other words."""
    r = np.random.default_rng(5)
    rows = [(k, " ".join(f"w{j % 4}x{int(300 * r.random() ** 2)}" for j in range(400))) for k in range(400)]
    _, model, _, classes, counts = fitted(spark, rows, 900)
    kind = {hashes(f"w{j}x{k}")[0]: j for j in range(4) for k in range(300)}
    held_by = Counter()
    for t, n in counts.items():
        if t in kind:
            held_by[classes[t], kind[t]] += n
    best = sum(max(held_by[c, j] for j in range(4)) for c in range(op7.CLASSES))
    assert best >= 0.95 * sum(held_by.values())


def test_exchange_finds_the_classes():
    r = np.random.default_rng(2)
    pairs = np.zeros((13, 12), np.int64)
    for _ in range(4000):  # even and odd items take turns
        a = r.integers(6) * 2
        pairs[a, r.integers(6) * 2 + 1] += 1
        pairs[r.integers(6) * 2 + 1, a] += 1
    own = op7.exchange(pairs, classes=2)
    assert len(set(own[::2])) == 1 and len(set(own[1::2])) == 1 and own[0] != own[1]


def test_odd_rows(spark):
    docs = odd.documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    check(rows, op7.score(docs, *op7.train(docs.where(~(op7.fold("doc_id", 7) == 2)))).collect())
    none = odd.documents(spark, empty=True)
    assert op7.score(none, *op7.train(none)).count() == 0
    assert op7.score(docs, *op7.train(none)).count() == docs.count()


def test_contexts_are_packed(monkeypatch):
    """The passes of clustering read a few rows that hold the contexts of many items, not a row each; no item lies in two, and nothing is lost."""
    monkeypatch.setattr(op7, "PACKED", 500, raising=False)
    r = np.random.default_rng(3)
    item, context, n = r.integers(0, 90, 4000).astype(np.int32), r.integers(0, 1 << 21, 4000).astype(np.int32), r.integers(1, 1 << 40, 4000)
    context[item == 7] = 5  # one item with many
    item[:700] = 7
    sent = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 900]) for x in (item, context, n)], names=["item", "context", "n"]) for k in range(0, 4000, 900)]
    packed = list(op7._gather(iter(sent)))
    assert 1 < sum(b.num_rows for b in packed) < 20 and not list(op7._gather(iter([sent[0].slice(0, 0)])))
    held = list(op7._held(iter(packed)))
    assert sorted(x for own, *_ in held for x in own) == sorted(set(item.tolist()))
    got = sorted((own[k], c, m) for own, row, context, n in held for k, c, m in zip(row, context, n, strict=True))
    assert got == sorted(zip(item, context, n, strict=True))
