"""Decontamination: planted copies against plain Smith-Waterman of all pairs, odd rows."""

from __future__ import annotations

import random

import odd
import pyarrow as pa

from quillon.llm import op8_decontaminate as op8
from quillon.llm.common import utf8, words


def align(a, b):
    """Best local alignment of two word lists, plainly."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for k, y in enumerate(b, 1):
            now.append(max(0, before[k - 1] + (op8.MATCH if x == y else op8.MISS), before[k] + op8.GAP, now[k - 1] + op8.GAP))
        best, before = max(best, *now), now
    return best


def made():
    r = random.Random(7)
    v = [f"w{k}" for k in range(300)]
    prose = lambda n: r.choices(v, k=n)
    items = [(k, prose(r.randint(8, 60))) for k in range(12)]
    docs = []
    for k, (_, w) in enumerate(items):
        edited = [x for x in w if r.random() > 0.08]
        for _ in range(len(w) // 12):
            edited[r.randrange(len(edited))] = r.choice(v)
        docs += [(3 * k, prose(80) + w + prose(40)), (3 * k + 1, prose(30) + edited + prose(30)), (3 * k + 2, prose(150))]
    return [(i, " ".join(w)) for i, w in items], [(i, " ".join(w)) for i, w in docs]


def test_planted(spark):
    items, docs = made()
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in op8.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for j, w in items:
            s = align(t.split(), w.split()) / (op8.MATCH * len(w.split()))
            if s >= op8.LEAST_SCORE:
                want[i, j] = s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_block_by_block(spark, monkeypatch):
    items, docs = made()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, op8.matches(docs, items).collect()))
    monkeypatch.setattr(op8, "BLOCK_WORDS", 100)
    assert sorted(map(tuple, op8.matches(docs, items).collect())) == one
    assert op8.clean(docs, items).count() == docs.count() - len({r[0] for r in one})


def test_hot_item(spark):
    item = "the ninth item of this benchmark asks which of the rivers flows into a lake"
    docs = spark.createDataFrame([(k, f"word{k} begins here and then {item} and so it ends number{k}" if k % 3 == 0 else f"other{k} prose about rivers and lakes") for k in range(600)], "doc_id long, text string")
    got = op8.matches(docs, spark.createDataFrame([(9, item)], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == set(range(0, 600, 3))


def test_heavily_edited_copies(spark):
    """Copies that keep one run of the item's seeds, in a third of the rows of a small and a larger table, and a single one."""
    item = [f"item{k}" for k in range(15)]
    copy = [f"new{k}" if k in (2, 5, 7, 9) else w for k, w in enumerate(item)]
    one = [f"new{k}" if k in (1, 3, 7, 9) else w for k, w in enumerate(item)]
    assert align(item, copy) == align(item, one) == 18
    items = spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    for n, held, edited in ((200, set(range(0, 200, 3)), copy), (200, {77}, copy), (900, set(range(0, 900, 3)), one)):
        docs = [(k, " ".join([f"w{k}", "begins", *(edited if k in held else ["item12", "item13", "item14"]), "and", f"ends{k}"])) for k in range(n)]
        got = op8.matches(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
        assert {r["doc_id"] for r in got} == held and all(abs(r["score"] - 0.6) < 1e-9 for r in got)


def test_odd_rows(spark):
    docs = odd.documents(spark)
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog", "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (None, "a text without any id", "x"), (1, "quick brown fox jumps over the lazy dog", "x")], "item_id long, text string, doc_id string")
    assert {(r["doc_id"], r["item_id"]) for r in op8.matches(docs, items).collect()} == {(1, 1), (7, 1)}
    kept = op8.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    none = odd.documents(spark, empty=True)
    assert op8.matches(none, items).count() == 0 and op8.matches(docs, items.limit(0)).count() == 0 and op8.clean(docs, items.limit(0)).count() == docs.count()


def edits(r, w, noise):
    """An item's words, edited in every way that may leave half of its score, by kind."""
    clauses = [w[k : k + 7] for k in range(0, len(w), 7)]
    r.shuffle(clauses)
    swap = lambda share: [r.choice(noise) if r.random() < share else x for x in w]
    return {
        "verbatim": w,
        "a tenth replaced": swap(0.1),
        "three tenths replaced": swap(0.3),
        "every third replaced": [r.choice(noise) if k % 3 == 2 else x for k, x in enumerate(w)],
        "a word after every second": [y for k, x in enumerate(w) for y in ([x, r.choice(noise)] if k % 2 else [x])],
        "a word after every word": [y for x in w for y in (x, r.choice(noise))],
        "every fourth left out": [x for k, x in enumerate(w) if k % 4 != 3],
        "the first half": w[: len(w) // 2 + 1],
        "clauses shuffled": sum(clauses, []),
    }


def test_recall_by_kind_of_edit(spark, sf):
    """Every alignment of half the score or more is found, whatever the kind of edit, and nothing else."""
    r = random.Random(12)
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:30] + [(900, "one two three"), (901, "of the of the of the end"), (902, "alpha beta gamma delta epsilon")]
    noise = [w for x in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000").limit(60).collect() for w in (x["text"] or "").lower().split()]
    docs, kinds = [], []
    for _, text in items:
        for kind, w in edits(r, text.lower().split(), noise).items():
            at = r.randrange(len(noise) - 60)
            docs.append((len(docs), " ".join(noise[at : at + 25] + w + noise[at + 25 : at + 50])))
            kinds.append(kind)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in op8.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hashed = lambda t: words(*utf8(pa.array([t]))).hashes
    pairs = [(d, i, hashed(t), hashed(x)) for d, t in docs for i, x in items]
    want = {}
    for k in range(0, len(pairs), 512):
        part = pairs[k : k + 512]
        for (d, i, _, x), s in zip(part, op8.smith_waterman([p[2] for p in part], [p[3] for p in part])[0], strict=True):
            if s / (op8.MATCH * len(x)) >= op8.LEAST_SCORE:
                want[d, i] = s / (op8.MATCH * len(x))
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    seen = {k: sum(kinds[d] == k for d, _ in want) for k in set(kinds)}
    assert all(seen[k] >= 20 for k in ("verbatim", "a tenth replaced", "a word after every second", "every fourth left out", "the first half")), seen
    assert seen["every third replaced"] > 0 and seen["a word after every word"] > 0, seen
