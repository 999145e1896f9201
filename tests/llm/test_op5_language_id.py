"""Language: code lengths against a plain version, accuracy on rows that were held out, odd rows."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import odd
import pyarrow as pa

from quillon.llm import op5_language_id as op5


def normal(text):
    """Runs of anything but letters (in ASCII) as one space, in bytes behind three spaces of context."""
    out = b""
    for x in text.lower().encode():
        x = x if x >= 128 or chr(x).isalpha() else 32
        if x != 32 or not out.endswith(b" "):
            out += bytes([x])
    return b"   " + out


def plain_counts(texts):
    counts: dict[bytes, Counter] = defaultdict(Counter)
    for t in texts:
        s = normal(t)
        for k in range(3, len(s)):
            for o in range(4):
                counts[s[k - o : k]][s[k]] += 1
    return counts


def plain_bits(counts, text):
    s, bits = normal(text), 0.0
    for k in range(3, len(s)):
        for o in (3, 2, 1, 0, -1):
            if o < 0:
                bits += 8
                break
            seen = counts.get(s[k - o : k])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if s[k] in seen:
                bits -= math.log2(seen[s[k]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths_are_exact():
    train, text = ["abra cadabra", "candelabra!"], "Bra xab"
    codes, n = np.unique(op5.contexts(pa.array(train))[0], return_counts=True)
    tree = op5.Tree(codes, n)
    assert abs(float(tree.bits(op5.contexts(pa.array([text]))[0]).sum()) - plain_bits(plain_counts(train), text)) < 1e-3


def test_predictions_equal_plain_ones(spark):
    """Language and score against a plain version that learns from the same rows (all of them, as they are few)."""
    said = {"en": ["the cat sat on the mat", "a house by the river, where no one lived", "it was not the end 123"], "de": ["die Katze saß auf der Matte", "ein Haus am Fluß, in dem keiner wohnte"], "fr": ["le chat était sur le tapis", "une maison près de la rivière"]}
    rows = [(10 * k + j, t, lang) for k, (lang, texts) in enumerate(said.items()) for j, t in enumerate(texts)]
    asked = [(100, "the mat by the house"), (101, "der Fluß"), (102, "la maison"), (103, "x"), (104, "  Zebra zebra  "), (105, "2024!"), (106, "ça")]
    trees = op5.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2))
    models = {lang: plain_counts(texts) for lang, texts in said.items()}
    for r in op5.predict(spark.createDataFrame([*asked, *[(i, t) for i, t, _ in rows]], "doc_id long, text string"), trees).collect():
        text = dict([*asked, *[(i, t) for i, t, _ in rows]])[r["doc_id"]]
        bits = {lang: plain_bits(m, text) for lang, m in models.items()}
        best = min(sorted(bits), key=bits.get)
        score = 1 / sum(2 ** max(bits[best] - x, -1000) for x in bits.values())
        want = (best, round(score, 3)) if any(c.isalpha() for c in text) else ("und", 0.0)
        assert (r["lang_pred"], round(r["score"], 3)) == want


def test_sample_is_bounded(spark):
    rows = [(k, "t", "en" if k % 3 else "de") for k in range(3000)]
    got = {r["lang"]: r["count"] for r in op5.chosen(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200).groupBy("lang").count().collect()}
    assert set(got) == {"en", "de"} and all(150 < n <= 200 for n in got.values())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in op5.op5_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for i, r in got.items())
    cases = [(r["lang"], got[r["doc_id"]]["lang_pred"]) for r in docs if r["lang"] is not None and got[r["doc_id"]]["held_out"] and any(c.isalpha() for c in r["text"] or "")]
    assert sum(a == b for a, b in cases) / len(cases) > 0.97


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = op5.predict(docs, op5.train(docs)).collect()
    assert len(got) == docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (2, 3, 4, 5))
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 6, 7)} == {"en"}
    other = odd.documents(spark, [(50 + k, t) for k, t in enumerate(["Это другой язык", "他の言語のテキスト"])])
    assert not other.where("doc_id >= 50").join(op5.keep_languages(other.withColumn("lang", op5.F.when(op5.F.col("doc_id") < 50, op5.F.col("lang")))), "doc_id").count()
    kept = op5.keep_languages(docs)
    assert kept.columns == docs.columns and kept.count() == 6
    none = odd.documents(spark, empty=True)
    assert op5.predict(none, op5.train(none)).count() == 0
    assert {r["lang_pred"] for r in op5.predict(docs, {}).collect()} == {"und"}
