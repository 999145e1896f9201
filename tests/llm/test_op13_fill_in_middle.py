"""Fill-in-the-middle against a plain version, its SQL, and the way back."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import odd
import pyarrow as pa
from compare import connection, difference
from pyspark.sql import functions as F

from quillon.llm import op13_fill_in_middle as op13
from quillon.llm.common import utf8

STRINGS = ["a", "é", "😀", "ab cd", "x<P>y", "<S>", "a<M>", "<P", "S>x<", "<<P", "日本語 words é end😀", "\n\t ", "abc" * 50, "ééé" * 40, "a\x00b"]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    spm = h[3] % 100 < 20
    return n, "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def check(docs):
    turned = op13.fill_in_middle(docs).withColumn("back", op13.restored())
    got = sorted(((str(r["doc_id"]), r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in turned.collect()), key=repr)
    assert got == sorted(((str(r["doc_id"]), *brute(r["doc_id"], r["text"]), r["text"] or "") for r in docs.collect()), key=repr)


def test_strings(spark):
    r = random.Random(4)
    made = ["".join(r.choices("abcXYZ .<>PSMé日😀\n", k=r.randint(0, 40))) for _ in range(1500)]
    check(spark.createDataFrame(list(enumerate(STRINGS * 5 + made)), "doc_id long, text string").repartition(3))


def test_odd_rows(spark):
    check(odd.documents(spark))
    assert op13.fill_in_middle(odd.documents(spark, empty=True)).count() == 0


def test_query(spark, sf, tmp_path):
    con = connection(sf)
    assert not difference(op13.op13_fill_in_middle(spark, sf), con, op13.ORACLE)
    assert op13.op13_fill_in_middle(spark, sf).where(F.col("form") == "plain").count() > 0
    spark.createDataFrame(list(enumerate(STRINGS)) + [(None, "no id here"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert not difference(op13.op13_fill_in_middle(spark, str(tmp_path)), con, op13.ORACLE)


def test_exceptions():
    for text in STRINGS:
        data, _ = utf8(pa.array([text]))
        index = op13.Exceptions(data)
        at = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
        assert index.to_chars(at).tolist() == list(range(len(text) + 1))
        assert index.to_bytes(np.arange(len(text) + 1)).tolist() == at.tolist()
        assert len(index.bytes) == sum(ord(c) > 127 for c in text)
