"""Personal data: base spans against plain patterns, disclosing terms against plain counting, odd rows."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import odd

from quillon.llm import op6_pii as op6

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TRICKY = [
    "a@b.c_x@y.z a@b.c.@d.e x@@y.z .@a.b a@b @c.d ä@b.cé.d", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004 1..2.3.4 12.3.4 999.1.2.3.4.5",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 4 1 1 1-1-1-1 11111111 1", "+49 (30) 123-456 +1.2 +12 345 678 901 234 567 +123456789- +(12)345678901 😀+44 20 7946 0958",
    "😀 mail me@x.org 😀 ip 10.0.0.1", "0" * 3000, "+" * 500 + "1" * 3000, "a" * 20_000 + "@", "a." * 5000,
]


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (2 * x > 9) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PLAIN.items():
        if kind == "email" and "@" not in text[:-1]:
            continue
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if fine:
                out.append((kind, m.start(), m.end(), m[0]))
    return out


def line(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def test_base_spans(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [(10_000 + k, t) for k, t in enumerate(TRICKY)]
    got = {r["doc_id"]: r for r in op6.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        spans, r = base(t or ""), got[i]
        assert [r[f"n_{k}"] for k in op6.KINDS] == [sum(s[0] == k for s in spans) for k in op6.KINDS], t[:200]
        assert r["base_sha256"] == hashlib.sha256(line(spans).encode()).hexdigest()
        assert r["spans"].startswith(line(spans))


def terms(docs):
    """Spans of disclosing terms by text, counted plainly."""
    df, df_e, co, places = Counter(), Counter(), Counter(), defaultdict(set)
    for i, t in docs:
        spans = base(t)
        df.update(set(re.findall(r"[^\W\d_]{3,}", t.lower())))
        df_e.update({(s[0], s[3].lower()) for s in spans})
        pairs = set()
        for s in spans:
            for m in re.finditer(r"[^\W\d_]{3,}", t):
                a, b = m.start(), m.end()
                left = b <= s[1] and (a > s[1] - op6.WINDOW or a >= 0 and s[1] <= op6.WINDOW)
                right = a >= s[2] and b < s[2] + op6.WINDOW
                if (left or right) and not any(a < x[2] and x[1] < b for x in spans):
                    pair = ((s[0], s[3].lower()), m[0].lower())
                    pairs.add(pair)
                    places[i].add((a, b, pair))
        co.update(pairs)
    n = len(docs)
    told = {p for p, c in co.items() if c >= op6.LEAST_SUPPORT and df[p[1]] >= op6.LEAST_SUPPORT and c >= op6.LEAST_SHARE * df[p[1]] and math.log2(c * n / (df[p[1]] * df_e[p[0]])) >= op6.LEAST_BITS}
    return {i: sorted({(a, b) for a, b, p in x if p in told}) for i, x in places.items()}


def corpus():
    docs = [(k, f"Plain words number{k} without anything personal, just prose about birds.") for k in range(120)]
    docs += [(200 + k, f"Zorblatt Quimbly wrote from jane@corp.org today, and Zorblatt replied {k} times.") for k in range(4)]
    docs += [(300 + k, "Contact office at info@shop.net or +49 30 1234567 about birds.") for k in range(3)]
    return docs


def test_terms(spark):
    docs = corpus()
    want = terms(docs)
    assert any(want.values())
    for r in op6.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got = [tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term")]
        assert got == want.get(r["doc_id"], []), r["spans"]


def test_sanitise(spark):
    docs = odd.documents(spark, corpus())
    got = op6.sanitise(docs)
    assert got.columns == docs.columns and got.count() == docs.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    text = rows[200]["text"]
    assert "jane@" not in text and "[EMAIL]" in text and "Zorblatt" not in text and rows[200]["n_chars"] == len(text)
    assert rows[5]["text"] == "1234 !!! 5678" and rows[2]["text"] is None and rows[6]["text"] == odd.LONG
    none = odd.documents(spark, empty=True)
    assert op6.sanitise(none).count() == 0 and op6.digests(none).count() == 0


def test_entities_seen_once(spark):
    """No address comes twice; their domain tells the terms, far from the address, however written and in any text."""
    docs = [(k, f"Plain words number{k} without anything personal, just prose about birds.") for k in range(120)]
    docs += [(200 + k, f"Zorblatt {'prose about birds ' * 20} is at jane{k}@corp.org") for k in range(4)]
    docs += [(300, "Plain words about birds; ZORBLATT, 😀 zorblatt and Zorblatts.")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r["doc_id"]: [s for s in r["spans"].split(",") if s.startswith("term")] for r in op6.digests(docs).collect()}
    assert spans[200] == ["term:0:8"] and spans[300] == ["term:25:33", "term:37:45"] and not spans[0]
    text = {r["doc_id"]: r["text"] for r in op6.sanitise(docs).collect()}
    assert text[300] == "Plain words about birds; [TERM], 😀 [TERM] and Zorblatts." and "Zorblatt" not in text[203] and "Plain words number5" in text[5]


def test_odd_rows(spark):
    docs = odd.documents(spark)
    got = op6.digests(docs).collect()
    assert len(got) == docs.count()
    assert all(r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in got)


def outputs(plan):
    """Columns that each exchange of a plan sends."""
    own = [plan.output().mkString(" ")] if plan.nodeName() in ("Exchange", "BroadcastExchange") else []
    return own + [x for k in range(plan.children().size()) for x in outputs(plan.children().apply(k))]


def test_texts_are_not_sent(spark, monkeypatch):
    """At a size where no side is small enough to be sent out by itself, texts stay where they are read; terms in several passes give the same."""
    docs = spark.createDataFrame(corpus() + [(None, "Zorblatt"), (None, "Zorblatt"), (400, "a Zorblatt, zorblatt")], "doc_id long, text string")
    want = sorted(op6.digests(docs).collect(), key=str)
    for key, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(key, value)
    try:
        sent = outputs(op6.revealing(docs)._jdf.queryExecution().executedPlan())
        assert len(sent) > 1 and not any("text" in x for x in sent), sent
        monkeypatch.setattr(op6, "LISTED", 1, raising=False)
        assert sorted(op6.digests(docs).collect(), key=str) == want
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
