"""Main text of pages: generated pages with known article nodes, one page by hand, odd rows."""

from __future__ import annotations

import itertools
import random
import time
from html.parser import HTMLParser

import numpy as np
import pytest

from quillon.llm import op1_html_text as op1
from quillon.llm.html_nodes import features, parse

PAGE = """<html><head><title>no</title><style>p{}</style></head><body><nav class="menu"><a href="/">Home</a> <a href="/a">About</a></nav>
<article><h1>Birds &amp; trees</h1><p>The first
  paragraph has several words, enough of them to be taken for prose.</p><div class="ad">Buy now our product</div>
<p>The second&nbsp;one is as long as the first, and it ends the article here &#8364;.</p></article>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this text a lot, thank you.</p></div></section>
<footer>Copyright somebody</footer><script>var x = "<p>no</p>";</script></body></html>"""


@pytest.fixture(scope="module")
def model():
    return op1.train()


def run(spark, model, rows):
    return op1.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"), model)


def test_nodes_of_generated_pages(model):
    made = op1.Generator(99)
    right = total = 0
    for _ in range(100):
        nodes = parse(made.page())
        marks: list[int] = []
        for n in nodes:
            marks.append(int(n.mark) if n.mark else marks[n.parent] if n.parent >= 0 else 1)
        right += ((model.logits(features(nodes)) > 0) == np.array(marks, bool)).sum()
        total += len(nodes)
    assert right / total > 0.97


def test_page(spark, model):
    got = run(spark, model, [(1, "u", PAGE, "x", 1)]).first()
    assert got["text"].split("\n\n") == [
        "Birds & trees", "The first paragraph has several words, enough of them to be taken for prose.",
        "The second one is as long as the first, and it ends the article here €.",
    ]
    assert got["n_chars"] == len(got["text"])


def test_odd_rows(spark, model):
    deep = "<div>" * 3000 + "<p>deep words stand here</p>" + "</div>" * 3000
    rows = [(1, None, None, "x", 1), (2, "u", "", "x", 1), (None, "u", "<p", "x", 1), (3, "u", PAGE, "x", 1), (3, "u", PAGE, "x", 1), (4, "u", deep, "x", 1), (5, "u", "<p>" + "word " * 300_000, "x", 1)]
    got = run(spark, model, rows).collect()
    assert len(got) == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert len({r["text"] for r in got if r["page_id"] == 3}) == 1
    assert run(spark, model, []).count() == 0


def test_whole_table(spark, sf):
    got = op1.op1_html_text(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/pages.parquet").count()


class Shown(HTMLParser):
    """All text outside of elements that are not shown, by the parser of the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.text = None, ""

    def handle_starttag(self, tag, attrs):
        if self.hidden is None and tag in ("script", "style", "title", "noscript", "iframe", "template", "textarea"):
            self.hidden = tag

    def handle_endtag(self, tag):
        if tag == self.hidden:
            self.hidden = None

    def handle_data(self, data):
        if self.hidden is None:
            self.text += data


def test_parser_loses_and_adds_no_text():
    """Random markup, elements closed or not: the blocks of all leaves hold exactly what another parser shows."""
    r = random.Random(4)
    tags = ["p", "div", "b", "a href=/x/", "li", "ul", "td", "tr", "table", "span class='q w'", "h2", "svg", "select", "option", "math", 'i title="a > b"', "object", "canvas"]
    for _ in range(300):
        page = ""
        for _ in range(r.randint(1, 40)):
            k = r.random()
            tag = r.choice(tags)
            page += f"<{tag}>" if k < 0.35 else f"</{tag.split()[0]}>" if k < 0.6 else f"w{r.randint(0, 99)} &amp; x " if k < 0.9 else r.choice(["<br>", "<script src=/a/b/>var x = 1</script>", "<!-- c -->", "<style>p {}</style>", "<img src=/x/ >", "<hr/>"])
        plain = Shown()
        plain.feed(page)
        plain.close()
        assert "".join("".join(n.text for n in parse(page) if n.text).split()) == "".join(plain.text.split())


def test_slashes_in_attributes():
    nodes = parse("<div><a href=/foo/>in</a> out of links, all of it</div><script src=/a/b/>var hidden = 1</script><p>end")
    assert [(n.text, n.links) for n in nodes if n.text] == [("in out of links, all of it", 2), ("end", 0)]


def test_decoding_is_the_most_likely_consistent_set():
    """Against all consistent labellings of small trees."""
    r = random.Random(6)
    for _ in range(40):
        nodes = parse("".join(r.choice(["<div>", "</div>", "word ", "<p>"]) for _ in range(9)))[:9]
        logits = [r.uniform(-3, 3) for _ in nodes]
        best = max((k for k in itertools.product([0, 1], repeat=len(nodes)) if all(k[n.parent] or not k[i] for i, n in enumerate(nodes) if i)), key=lambda k: sum(-np.log1p(np.exp(-x if y else x)) for x, y in zip(logits, k, strict=True)))
        want = [n.text for n, y in zip(nodes, best, strict=True) if n.text and y and best[n.parent]] if best[0] else None
        if want is not None:
            assert op1.decode(nodes, logits) == "\n\n".join(want)


@pytest.mark.parametrize("page", ["<svg>" * 50_000, "x</b>" * 50_000, "<iframe>" * 50_000, "<b>" * 50_000 + "<div></div>" * 20_000, "<" * 200_000, "<a " * 100_000, "<ul><li>" * 400 + "<div>" * 400 + "<li>x" * 20_000])
def test_time_is_linear(page):
    began = time.perf_counter()
    features(parse(page))
    assert time.perf_counter() - began < 10


def test_pages_of_the_table(model):
    """Held-out pages, none of them made by the generator: the text is that of the one article element, as another parser reads it."""
    import pyarrow.parquet as pq

    rows = [h for h in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist() if h and h.count("<article") == 1]
    right = 0
    for h in rows:
        plain = Shown()
        plain.feed(h[h.index("<article") : h.index("</article>")])
        plain.close()
        nodes = parse(h)
        right += "".join(op1.decode(nodes, model.logits(features(nodes)).tolist()).split()) == "".join(plain.text.split())
    assert len(rows) > 100 and right / len(rows) > 0.98
