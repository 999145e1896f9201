"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block-level node of a page gets features (tags and attribute words of itself and of what it stands in, text and link density of
its subtree, depth, siblings, place). Boosted trees, trained on PAGES pages of a built-in generator that
marks its own article nodes, give each node a probability of belonging to the article. Decoding takes the most
likely set of nodes in which nothing below a dropped node is kept, so that ancestors and descendants never
contradict each other. The kept text blocks follow in page order.

Null and empty pages, and pages without an article: empty text. Very long and very deep pages are taken whole. Broken markup is closed
as browsers do it in the common cases. Null page_ids and urls, and repeated rows, are passed through; ties in decoding keep the node.
Empty table: no rows. Clashing further columns are not read.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table
from .html_nodes import Node, features, parse

#: Generated training pages, and the shape of the boosted trees.
PAGES, TREES, DEPTH, BINS, RATE = 500, 60, 4, 24, 0.25
TEXTS = "page_id long, url string, text string, n_chars long"


class Generator:
    """Pages whose article nodes carry data-mark="1" and all others "0"."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        syllables = ["ka", "lo", "mi", "ren", "tu", "sa", "vo", "the", "er", "qui", "pa", "nor", "el", "da", "is", "um"]
        out = ["".join(self.r.choices(syllables, k=self.r.choice([1, 1, 2, 2, 3]))) for _ in range(self.r.randint(low, high))]
        text = ""
        for k, w in enumerate(out):
            text += (w if k else w.capitalize()) + self.r.choices(["", ",", "."], [8, 1, 1])[0] + " "
        return text.strip() + self.r.choice([".", ".", "", "!"])

    def tag(self, name: str, body: str, mark: int, classes: list[str] | None = None) -> str:
        noise = self.r.choice(["", "", f"c{self.r.randint(1, 99)}", "row", "col-8", "wrap", "box", "inner", "clearfix"])
        own = " ".join(x for x in ((self.r.choice(classes) if classes and self.r.random() < 0.85 else ""), noise) if x)
        attr = f' {self.r.choice(["class", "class", "class", "id"])}="{own}"' if own else ""
        return f'<{name}{attr} data-mark="{mark}">{body}</{name}>'

    def links(self, low: int = 3, high: int = 9) -> str:
        items = [f'<a href="/x">{self.words(1, 3)}</a>' for _ in range(self.r.randint(low, high))]
        if self.r.random() < 0.6:
            return self.tag("ul", "".join(self.tag("li", x, 0) for x in items), 0)
        return self.r.choice([" | ", " ", ""]).join(items)

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            head = self.tag(r.choice(["h1", "h1", "h2"]), self.words(2, 12), 1, ["title", "headline"])
            out.append(self.tag("header", head, 1, ["entry-header"]) if r.random() < 0.15 else head)
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            kind = r.random()
            if kind < 0.76:
                text = self.words(*r.choice([(1, 6), (8, 30), (30, 90), (60, 140)]))
                if r.random() < 0.2:
                    text += f' <a href="/y">{self.words(1, 4)}</a> ' + self.words(3, 20)
                if r.random() < 0.1:
                    text = "<b>" + text + "<br>"
                out.append(self.tag(r.choice(["p"] * 9 + ["div"]), text, 1, [] if r.random() < 0.9 else ["text"]))
            elif kind < 0.83:
                out.append(self.tag(r.choice(["h2", "h3"]), self.words(1, 8), 1))
            elif kind < 0.9:
                out.append(self.tag(r.choice(["ul", "ol"]), "".join(self.tag("li", self.words(2, 25), 1) for _ in range(r.randint(2, 6))), 1))
            elif kind < 0.94:
                out.append(self.tag("blockquote", self.tag("p", self.words(8, 40), 1), 1))
            elif kind < 0.97:
                cells = lambda: "".join(self.tag("td", self.words(1, 5), 1) for _ in range(3))
                out.append(self.tag("table", "".join(self.tag("tr", cells(), 1) for _ in range(r.randint(2, 4))), 1))
            elif kind < 0.985:
                out.append(self.tag("figure", '<img src="a.png">' + self.tag("figcaption", self.words(3, 12), 1), 1))
            else:
                out.append(self.tag("pre", self.words(5, 30), 1))
            if r.random() < 0.08:
                out.append(self.other(inside=True))
        body = "".join(out)
        if r.random() < 0.25:
            body = self.tag("div", body, 1, ["content", "entry-content", "article-body", "post-text"])
        return self.tag(*r.choice([("article", body, 1, ["post"]), ("article", body, 1, []), ("main", body, 1, ["content"]), ("div", body, 1, ["content", "article", "post", "story-body", "main-text", "entry"]), ("section", body, 1, ["content", "article"])]))

    def other(self, inside: bool = False) -> str:
        r = self.r
        kind = r.choice(["ad", "notice", "share", "related", "form"] if inside else ["nav", "header", "footer", "side", "ad", "notice", "form", "comments", "related", "share", "crumbs"])
        prose = lambda low=3, high=40: self.tag("p", self.words(low, high), 0) if r.random() < 0.5 else self.words(low, high)
        if kind == "nav":
            return self.tag(*r.choice([("nav", self.links(), 0, ["menu", "main-nav"]), ("nav", self.links(), 0, []), ("div", self.links(), 0, ["menu", "nav", "navbar", "topnav"]), ("ul", "".join(self.tag("li", f'<a href="/">{self.words(1, 2)}</a>', 0) for _ in range(5)), 0, ["menu", "nav"])]))
        if kind == "header":
            body = r.choice([self.tag("h1", self.words(1, 3), 0, ["logo", "site-title"]), f'<a href="/">{self.words(1, 2)}</a>', prose(2, 8)]) + (self.links() if r.random() < 0.4 else "")
            return self.tag(*r.choice([("header", body, 0, ["site-header"]), ("header", body, 0, []), ("div", body, 0, ["header", "masthead", "topbar"])]))
        if kind == "footer":
            body = r.choice(["&copy; ", "", "Copyright "]) + self.words(2, 14) + (self.links() if r.random() < 0.4 else "") + (prose(3, 20) if r.random() < 0.3 else "")
            return self.tag(*r.choice([("footer", body, 0, ["site-footer"]), ("footer", body, 0, []), ("div", body, 0, ["footer", "copyright", "legal"])]))
        if kind == "side":
            body = "".join(self.tag(r.choice(["div", "section"]), self.tag("h3", self.words(1, 3), 0) + r.choice([self.links(), prose(5, 40)]), 0, ["widget"]) for _ in range(r.randint(1, 3)))
            return self.tag(*r.choice([("aside", body, 0, ["sidebar"]), ("aside", body, 0, []), ("div", body, 0, ["sidebar", "side", "right-rail", "widgets"])]))
        if kind == "ad":
            return self.tag(r.choice(["div", "div", "aside", "section", "p"]), r.choice([prose(), self.words(2, 10), f'<a href="/ad">{self.words(2, 8)}</a>']), 0, ["ad", "ads", "advert", "sponsored", "promo", "banner", "ad-box", "advertisement"])
        if kind == "notice":
            return self.tag(r.choice(["div", "div", "section", "aside", "p"]), prose(5, 40) + r.choice(["", "<button>" + self.words(1, 2) + "</button>"]), 0, ["cookie-notice", "notice", "consent", "alert", "gdpr", "popup", "disclaimer", "cookie"])
        if kind == "form":
            return f'<form data-mark="0">{prose(2, 12)}<label>{self.words(1, 3)}</label><input name="q"><button data-mark="0">{self.words(1, 2)}</button></form>'
        if kind == "comments":
            one = lambda: self.tag(r.choice(["div", "li", "article"]), (self.tag("h4", self.words(1, 2), 0) if r.random() < 0.4 else "") + self.tag("p", self.words(3, 60), 0), 0, ["comment", "reply", "comment-body"])
            return self.tag(r.choice(["section", "div", "ol"]), (self.tag("h3", self.words(1, 3), 0) if r.random() < 0.6 else "") + "".join(one() for _ in range(r.randint(1, 6))), 0, ["comments", "comment-list", "discussion", "disqus", "responses comments"])
        if kind == "related":
            return self.tag(r.choice(["div", "section", "aside"]), self.tag("h3", self.words(1, 3), 0) + self.links(), 0, ["related", "recommended", "popular", "more-stories", "trending"])
        if kind == "crumbs":
            return self.tag(r.choice(["div", "nav", "ol"]), " &gt; ".join(f'<a href="/">{self.words(1, 2)}</a>' for _ in range(3)), 0, ["breadcrumb", "breadcrumbs", "pagination"])
        return self.tag("div", self.links(2, 4) if r.random() < 0.5 else self.words(1, 6), 0, ["share", "social", "tags", "share-bar", "author"])

    def page(self) -> str:
        r = self.r
        before, after = ("".join(self.other() for _ in range(r.randint(0, 4))) for _ in range(2))
        body = before + (self.article() if r.random() < 0.97 else "") + after
        if r.random() < 0.35:
            body = self.tag("div", body, 1, ["page", "wrapper", "container"])
        return f"<html><head><title>{self.words(2, 8)}</title></head><body data-mark=\"1\">{body}</body></html>"


@dataclass
class Trees:
    """Boosted trees of one depth over binned features; a node's children stand at 2 i + 1 and 2 i + 2."""

    edges: np.ndarray  # features by BINS - 1
    feature: np.ndarray  # trees by inner nodes
    cut: np.ndarray
    value: np.ndarray  # trees by leaves
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (b[rows, f[at]] > c[at])
            out += v[at - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Gradient boosting of the logistic loss with second-order gains over histograms."""
    n, many = x.shape
    inner = 2**DEPTH - 1
    edges = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    share = y.mean()
    model = Trees(np.sort(edges, 1), np.zeros((TREES, inner), np.int64), np.full((TREES, inner), 255, np.uint8), np.zeros((TREES, inner + 1)), float(np.log(share / (1 - share))))
    b = model.bins(x).astype(np.int64)
    logit = np.full(n, model.start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for d in range(DEPTH):
            base, width = 2**d - 1, 2**d
            spot = (at - base) * BINS
            best = np.full(width, 1e-6)
            for f in range(many):
                key = spot + b[:, f]
                gs, hs = (np.bincount(key, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = (gs**2 / (hs + 1) + (ga - gs) ** 2 / (ha - hs + 1) - ga**2 / (ha + 1))[:, :-1]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                own = np.flatnonzero(better)
                best[own] = gain[own, top[own]]
                model.feature[t, base + own], model.cut[t, base + own] = f, top[own]
            at = 2 * at + 1 + (b[np.arange(n), model.feature[t, at]] > model.cut[t, at])
        leaf = at - inner
        model.value[t] = RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + 1)
        logit += model.value[t, leaf]
    return model


def train(pages: int = PAGES, seed: int = 11) -> Trees:
    rows, labels = [], []
    made = Generator(seed)
    for _ in range(pages):
        nodes = parse(made.page())
        marks: list[int] = []
        for node in nodes:
            marks.append(int(node.mark) if node.mark else marks[node.parent] if node.parent >= 0 else 1)
        rows.append(features(nodes))
        labels += marks
    return boost(np.concatenate(rows), np.array(labels, np.float64))


def decode(nodes: list[Node], logits: list[float]) -> str:
    """The text blocks of the most likely labelling in which all below a dropped node is dropped."""
    n = len(nodes)
    keep, drop = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        x = logits[i]
        rest = math.log1p(math.exp(-abs(x)))
        keep[i] += min(0.0, x) - rest
        drop[i] += min(0.0, -x) - rest
        if i:
            p = nodes[i].parent
            keep[p] += max(keep[i], drop[i])
            drop[p] += drop[i]
    kept = [True] * n
    out = []
    for i, node in enumerate(nodes):
        kept[i] = (i == 0 or kept[node.parent]) and (i == 0 or keep[i] >= drop[i])
        if kept[i] and node.text is not None:
            out.append(node.text)
    return "\n\n".join(out)


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in chunks(batches, "html"):
            parsed = [parse(h or "") for h in piece.column("html").to_pylist()]
            logits = shared.value.logits(np.concatenate([features(nodes) for nodes in parsed])).tolist()
            texts, at = [], 0
            for nodes in parsed:
                texts.append(decode(nodes, logits[at : at + len(nodes)]))
                at += len(nodes)
            yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, TEXTS)


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train())
