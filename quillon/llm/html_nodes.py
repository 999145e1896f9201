"""Block-level DOM nodes of a page, and their features."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")

# Elements by their part in a page: fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "optgroup", "option", "select", "legend"}
#: Elements that stand deeper are taken as their parent's content, as browsers do.
DEEPEST = 512
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUND = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": set()}

#: Groups of tags and of attribute words that features are about.
TAGS = [{"p"}, {"h1", "h2", "h3", "h4", "h5", "h6"}, {"li", "ul", "ol", "dl", "dd", "dt", "menu"}, {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "button", "legend", "option", "optgroup", "select"}, {"article"}, {"main"}, {"div", "center"}, {"section"}, {"table", "tr", "td", "th", "tbody", "thead"}, {"blockquote", "pre", "figure", "figcaption"}, {"address", "dialog", "details"}]
WORDS = [
    r"\b(?:ads?|adv|advert\w*|sponsor\w*|promo\w*|banner\w*|affiliate)\b",
    r"\b(?:nav\w*|menu\w*|breadcrumbs?|toc|pagination|pager|tabs?|skip)\b",
    r"\b(?:comments?|disqus|replies|reply|discussion|respond)\b",
    r"\b(?:footer|foot|copyright|legal|colophon|bottom)\b",
    r"\b(?:header|head|masthead|top|topbar|branding|logo)\b",
    r"\b(?:side\w*|aside|rail|widgets?|secondary|right|left)\b",
    r"\b(?:forms?|login|signup|subscribe|newsletter|search|contact)\b",
    r"\b(?:share|sharing|social|related|recommend\w*|more|popular|trending|tags?|author|bio)\b",
    r"\b(?:cookies?|notices?|consent|gdpr|alert|popup|modal|overlay|warning|disclaimer|toast)\b",
    r"\b(?:content|article\w*|main|post|entry|story|text|body|prose|page)\b",
]
_WORDS = [re.compile(w) for w in WORDS]
_TAG_BITS = {t: sum(1 << k for k, group in enumerate(TAGS) if t in group) for group in TAGS for t in group}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
FEATURES = 17 + 3 * len(TAGS) + 2 * len(WORDS)


@dataclass
class Node:
    tag: str
    parent: int
    attrs: str = ""
    mark: str = ""
    children: list[int] = field(default_factory=list)
    text: str | None = None  # of a leaf
    links: int = 0  # characters of its text that stand in links
    inputs: int = 0


def parse(page: str) -> list[Node]:
    """The block-level nodes of a page in page order, the root first; leaves hold the text blocks, decoded and
    with single spaces (white space is what str.split takes as such). What a browser doesn't show (scripts, styles, titles,
    comments, markup) is no part of any text. A slash at the end of a tag closes nothing, as HTML has it. Time is linear in
    the page, whatever is left open: no more than DEEPEST elements are open at once."""
    nodes = [Node("html", -1)]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements with the block-level node they belong to
    held: list[str] = []
    blocks: list[int] = []  # where the block-level ones among them stand
    opened, flat = Counter[str](), Counter[str]()  # open elements by tag; those that are too deep to be opened
    endless: set[str] = set()  # raw elements that aren't closed any more
    linked = in_link = at = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                owner = stack[-1][1]
                nodes[owner].children.append(len(nodes))
                nodes.append(Node("#", owner, text=text, links=min(len(text), linked)))
            held.clear()
        linked = 0

    def push(tag: str, node: int) -> None:
        nonlocal in_link
        if tag in BLOCK:
            blocks.append(len(stack))
        elif tag == "a":
            in_link += 1
        opened[tag] += 1
        stack.append((tag, node))

    def pop(to: int) -> None:
        nonlocal in_link
        while len(stack) > to:
            tag = stack[-1][0]
            if tag in BLOCK:
                flush()
                blocks.pop()
            elif tag == "a":
                in_link -= 1
            opened[tag] -= 1
            stack.pop()

    end, last = len(page), page.rfind(">")
    while at < end:
        m = _TOKEN.search(page, at) if at <= last else None
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            if "&" in piece:
                piece = html.unescape(piece)
            held.append(piece)
            if in_link:
                linked += len(piece.strip())
        if not m:
            break
        at = m.end()
        closing, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            if tag == "br":
                held.append(" ")
            if flat[tag]:
                flat[tag] -= 1
            elif opened[tag]:
                pop(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in RAW:
            close = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                endless.add(tag)
                at = end if tag in ("script", "style", "textarea", "title") else at
            held.append(" ")
            continue
        if tag in VOID:
            if tag == "input":
                nodes[stack[-1][1]].inputs += 1
            if tag == "hr":
                flush()
            held.append(" ")
            continue
        if tag in _ENDS_P and blocks and stack[blocks[-1]][0] == "p":
            pop(blocks[-1])
        if tag in _SIBLINGS and any(opened[t] for t in _SIBLINGS[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _SIBLINGS[tag]:
                    pop(k)
                    if tag != "tr" or stack[-1][0] != "tr":
                        break
                elif stack[k][0] in _BOUND[tag]:
                    break
        if len(stack) >= DEEPEST:
            flat[tag] += 1
            if tag in BLOCK:
                flush()
            continue
        if tag not in BLOCK:
            push(tag, stack[-1][1])
            continue
        flush()
        owner = stack[-1][1]
        node = Node(tag, owner)
        if "=" in attrs:
            found = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attrs)}
            words = " ".join(found[k] for k in ("class", "id", "role") if k in found)
            node.attrs, node.mark = _SPLIT.sub(" ", _CAMEL.sub(" ", words).lower()), found.get("data-mark", "")
        nodes[owner].children.append(len(nodes))
        push(tag, len(nodes))
        nodes.append(node)
    pop(1)
    flush()
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    """A row of FEATURES numbers per node: its own tag and attribute words, those of what it stands in, and how its
    subtree and its siblings are made."""
    n = len(nodes)
    chars, links, leaves, marks, inputs, below = ([0] * n for _ in range(6))
    longest = [0] * n
    tag_of, word_of = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        x = nodes[i]
        inputs[i] += x.inputs
        if x.text is not None:
            chars[i], links[i], leaves[i] = len(x.text), x.links, 1
            marks[i] = sum(map(x.text.count, ".,;:!?"))
            longest[i] = chars[i]
        below[i] += 1
        if i:
            p = x.parent
            for total in (chars, links, leaves, marks, inputs, below):
                total[p] += total[i]
            longest[p] = max(longest[p], longest[i])
    depth, above_tags, above_words, below_tags, seen = ([0] * n for _ in range(5))
    alike: list[dict[str, int] | None] = [None] * n
    for i in range(1, n):
        x = nodes[i]
        bits = tag_of[i] = _TAG_BITS.get(x.tag, 0)
        below_tags[x.parent] |= bits
        same = alike[x.parent]
        if same is None:
            same = alike[x.parent] = {}
        same[x.tag] = same.get(x.tag, 0) + 1
        if x.attrs:
            word_of[i] = sum(1 << k for k, w in enumerate(_WORDS) if w.search(x.attrs))
    place = 0
    out = []
    whole = max(1, chars[0])
    log = math.log1p
    for i, x in enumerate(nodes):
        p, order, siblings, same = 0, 1, 1, 1
        if i:
            p = x.parent
            depth[i] = depth[p] + 1
            above_tags[i], above_words[i] = above_tags[p] | tag_of[p], above_words[p] | word_of[p]
            seen[p] += 1
            order, siblings, same = seen[p], len(nodes[p].children), alike[p][x.tag]
        own, around = chars[i], chars[p] or 1
        out.append(
            (
                log(own),
                links[i] / (own or 1),
                log(leaves[i]),
                log(own / (leaves[i] or 1)),
                log(longest[i]),
                marks[i] / (own or 1) * 100,
                own / whole,
                own / around,
                links[p] / around,
                depth[i],
                order / siblings,
                log(siblings),
                same / siblings,
                log(below[i]),
                place / whole,
                inputs[i],
                log(chars[p]),
            )
        )
        if x.text is not None:
            place += own
    flags = [(np.array(bits)[:, None] >> np.arange(many)) & 1 for bits, many in ((tag_of, len(TAGS)), (above_tags, len(TAGS)), (below_tags, len(TAGS)), (word_of, len(WORDS)), (above_words, len(WORDS)))]
    return np.hstack([np.array(out), *flags])
