"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks: text between block-level tags. A block's
features are its own and its neighbours' word counts and link densities, its
place among headings, and whether it lies in an element whose name or class
speaks of navigation, notices, adverts, forms or comments. Such names don't count
on html, body, main and article nor, with a form, on an element that holds most of
the page's unlinked words with few others outside. A small decision tree, grown
here from the labelled blocks in ``LABELLED``, calls each block text or boilerplate.

The page is read once by one expression for tags, comments and whole scripts,
in linear time; unclosed and misplaced tags only open and close blocks. Buttons,
icons, embedded objects and the like are left out up to their end tag; one that
has none, or is written with "/>", takes no more than its own text.

Defined results: null and empty pages have an empty text; repeated rows are read
row by row; pages without any block called text have an empty text; a page cut
off inside a tag, comment or script ends there; other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A tag's attributes up to its end: a quote opens a value only after "=", elsewhere it is a character of a name or value.
ATTRS = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
#: Comments, elements whose content is read as characters, and tags. Comments, scripts and styles without an end run to
#: the end of the page; the others need an end tag before the next start of their kind, else their start is only a tag.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>script|style)(?![\w:-]){ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<chars>title|textarea|iframe|noscript)(?![\w:-]){ATTRS}(?<!/)>"
    r"(?:[^<]|<(?!/?(?P=chars)(?![\w:-])))*+</(?P=chars)\s*>"
    rf"|<(?P<close>/?)(?P<tag>[a-z][a-z0-9:-]*+)(?P<attrs>{ATTRS})(?:>|\Z)",
    re.IGNORECASE | re.DOTALL)
#: Elements that are left out with all they hold; one without an end tag ends where its parent does or a flow element starts.
SKIPPED = frozenset("template svg math object canvas select button title textarea iframe noscript".split())
FLOW = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
                 "footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table "
                 "ul".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that never hold main text, and words in class, id or role that say the same.
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
CUE = re.compile(r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|header|sidebar|side|aside|ads?|advert\w*|sponsor\w*|"
                 r"promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|share|social|related|"
                 r"comments?|respond|replies|breadcrumbs?|pager|pagination|toolbar|widget|login|signup|search|tags)"
                 r"(?:$|[\s_-])", re.IGNORECASE)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements around a page's content, whose names and classes say nothing about it.
AROUND = frozenset(("html", "head", "body", "main", "article"))
#: A cue counts for nothing on an element that holds most of the page's unlinked words, if fewer than these stand outside.
FEW_WORDS = 50
WORD = re.compile(r"\S+")


@dataclass
class Block:
    text: str
    words: int
    linked: int  # words inside links
    heading: bool
    outside: bool
    article: bool
    never: bool  # hidden, or in an element that holds no main text

    @property
    def density(self) -> float:
        return self.linked / self.words


def speaks_of_boilerplate(tag: str, attrs: str) -> str:
    """"firm" for elements that never hold main text, "cue" for a form or a name that says so, else nothing."""
    if tag in OUTSIDE and tag != "form":
        return "firm"
    said = "cue" if tag == "form" else ""
    if not attrs.strip() or tag in ("html", "head", "body"):
        return said
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "firm"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return "firm"
        if name in ("class", "id", "role") and tag not in AROUND and CUE.search(value):
            said = "cue"
    return said


def mark_outside(blocks: list[Block], cues: list[tuple[int, int]]) -> None:
    """Sets ``outside`` on the blocks of each cue's range (first, end), but for those that hold the page's content."""
    free = [b.words - b.linked for b in blocks]
    upto = np.concatenate([[0], np.cumsum(free)]).astype(int)
    most = lambda c: 2 * (upto[c[1]] - upto[c[0]]) > upto[-1]
    depth = np.zeros(len(blocks) + 1, int)
    for first, end in cues:
        if not most((first, end)):
            depth[first] += 1
            depth[end] -= 1
    covered = np.cumsum(depth)[:-1] > 0
    loose = np.concatenate([[0], np.cumsum([0 if b.outside or c else f for b, c, f in zip(blocks, covered, free, strict=True)])])
    # elements with most of the words lie in one another; inside one whose cue counts all is outside
    for first, end in sorted(filter(most, cues), key=lambda c: (c[0], -c[1])):
        if loose[-1] - (loose[end] - loose[first]) >= FEW_WORDS:
            covered[first:end] = True
            break
    for b, c in zip(blocks, covered, strict=True):
        b.outside = bool(b.outside or c)


def tags_of(page: str) -> tuple[list[re.Match[str]], dict[int, int]]:
    """The page's tokens, and for the start of each skipped element that is closed, where its end tag stands among them."""
    tokens = list(TOKEN.finditer(page))
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    names: Counter[str] = Counter()
    for i, m in enumerate(tokens):
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if not m["close"]:
            if tag not in VOID and not m["attrs"].endswith("/"):
                open_.append((tag, i))
                names[tag] += 1
        elif names[tag]:
            while True:
                name, start = open_.pop()
                names[name] -= 1
                if name == tag:
                    break
            if tag in SKIPPED:
                ends[start] = i
    return tokens, ends


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []  # of the block being read: text, inside a link
    open_: list[tuple[str, str, int]] = []  # elements that are open: name, how it speaks of boilerplate, first block
    names: Counter[str] = Counter()  # of the open elements
    cues: list[tuple[int, int]] = []  # first block and end of elements whose cue may be wrong
    outside = unclosed = 0
    heading = ""

    def flush() -> None:
        if parts:
            # references are decoded in one go, as a tag may stand within one block's text
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(html.unescape(t).split()) for t, link in parts if link)
                out.append(Block(text, words, min(linked, words), bool(heading), outside > 0,
                                 names["article"] + names["main"] > 0, outside > 0))
            parts.clear()

    def pop() -> str:
        nonlocal outside, unclosed
        name, spoke, first = open_.pop()
        names[name] -= 1
        outside -= spoke == "firm"
        unclosed -= name in SKIPPED
        if spoke == "cue" and first < len(out):
            cues.append((first, len(out)))
        return name

    tokens, ends = tags_of(page)
    at = skip_to = 0
    for i, m in enumerate(tokens):
        if i < skip_to:
            continue
        if m.start() > at:
            parts.append((page[at:m.start()], names["a"] > 0))
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            if m["raw"] or m["chars"]:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if m["close"]:
            if names[tag]:  # closes what was left open inside, too
                while pop() != tag:
                    pass
            if tag == heading:
                heading = ""
        elif tag not in VOID and not m["attrs"].endswith("/"):
            if i in ends:
                skip_to, at = ends[i] + 1, tokens[ends[i]].end()
                continue
            while tag in FLOW and unclosed:
                pop()
            if names["p"] and tag in FLOW:
                k = len(open_) - 1
                while k >= 0 and open_[k][0] != "p" and open_[k][0] in INLINE:
                    k -= 1
                if k >= 0 and open_[k][0] == "p":
                    while pop() != "p":
                        pass
            spoke = "firm" if tag in SKIPPED else speaks_of_boilerplate(tag, m["attrs"])
            open_.append((tag, spoke, len(out)))
            names[tag] += 1
            outside += spoke == "firm"
            unclosed += tag in SKIPPED
            if tag in HEADINGS:
                heading = tag
    if at < len(page):
        parts.append((page[at:], names["a"] > 0))
    flush()
    while open_:
        pop()
    mark_outside(out, cues)
    return out


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "outside", "article")


def features(blocks: list[Block]) -> np.ndarray:
    """One row per block; a missing neighbour has no words and no links."""
    own = np.array([(b.words, b.density) for b in blocks], float).reshape(-1, 2)
    edge = np.array([[0.0, 0.0]])
    flags = np.array([(b.heading, b.outside, b.article) for b in blocks], float).reshape(-1, 3)
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), flags])


#: Labelled blocks: is text, then the features in the order of FEATURES.
LABELLED = """
1 42 0.00 8 0.00 55 0.00 0 0 1
1 55 0.02 42 0.00 30 0.00 0 0 1
1 8 0.00 0 0.00 42 0.00 1 0 1
1 5 0.00 1 1.00 60 0.01 1 0 1
1 2 0.00 40 0.00 33 0.00 0 0 1
1 1 0.00 25 0.00 18 0.00 0 0 1
1 3 0.00 2 0.00 2 0.00 0 0 1
1 1 0.00 1 0.00 1 0.00 0 0 1
1 12 0.25 60 0.00 44 0.00 0 0 1
1 3 1.00 35 0.00 52 0.00 0 0 1
1 90 0.03 7 0.00 12 0.00 0 0 1
1 6 0.00 90 0.03 11 0.00 0 0 1
1 240 0.00 6 0.00 14 0.05 0 0 1
1 14 0.07 30 0.00 9 0.15 0 0 1
1 4 0.00 9 0.00 6 0.00 0 0 1
1 7 0.00 0 0.00 1 0.00 1 0 1
1 70 0.00 5 0.00 64 0.02 0 0 0
1 64 0.02 70 0.00 38 0.00 0 0 0
1 38 0.00 64 0.02 3 1.00 0 0 0
1 6 0.00 2 1.00 80 0.00 1 0 0
1 120 0.05 10 0.20 20 0.00 0 0 0
1 20 0.00 120 0.05 48 0.00 0 0 0
1 33 0.10 28 0.00 41 0.00 0 0 0
1 5 0.00 44 0.00 51 0.00 0 0 0
1 9 0.00 31 0.00 27 0.00 0 0 0
1 26 0.00 6 0.00 5 0.00 0 0 0
1 12 0.00 40 0.00 0 0.00 0 0 1
1 3 0.00 20 0.00 0 0.00 0 0 1
1 2 0.00 1 0.00 4 1.00 0 0 1
1 6 0.00 30 0.00 5 1.00 0 0 1
1 18 0.00 44 0.00 2 1.00 0 0 1
1 45 0.04 60 0.00 3 1.00 0 0 0
1 16 0.00 52 0.00 0 0.00 0 0 0
1 31 0.00 27 0.00 0 0.00 0 0 0
1 1 1.00 28 0.00 33 0.00 0 0 1
1 15 0.40 33 0.00 28 0.10 0 0 1
1 64 0.00 58 0.00 61 0.00 0 1 1
1 85 0.02 64 0.00 70 0.00 0 1 1
1 72 0.00 66 0.03 90 0.00 0 1 1
1 140 0.00 75 0.00 88 0.01 0 1 1
1 95 0.01 80 0.00 62 0.00 0 1 1
1 70 0.00 72 0.00 0 0.00 0 1 1
1 88 0.00 64 0.00 2 1.00 0 1 1
1 180 0.00 150 0.00 165 0.00 0 1 0
1 150 0.02 135 0.00 190 0.00 0 1 0
1 210 0.00 90 0.00 140 0.01 0 1 0
1 165 0.00 170 0.02 120 0.00 0 1 0
0 3 0.00 90 0.00 85 0.00 0 1 0
0 5 0.00 72 0.00 64 0.00 0 1 1
0 12 0.00 120 0.00 110 0.00 0 1 1
0 25 0.00 70 0.00 95 0.00 0 1 1
0 30 0.05 140 0.00 130 0.00 0 1 0
0 9 0.00 180 0.00 160 0.00 0 1 1
0 18 0.10 64 0.00 190 0.00 0 1 0
0 45 0.00 88 0.00 62 0.00 0 1 1
0 2 0.00 150 0.00 75 0.00 0 1 1
0 40 0.00 66 0.00 120 0.00 0 1 0
0 22 0.00 85 0.00 0 0.00 0 1 1
0 80 0.90 70 0.00 75 0.00 0 1 1
0 160 0.80 140 0.00 150 0.00 0 1 0
0 120 1.00 90 0.00 85 0.00 0 1 1
0 200 0.95 170 0.00 180 0.00 0 1 0
0 40 0.00 60 0.00 0 0.00 0 1 0
0 75 0.00 31 0.00 2 1.00 0 1 0
0 55 0.02 12 0.00 0 0.00 0 1 1
0 33 0.00 2 1.00 0 0.00 0 1 0
0 48 0.00 3 1.00 1 1.00 0 1 0
0 29 0.10 14 0.00 40 0.00 0 1 1
0 64 0.00 55 0.00 48 0.00 0 1 0
0 110 0.00 80 0.00 75 0.00 0 1 0
0 41 0.00 0 0.00 38 0.00 0 1 0
0 17 0.00 38 0.00 25 0.00 0 1 1
0 3 0.00 50 0.00 40 0.00 1 1 1
0 8 0.00 26 0.00 31 0.00 0 1 0
0 1 0.00 33 0.00 45 0.00 0 1 0
0 1 1.00 1 1.00 1 1.00 0 1 0
0 1 1.00 0 0.00 1 1.00 0 1 0
0 2 1.00 1 1.00 3 1.00 0 1 0
0 1 1.00 2 1.00 9 0.00 0 1 0
0 9 0.00 1 1.00 8 0.00 0 1 0
0 14 0.00 1 1.00 6 0.00 0 1 0
0 30 0.00 2 1.00 7 0.00 0 1 0
0 12 0.08 45 0.00 0 0.00 0 1 0
0 10 0.00 60 0.00 0 0.00 0 1 0
0 60 0.00 20 0.00 35 0.00 0 1 0
0 35 0.00 60 0.00 12 0.00 0 1 0
0 22 0.05 18 0.00 24 0.00 0 1 1
0 7 0.00 50 0.00 22 0.00 1 1 1
0 3 1.00 40 0.00 2 1.00 0 1 1
0 4 0.50 80 0.00 16 0.00 0 1 1
0 5 0.00 3 0.00 2 0.00 1 1 0
0 2 0.00 5 0.00 4 0.00 0 1 0
0 100 0.01 30 0.00 90 0.02 0 1 0
0 2 1.00 3 1.00 2 1.00 0 0 0
0 3 1.00 0 0.00 2 1.00 0 0 0
0 4 1.00 2 1.00 60 0.00 0 0 0
0 6 0.83 4 1.00 5 1.00 0 0 0
0 9 0.78 5 1.00 7 0.90 0 0 0
0 18 0.72 12 0.80 3 1.00 0 0 0
0 5 0.00 2 1.00 3 1.00 0 0 0
0 3 0.00 1 1.00 1 1.00 0 0 0
0 8 0.00 4 1.00 0 0.00 0 0 0
0 11 0.09 7 0.86 0 0.00 0 0 0
0 2 0.00 0 0.00 3 1.00 0 0 0
0 2 1.00 55 0.00 3 1.00 0 0 0
0 4 1.00 3 1.00 3 1.00 0 0 1
0 3 1.00 3 1.00 4 1.00 0 0 1
0 2 1.00 4 1.00 2 1.00 0 0 1
1 30 0.00 0 0.00 25 0.00 0 0 1
1 3 0.00 0 0.00 0 0.00 0 0 1
1 8 0.00 1 1.00 0 0.00 0 0 1
1 19 0.00 1 1.00 28 0.00 0 0 1
1 2 0.00 3 1.00 1 0.00 0 0 1
1 9 0.00 2 1.00 2 1.00 0 0 1
1 21 0.00 2 1.00 33 0.00 0 0 0
1 44 0.00 1 1.00 3 1.00 0 0 0
1 17 0.00 3 1.00 0 0.00 0 0 0
1 28 0.00 4 1.00 6 0.00 0 0 0
1 36 0.05 1 1.00 40 0.00 0 0 0
1 40 0.00 0 0.00 0 0.00 0 0 0
1 25 0.00 0 0.00 30 0.00 0 0 0
1 4 0.00 0 0.00 30 0.00 0 0 0
1 3 1.00 40 0.00 44 0.00 0 0 1
1 2 1.00 25 0.00 31 0.00 0 0 1
1 2 0.50 25 0.00 6 0.00 0 0 1
1 2 0.00 1 1.00 22 0.00 1 0 0
1 4 0.00 2 1.00 17 0.00 1 0 0
1 6 0.00 1 1.00 12 0.00 1 0 0
1 3 0.00 3 1.00 35 0.00 1 0 0
1 2 0.00 0 0.00 25 0.00 1 0 0
1 1 0.00 0 0.00 14 0.00 0 0 1
1 2 0.00 0 0.00 8 0.00 1 0 1
1 2 0.00 0 0.00 0 0.00 0 0 1
0 2 1.00 55 0.00 3 1.00 0 0 0
0 2 1.00 48 0.00 1 1.00 0 0 0
0 2 1.00 22 0.00 2 1.00 0 0 0
0 2 1.00 12 0.00 2 1.00 0 0 0
0 3 1.00 60 0.00 2 1.00 0 0 1
0 2 1.00 70 0.00 0 0.00 0 0 0
0 3 1.00 2 1.00 0 0.00 0 0 0
0 1 1.00 3 1.00 45 0.00 0 0 0
0 2 1.00 90 0.00 2 1.00 0 0 0
0 2 1.00 40 0.00 2 1.00 0 0 0
0 1 1.00 0 0.00 22 0.00 0 0 0
0 2 0.00 3 1.00 0 0.00 0 0 0
0 3 0.00 2 1.00 4 1.00 0 0 0
0 6 0.00 3 1.00 1 1.00 0 0 0
0 4 0.00 2 1.00 0 0.00 0 0 0
"""


@dataclass
class Node:
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None
    text: bool = False


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Node:
    """A tree by the largest fall of Gini impurity; ties go to the first feature and the lowest cut."""
    node = Node(text=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return node
    gini = lambda part: 2 * part.mean() * (1 - part.mean()) * len(part)
    best = gini(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            if least <= low.sum() <= len(y) - least and (g := gini(y[low]) + gini(y[~low])) < best:
                best, node.feature, node.cut = g, f, float(cut)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.cut
        node.low, node.high = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    return node


def labelled() -> tuple[np.ndarray, np.ndarray]:
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return rows[:, 1:], rows[:, 0] > 0


@functools.cache
def tree() -> Node:
    return grow(*labelled())


def is_text(x: np.ndarray, node: Node | None = None) -> np.ndarray:
    node = node or tree()
    if node.feature < 0:
        return np.full(len(x), node.text)
    low = x[:, node.feature] <= node.cut
    out = np.empty(len(x), bool)
    out[low], out[~low] = is_text(x[low], node.low), is_text(x[~low], node.high)
    return out


def main_text(page: str | None) -> str:
    blocks = blocks_of(page) if page else []
    if not blocks:
        return ""
    return " ".join(b.text for b, on in zip(blocks, is_text(features(blocks)), strict=True)
                    if on and not b.never)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) per row of ``pages``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [id_col, url_col, "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select(id_col, url_col, html_col).mapInArrow(
        rows, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
