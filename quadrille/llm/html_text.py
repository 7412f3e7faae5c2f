"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks: block-level tags part them, everything else is inline. A block is
described by its number of words and its link density, those of the blocks before and after it, the longest plain
block among the three before and the three after, whether it is a heading or a list item, whether it lies in an
article, and whether the page has one. A decision tree keeps or drops each block. It is grown on a small labelled
table: the blocks of the PAGES below, hand-labelled line by line. Blocks of menus, footers, sidebars, forms, notices,
adverts, reader comments and page headers, as the enclosing elements or their class, id and role names say, are never kept.

Defined results: null or empty html, and pages without a kept block, have an empty text; truncated pages and unclosed
tags are read as far as they go (elements without text, but for raw text, end at the next block-level tag; where a
quote is never closed, tags end at the next `>`); repeated rows keep their own result. White space in a block becomes
one space, blocks are joined by an empty line, and nothing is capped. Reading a page takes time in proportion to its length.
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
from pyspark.sql import functions as F

from .tokenization import blocks

#: Elements whose content is never text, block-level elements, and elements and names that set the zone.
_RAW = frozenset("script style textarea title".split())
_SILENT = frozenset("noscript template iframe svg select button object audio video canvas math".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr".split())
#: Elements that a like element after them ends, and what bounds the search for an open one.
_ENDED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: What stands inside these is no main text, whatever it is; inside the others, unless the main element is opened there.
_NEVER = frozenset("nav footer aside menu dialog search".split())
_NEVER_NAMES = frozenset("comment comments commentlist reply replies respond discussion disqus".split())
_OUTSIDE_NAMES = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer copyright disclaimer pagination pager widget toolbar masthead topbar complementary contentinfo search skip tags".split())
_INSIDE_NAMES = frozenset("article content post entry story main maincontent articlebody".split())

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_PLAIN = re.compile(r"""[^"'>]*""")
_STOP = re.compile(rf"</?(?:{'|'.join(sorted(_BLOCK - {'option', 'optgroup'}))})(?=[\s/>])", re.I)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s=/>]|$)|style\s*=\s*["'][^"']*display\s*:\s*none""", re.I)

#: The labelled pages. A line holds its label (1: main text) and its html; {n} stands for n words, times each of SIZES.
SIZES = (0.6, 0.8, 1.0, 1.4, 2.0)
PAGES = (
    """0 <header><h1>{3}</h1></header><nav><ul><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul></nav>
1 <article><h1>{8}</h1><p>{60}</p><p>{9}</p><h2>{3}</h2><p>{120}</p><ul><li>{4}</li><li>{12}</li></ul><p>{2}</p><blockquote>{18}</blockquote><p>{35}</p>
0 <ul><li><a>{5}</a></li><li><a>{6}</a></li><li><a>{4}</a></li><li><a>{7}</a></li></ul></article>
0 <div>{30}</div><div>{12}</div><footer>{26}</footer>""",
    """0 <div>{2} <a>{2}</a></div><ul><li><a>{1}</a><li><a>{1}</a><li><a>{2}</a><li><a>{1}</a></ul><div>{4}</div>
1 <h1>{7}</h1><p>{22}</p><p>{64}</p><p>{8} <a>{2}</a> {20}</p><p>{6}</p><h2>{4}</h2><p>{90}</p><p>{31}</p><p>{10}</p>
0 <p><a>{3}</a> <a>{3}</a></p><div>{6} <a>{2}</a> <a>{1}</a></div>""",
    """0 <table><tr><td><a>{2}</a><td><a>{1}</a><td><a>{2}</a></table>
1 <p>{45}</p><p>{14}</p><p>{70}</p><p>{5}</p><p>{28}</p>
0 <ul><li><a>{7}</a><li><a>{9}</a><li><a>{6}</a></ul>""",
    """0 <p><a>{1}</a> <a>{1}</a> <a>{1}</a> <a>{1}</a></p>
1 <h2>{9}</h2><p>{16}</p><p>{25}</p><p>{13}</p><p>{11}</p><p>{33}</p><p>{12}</p>
0 <p><a>{4}</a></p><p><a>{3}</a></p>""",
    """0 <div><a>{3}</a></div><div><a>{2}</a></div>
1 <main><h1>{2}</h1><p>{30}</p><p><a>{6}</a></p><p>{44}</p><p><a>{3}</a></p><p>{6}</p><dl><dt>{1}</dt><dd>{9}</dd><dt>{2}</dt><dd>{3}</dd></dl><p>{7}</p></main>
0 <div>{40}</div><div>{55} <a>{4}</a></div><p>{9}</p>""",
    """1 <article><h1>{5}</h1><p>{1}</p></article>
0 <div>{6}</div>""",
    """1 <article><p>{2}</p></article>
0 <div>{80}</div><div>{70}</div>""",
    """0 <div><a>{2}</a> | <a>{2}</a></div>
1 <h1>{6}</h1><p>{400}</p><h2>{2}</h2><p>{3}</p><ul><li>{8}</li><li>{5}</li><li>{9} <a>{1}</a></li></ul><p>{150}</p>
0 <div><a>{2}</a> {1} <a>{2}</a></div><div><a>{5}</a></div>""",
    """0 <ul><li><a>{2}</a></li><li><a>{2}</a></li></ul><p>{3}</p>
0 <p><a>{8}</a></p><p><a>{9}</a></p><p><a>{7}</a></p><p><a>{6}</a></p>
1 <p>{19}</p><p>{38}</p><p>{17}</p>
0 <p><a>{2}</a></p>""",
    """1 <article><header><h1>{10}</h1><p>{4}</p></header><p>{8}</p><p>{6}</p><p>{12}</p><table><tr><td>{1}<td>{2}<tr><td>{1}<td>{1}</table><p>{3}</p></article>
0 <p>{25}</p><p>{3}</p>""",
    """0 <div>{20}</div><div>{60}</div><ul><li><a>{2}</a><li><a>{3}</a><li><a>{2}</a></ul>
1 <article><p>{3}</p><p><a>{2}</a></p><p>{5} <a>{4}</a></p><p><a>{9}</a></p><p>{14}</p><h3><a>{4}</a></h3><p>{50}</p><p><a>{3}</a> {2} <a>{5}</a></p></article>
0 <div>{33}</div>""",
    """1 <main><p><a>{5}</a></p><p>{12}</p><h2><a>{5}</a></h2><p>{2}</p><h2><a>{3}</a></h2><p>{26}</p></main>
0 <p><a>{5}</a></p><p><a>{5}</a></p>""",
    """0 <div><a>{1}</a> <a>{2}</a></div>
1 <h1>{3}</h1><p>{18}</p><h2>{2}</h2><p>{9}</p><p>{5}</p><h2>{3}</h2><p>{21}</p><pre>{7}</pre><p>{4}</p><p>{40}</p>
0 <div><a>{2}</a></div>""",
    """0 <ul><li><a>{2}</a></li><li><a>{1}</a></li><li><a>{1}</a></li></ul>
1 <p>{33}</p><ol><li>{6}</li><li>{11}</li><li>{3}</li><li>{7}</li></ol><p>{24}</p><p>{8}</p>""",
    """1 <article><h1>{4}</h1><p>{30}</p><p>{9}</p></article>""",
    """1 <article><p>{20}</p><ul><li>{6} <a>{4}</a></li><li><a>{3}</a> {2}</li><li>{8}</li><li><a>{5}</a></li><li>{3} <a>{9}</a></li></ul><p>{14}</p></article>""",
    """0 <nav><a>{3}</a></nav>
1 <article><p>{2}</p><p>{12}</p><h2>{3}</h2><p>{40}</p><p>{3}</p></article>""",
    """1 <main><p>{5}</p><p>{7}</p><p>{6}</p><h2>{2}</h2></main>""",
    """0 <p>{30}</p><p>{8}</p>
1 <main><h1>{3}</h1><p>{4}</p><ul><li>{2}</li><li>{3}</li></ul></main>""",
    """1 <p>{55}</p>""",
    """1 <h1>{4}</h1><p>{21}</p>""",
    """1 <p>{30}</p><p>{10}</p><p>{7}</p>""",
    """0 <div>{3}</div><div><a>{1}</a></div><div><a>{1}</a></div><div>{2}</div>""",
    """0 <p><a>{2}</a></p><p>{1} <a>{3}</a></p><p>{4}</p><p><a>{2}</a></p><p>{3}</p>""",
)


@dataclass
class Block:
    """One flat text block; `at` is where it ends in the page."""

    text: str
    linked: int
    zone: int
    heading: bool
    item: bool
    at: int


@dataclass
class Node:
    """A node of the tree: a leaf where feature is -1."""

    keep: bool
    feature: int = -1
    bound: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A decision tree by Gini impurity; ties go to the earlier feature and the lower bound."""
    node = Node(bool(y.mean() >= 0.5))
    if depth == 0 or y.min() == y.max():
        return node
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= bound
            a, b = y[low].mean(), y[~low].mean()
            impurity = 2 * (low.mean() * a * (1 - a) + (1 - low.mean()) * b * (1 - b))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(bound))
    if best[1] < 0:
        return node
    low = x[:, best[1]] <= best[2]
    node.feature, node.bound = best[1], best[2]
    node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def labelled(pages: tuple[str, ...] = PAGES) -> Iterator[tuple[str, list[int]]]:
    """The html of labelled pages, and the label of each block."""
    for page, size in ((p, size) for p in pages for size in SIZES):
        lines = [(int(line[0]), re.sub(r"\{(\d+)\}", lambda m: " ".join(["word"] * max(1, round(int(m[1]) * size))), line[2:])) for line in page.splitlines()]
        ends = np.cumsum([len(x) + 1 for _, x in lines])
        whole = "\n".join(x for _, x in lines)
        yield whole, [lines[int(np.searchsorted(ends, b.at - 1, side="right"))][0] for b in flat_blocks(whole)]


@functools.cache
def tree() -> Node:
    """The tree of the labelled pages."""
    rows, labels = [], []
    for page, own in labelled():
        found = flat_blocks(page)
        for b, x, y in zip(found, features(found), own, strict=True):
            if b.zone >= 0:
                rows.append(x)
                labels.append(y)
    return grow(np.array(rows, float), np.array(labels, float))


def _names(attributes: str) -> set[str]:
    """The words of class, id and role names; words after has-, with- and no- tell nothing of the element itself."""
    out = set()
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            parts = re.split(r"[^a-z0-9]+", name)
            if parts[0] not in ("has", "with", "no"):
                out.update(parts)
    return out


def _zone_of(name: str, attributes: str) -> str:
    """What an element says of the text in it: never, outside, inside, main, header or nothing."""
    if name in _NEVER:
        return "never"
    names = _names(attributes) if "=" in attributes and name not in ("body", "html") else frozenset()
    if names and not _NEVER_NAMES.isdisjoint(names):
        return "never"
    if name == "main":
        return "main"
    if name == "form" or names and not _OUTSIDE_NAMES.isdisjoint(names) or attributes and _HIDDEN.search(attributes):
        return "outside"
    if name == "article" or names and not _INSIDE_NAMES.isdisjoint(names):
        return "article" if name == "article" else "inside"
    return "header" if name == "header" else ""


def _below(zone: int, never: bool, says: str, form: bool) -> tuple[int, bool]:
    """The zone inside an element, given that around it; the second: nothing can change it any more."""
    if never or says == "never":
        return -1, True
    if says == "main" or says == "article" and (zone >= 0 or form):
        return 1, False
    if says == "outside" or says == "header" and zone <= 0:
        return -1, False
    return (1 if says == "inside" and zone >= 0 else zone), False


class _Scanner:
    """Tags of a page, from left to right."""

    def __init__(self, page: str) -> None:
        self.page, self.quotes = page, True

    def end(self, at: int) -> int:
        """Where the tag ends whose name ends at `at`."""
        page, start = self.page, at
        while self.quotes:
            at = _PLAIN.match(page, at).end()
            if at == len(page):
                self.quotes = False  # from here on a quote is like any other character
                break
            if page[at] == ">":
                return at + 1
            close = page.find(page[at], at + 1)
            if close < 0:
                self.quotes = False
                break
            at = close + 1
        close = page.find(">", start)
        return close + 1 if close >= 0 else len(page)

    def silent_end(self, name: str, at: int) -> int:
        """Where an element without text ends whose start tag ends at `at`."""
        same, close = _patterns(name)
        if name in _RAW:
            m = close.search(self.page, at)
            return m.end() if m else len(self.page)
        m = same.search(self.page, at)
        if m and m[0][1] == "/":
            return m.end()
        stop, m = _STOP.search(self.page, at), close.search(self.page, at, m.start()) if m else None
        if m and (not stop or m.start() < stop.start()):
            return m.end()
        return stop.start() if stop else len(self.page)


@functools.cache
def _patterns(name: str) -> tuple[re.Pattern, re.Pattern]:
    return re.compile(rf"</{name}\s*>|<{name}(?=[\s/>])", re.I), re.compile(rf"</{name}\s*>", re.I)


def flat_blocks(page: str) -> list[Block]:
    """The text blocks of a page in their order."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, zone, fixed, whether only a form made it outside
    open_: Counter = Counter()  # names on the stack
    pieces: list[str] = []
    linked, links, heading, item, at, scan = 0, 0, False, False, 0, _Scanner(page)

    def flush(end: int) -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, linked, stack[-1][1], heading, item, end))
            pieces, linked = [], 0

    def leave(k: int) -> None:
        """Close the k-th open element and those in it."""
        open_.subtract(x[0] for x in stack[k:])
        del stack[k:]

    while (m := _MARK.search(page, at)) is not None:
        start = m.start()
        if start > at:
            piece = page[at:start]
            pieces.append(piece)
            if links:
                linked += len("".join(html.unescape(piece).split()))
        if m[1]:
            close = page.find("-->", start + 2)
            at = close + 3 if close >= 0 else len(page)
            continue
        if not m[3]:
            close = page.find(">", start)
            at = close + 1 if close >= 0 else len(page)
            continue
        name, closing, end = m[3].lower(), m[2] == "/", scan.end(m.end())
        attributes = page[m.end() : end - 1]
        at = end
        empty = attributes.endswith("/")
        if not closing and (name in _RAW or name in _SILENT):
            if not (empty and name in ("svg", "math")):
                at = scan.silent_end(name, end)
        elif name == "a":
            links = 0 if closing else 1
        elif name == "br":
            pieces.append(" ")
        elif name in _BLOCK:
            flush(start)
            if closing:
                if open_[name]:
                    leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                links, heading = 0, False
                item = stack[-1][0] == "li"
                continue
            if stack[-1][0] == "p":
                leave(len(stack) - 1)
            if name in _ENDED:
                like, bounds = _ENDED[name]
                for k in range(len(stack) - 1, 0, -1) if any(open_[x] for x in like) else ():
                    if stack[k][0] in bounds:
                        break
                    if stack[k][0] in like:
                        leave(k)
                        break
            heading = len(name) == 2 and name[0] == "h" and name[1].isdigit()
            item = name == "li"
            if name not in _VOID and not (empty and name != "p"):
                _, zone, never, form = stack[-1]
                says = _zone_of(name, attributes)
                inner, fixed = _below(zone, never, says, form)
                open_[name] += 1
                stack.append((name, inner, fixed, inner < 0 and (form or name == "form" and zone >= 0)))
    if at < len(page):
        pieces.append(page[at:])
    flush(len(page))
    return out


def features(found: list[Block]) -> list[tuple]:
    """What the tree asks of each block."""
    words = [len(b.text.split()) for b in found]
    density = [min(1.0, b.linked / max(1, len(b.text) - b.text.count(" "))) for b in found]
    plain = [w if d < 0.3 and b.zone >= 0 and not b.heading else 0 for w, d, b in zip(words, density, found, strict=True)]
    has = float(any(b.zone > 0 for b in found))
    out = []
    for i, b in enumerate(found):
        before = (words[i - 1], density[i - 1]) if i else (0, 0.0)
        after = (words[i + 1], density[i + 1]) if i + 1 < len(found) else (0, 0.0)
        near = max(plain[max(0, i - 3) : i], default=0), max(plain[i + 1 : i + 4], default=0)
        out.append((float(b.zone), has, density[i], min(density[i], before[1], after[1]), words[i], min(near), max(near), *near, *before, *after, float(b.heading), float(b.item)))
    return out


def main_text(page: str) -> str:
    """The kept blocks, joined by an empty line."""
    found, root, out = flat_blocks(page), tree(), []
    for b, x in zip(found, features(found), strict=True):
        if b.zone < 0:
            continue
        node = root
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.bound else node.high
        if node.keep:
            out.append(b.text)
    return "\n\n".join(out)


def extract(df: DataFrame, page: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The columns of df named in keep (default: page_id, url) with the main text of every page."""
    keep = ["page_id", "url"] if keep is None else keep
    names = [f"__k{i}" for i in range(len(keep))]
    rows = df.select(F.col(page).alias("__html"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = rows.select(*names).schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, pages in blocks(batch, 0):
                yield pa.RecordBatch.from_arrays([*(part.column(i + 1) for i in range(len(names))), pa.array([main_text(p) for p in pages], pa.string())], names=[f.name for f in schema])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "text")
