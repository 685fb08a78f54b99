"""Main text of raw HTML: flat text blocks and a decision tree.

A page becomes a flat list of text blocks.  Blocks in a menu, header, footer,
sidebar, notice, advert, form or comment, by element or by class, id and role,
are out.  Each other block has its word count and link density, those of the
block before and after, whether it is a list item and whether it stands in an
article; a decision tree, grown with numpy on the small labelled table below,
says which are main text.  A page whose wrapper is misnamed as a sidebar or a
form, so that no main text is found elsewhere, is read as if that had no name.

Defined results: null or empty html, and pages without main text, give an empty
text; broken markup (unclosed tags and quotes, cut-off pages) is read as far as
it goes, in time that grows with the page's length; repeated pages each get a
row; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netweave.llm.common import arrow_map, slices

#: Elements by their part in the layout.
SKIPPED = frozenset("script style noscript template svg math head title object canvas iframe select textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL = frozenset("p li dt dd tr td th option".split())
CONTAINERS = {"article": "article", "main": "article", "nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "button": "form", "dialog": "notice", "fieldset": "form"}
#: Words of class and id attributes -> kind of container.
HINTS = {
    "article": "article entry story post prose",
    "nav": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toc skip sitemap topnav",
    "header": "header masthead topbar pagehead siteheader",
    "footer": "footer copyright colophon legal bottom sitefooter",
    "aside": "sidebar aside related widget widgets rail recommended popular trending tags share social sharing",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion banner adsense teaser",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe paywall toast disclaimer",
    "form": "form login signup signin register search searchbox contact",
    "comment": "comment comments commentlist reply replies respond disqus discussion reader",
}
HINT_OF = {w: kind for kind, words in HINTS.items() for w in words.split()}
#: Words without a name, at least, that are a page's main text, so that no misnamed wrapper is looked into.
LEAST_WORDS = 10
#: Kinds of containers that may be main text, and those that are where nothing else is.
MAIN, MISNAMED = frozenset(("article", "none")), frozenset(("aside", "form"))
#: Names with one of these words tell of a layout, not of what is inside ("no-sidebar", "header-fixed").
LAYOUT = frozenset("no not non without has have with hide hidden layout fixed sticky open closed collapsed enabled disabled content".split())

_NAME = re.compile(r"[A-Za-z][^\s/><]*")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {x: re.compile(rf"</{x}\b", re.I) for x in SKIPPED} | {"head": re.compile(r"</head\s*>|<body\b", re.I)}


def container(tag: str, attributes: str, outer: str, firm: bool) -> str:
    """The kind of container that an opening tag begins ('' keeps ``outer``); ``firm``: an element of that kind is open."""
    if tag in ("html", "body"):
        return ""  # their names tell of the whole page
    if tag == "header" and outer == "article":
        return ""  # the head of an article holds its title
    if tag == "article" and outer in ("comment", "aside"):
        return ""  # a comment or a teaser
    if tag in CONTAINERS:
        return CONTAINERS[tag]
    weak = ""
    if attributes:
        for groups in _NAMED.findall(attributes):
            for name in "".join(groups).split():
                parts = [x.lower() for x in _PART.findall(name)]
                if not LAYOUT.isdisjoint(parts):
                    continue
                for part in parts:
                    kind = HINT_OF.get(part)
                    if kind == "article":
                        weak = kind  # as in "post-comments": any other word decides
                    elif kind and not (kind == "header" and outer == "article"):
                        return kind
    # A name undoes an outer name or a form around the page, but no element such as <nav>, and neither comments nor asides.
    return "" if outer in ("comment", "aside") or firm and outer != "form" else weak


class _Tags:
    """The tags of a page in order, in time that grows with its length, however broken it is."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quotes = True  # until quotes have swallowed the rest of the page once

    def end(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends, -1 if it does not."""
        if at > self.last:
            return -1
        start = at
        while self.quotes:
            m = _STOP.search(self.page, at)
            if m is None:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            else:  # a quote without its fellow is an ordinary character: there is no other one after it
                close = self.page.find(m[0], m.end())
                at = close + 1 if close >= 0 else m.end()
        return self.page.find(">", start)

    def __iter__(self) -> Iterator[tuple[str, str, str, bool]]:
        """(text before, tag name or '', attributes, whether it closes); text after the last tag comes with ''."""
        page, n = self.page, len(self.page)
        self.at = 0  # where to go on; the reader may move it
        while True:
            at = self.at
            open_ = page.find("<", at)
            if open_ < 0:
                yield page[at:], "", "", False
                return
            nxt = page[open_ + 1 : open_ + 2]
            if nxt in ("!", "?") and nxt:
                mark, least = ("-->", open_ + 4) if page.startswith("<!--", open_) else (">", open_ + 1)
                end = page.find(mark, least)
                self.at = end + len(mark) if end >= 0 else n
                yield page[at:open_], "", "", False
                continue
            closes = nxt == "/"
            m = _NAME.match(page, open_ + 1 + closes)
            end = self.end(m.end()) if m else -1
            if end < 0:
                cut = m and page.find("<", open_ + 1) < 0  # a tag cut off by the end of the page
                self.at = n if cut else open_ + 1
                yield page[at : open_ + (not cut)], "", "", False
                continue
            self.at = end + 1
            yield page[at:open_], m[0].lower(), page[m.end() : end], closes

    def skip(self, tag: str) -> None:
        """Go on after the end of ``tag``, or at the end of the page."""
        end = _CLOSE[tag].search(self.page, self.at)
        if tag == "head":
            self.at = end.start() if end else self.at
        else:
            close = self.page.find(">", end.end()) if end else -1
            self.at = close + 1 if close >= 0 else len(self.page)


def blocks(page: str) -> list[tuple[str, int, int, str, bool]]:
    """Flat text blocks: (text, words, words inside links, kind of container, whether it is a list item)."""
    out: list[tuple[str, int, int, str, bool]] = []
    inside: list[tuple[str, str]] = []
    depth: Counter = Counter()  # open elements by tag
    firm: Counter = Counter()  # open elements by the kind their tag stands for
    text: list[str] = []
    linked: list[str] = []
    link = item = False

    def flush() -> None:
        nonlocal text, linked
        if text:
            words = entities.unescape("".join(text)).split()
            if words:
                in_links = len(entities.unescape(" ".join(linked)).split()) if linked else 0
                out.append((" ".join(words), len(words), min(in_links, len(words)), outer(), item))
            text, linked = [], []

    def outer() -> str:
        return inside[-1][1] if inside else "none"

    def kind_of(tag: str, attributes: str) -> str:
        return container(tag, attributes, outer(), firm[outer()] > 0)

    def push(tag: str, kind: str) -> None:
        inside.append((tag, kind))
        depth[tag] += 1
        firm[CONTAINERS.get(tag)] += 1

    def pop() -> str:
        tag = inside.pop()[0]
        depth[tag] -= 1
        firm[CONTAINERS.get(tag)] -= 1
        return tag

    tags = _Tags(page)
    for piece, tag, attributes, closes in tags:
        if piece:
            text.append(piece)
            if link:
                linked.append(piece)
        if not tag:
            continue
        whole = attributes.endswith("/")
        if tag in SKIPPED and not closes:
            if tag == "head" or not whole:
                tags.skip(tag)
        elif tag == "a":
            link = not closes
        elif tag in INLINE:
            if tag == "span" and not closes and (kind := kind_of(tag, attributes)):
                flush()  # a span that is named as an advert or the like stands apart
                push(tag, kind)
            elif tag == "span" and closes and inside and inside[-1][0] == "span":
                flush()
                pop()
        else:
            flush()
            link = False
            if tag in VOID:
                continue
            item = tag in ("li", "dt", "dd") and not closes
            if tag in OPTIONAL and not closes:  # its end may be missing: it is on the stack only where it is named
                if inside and inside[-1][0] == tag:
                    pop()
                if kind := kind_of(tag, attributes):
                    push(tag, kind)
            elif not closes:
                if not whole:
                    push(tag, kind_of(tag, attributes) or outer())
            elif depth[tag]:
                while pop() != tag:
                    pass
    flush()
    return out


#: The labelled table: pages as sequences of blocks "place words linked-words label".
#: Places: a in an article, n without a name, ai and ni list items there.
LABELLED = """
a 9 0 1; a 60 0 1; a 2 0 1; a 120 4 1; a 1 0 1
a 7 0 1; a 35 0 1; a 80 2 1; a 3 0 1
a 11 0 1; a 1 0 1; a 240 0 1; a 20 20 1; a 95 1 1
a 4 0 1; a 18 1 1; a 14 0 1; a 5 0 1; a 9 9 1; a 33 0 1
a 6 0 1; a 20 0 1; a 25 0 1; a 44 0 1; a 2 2 1; a 61 0 1; a 8 0 1; a 150 9 1
a 1 0 1; a 1 0 1; a 1 0 1; a 2 0 1; a 3 3 1
a 8 0 1; a 70 2 1; a 5 5 1; a 12 11 1; a 30 28 1; a 60 3 1; a 14 9 1; a 3 3 1; a 25 20 1; a 40 40 1
a 10 0 1; a 55 0 1; a 20 20 1; a 20 20 1; a 90 0 1; a 45 1 1; a 150 150 1; a 70 0 1
a 5 0 1; a 12 0 1; ai 8 0 1; ai 15 1 1; ai 4 1 1; ai 9 0 1; a 30 0 1
a 6 0 1; a 80 0 1; ai 12 0 1; ai 4 4 1; ai 10 0 1; a 60 2 1; ai 2 0 1; ai 1 0 1; ai 40 0 1
a 7 0 1; a 70 2 1; ai 5 5 0; ai 6 6 0; ai 5 5 0; ai 7 7 0
a 7 0 1; a 45 0 1; a 3 0 1; ai 2 2 0; ai 1 1 0; ai 3 3 0; ai 1 1 0; a 90 0 1
ai 1 1 0; ai 2 2 0; ai 1 1 0; a 9 0 1; a 100 2 1; a 40 0 1; ai 8 8 0; ai 9 9 0; ai 12 12 0
a 4 0 1; ai 20 0 1; ai 35 2 1; ai 18 18 1; ai 25 0 1; ai 6 6 0; ai 6 5 0
n 3 3 0; n 2 2 0; a 8 0 1; a 60 0 1; a 35 1 1; n 5 5 0; n 4 4 0
ni 1 1 0; ni 2 2 0; ni 1 1 0; a 6 0 1; a 70 0 1; a 12 12 1; a 55 0 1; ni 2 2 0; ni 3 3 0
n 2 2 0; n 3 3 0; n 2 2 0; n 10 0 1; n 75 1 1; n 90 0 1; n 55 3 1; n 4 4 0; n 5 5 0
n 1 1 0; n 1 1 0; n 1 1 0; n 8 0 1; n 40 0 1; n 12 0 1; n 66 0 1; n 30 0 1; n 3 2 0; n 2 2 0; n 6 6 0
n 7 0 1; n 130 5 1; n 20 0 1; n 88 0 1; n 5 0 1; n 64 0 1
n 3 3 0; n 14 0 1; n 50 0 1; n 45 0 1; n 70 0 1
n 2 0 0; n 1 1 0; n 2 2 0; n 1 1 0; n 3 3 0; n 2 0 0
n 4 0 1; n 2 0 1; n 90 0 1; n 70 0 1; n 15 0 1; n 120 0 1; n 80 0 1; n 2 0 1; n 3 0 1; n 90 0 1; n 2 0 1; n 60 0 1
n 6 0 1; n 3 0 1; n 45 0 1; n 3 0 1; n 60 0 1; n 2 0 1; n 4 0 1; n 50 0 1; n 1 0 1; n 35 0 1; n 5 0 1; n 6 0 1
n 1 1 0; n 2 2 0; n 1 0 1; n 12 0 1; n 3 0 1; n 40 0 1; n 4 0 1; n 5 0 1; n 20 0 1; n 2 0 1; n 30 0 1; n 3 3 0; n 2 2 0
n 3 0 1; n 9 0 1; n 2 0 1; n 8 0 1; n 4 0 1; n 100 0 1; n 3 0 1; n 25 0 1; n 1 0 1; n 2 0 1; n 75 0 1
n 95 0 1; n 15 0 1; n 200 2 1; n 6 0 1; n 58 0 1; n 1 0 1; n 77 1 1; n 4 4 0; n 4 3 0; n 2 0 0
n 14 14 0; n 22 20 0; n 9 8 0; n 16 1 1; n 70 2 1; n 11 0 1; n 48 0 1; n 10 10 0; n 35 30 0; n 12 9 0
n 8 8 0; n 31 31 0; n 7 7 0; n 100 6 1; n 38 2 1; n 9 1 1; n 41 0 1; n 5 0 1; n 52 0 1; n 18 17 0; n 4 0 0; n 6 0 0
n 12 0 1; n 64 1 1; n 47 0 1; n 13 12 0; n 13 13 0; n 60 55 0; n 85 0 1; n 3 0 1; n 39 0 1
ni 1 1 0; ni 2 2 0; ni 1 1 0; ni 3 3 0; n 7 0 1; n 110 2 1; ni 12 0 1; ni 9 1 1; ni 30 0 1; n 60 0 1; ni 4 4 0; ni 6 6 0
ni 1 1 0; ni 1 1 0; n 5 0 1; n 80 0 1; n 25 1 1; ni 2 2 0; ni 2 2 0; ni 5 5 0; n 3 3 0
n 6 6 0; n 20 15 0; n 7 0 1; n 90 0 1; n 110 0 1; n 52 0 1; n 35 0 1; n 95 1 1; n 85 2 1; n 14 14 0; n 60 45 0
"""


def features(rows: list[tuple[int, int, bool, bool]]) -> np.ndarray:
    """A row per block (words, words in links, in an article, list item): words, link density, the same of both neighbours, article, item."""
    words = np.array([r[0] for r in rows], float)
    density = np.array([r[1] for r in rows], float) / np.maximum(words, 1)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    marks = (np.array([r[i] for r in rows], float) for i in (2, 3))
    return np.column_stack([words, density, before(words), before(density), after(words), after(density), *marks])


def labelled_table(text: str = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for line in text.strip().splitlines():
        page = [b.split() for b in line.split(";")]
        xs.append(features([(int(w), int(k), place[0] == "a", place[-1] == "i") for place, w, k, _ in page]))
        ys += [int(b[3]) for b in page]
    return np.vstack(xs), np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> tuple:
    """A decision tree by Gini impurity: (feature, threshold, left, right) or a label."""
    p = y.mean()
    if depth == 0 or p in (0, 1):
        return (int(p >= 0.5),)
    best = (p * (1 - p) * len(y) - 1e-9, None, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            q, r = y[left].mean(), y[~left].mean()
            loss = q * (1 - q) * left.sum() + r * (1 - r) * (~left).sum()
            if loss < best[0]:
                best = (loss, f, cut)
    if best[1] is None:
        return (int(p >= 0.5),)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1))


def predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0] == 1)
    left = x[:, tree[0]] <= tree[1]
    out = np.zeros(len(x), bool)
    if left.any():
        out[left] = predict(tree[2], x[left])
    if not left.all():
        out[~left] = predict(tree[3], x[~left])
    return out


def main_text(tree: tuple, page: str) -> str:
    """The main text of one page: its blocks in order, joined by newlines."""
    found = blocks(page)
    for kinds in (MAIN, MAIN | MISNAMED):
        some = [b for b in found if b[3] in kinds]
        if some:
            keep = predict(tree, features([(w, k, kind == "article", item) for _, w, k, kind, item in some]))
            kept = [b for b, k in zip(some, keep) if k]
            if any(b[3] == "article" for b in kept) or sum(b[1] for b in kept) >= LEAST_WORDS or kinds != MAIN:
                return "\n".join(b[0] for b in kept)
    return ""


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", tree: tuple | None = None) -> DataFrame:
    """One row per page: ``id_col``, url, text."""
    tree = tree or grow(*labelled_table())
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [main_text(tree, x) if x else "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=[id_col, url, "text"])

    return arrow_map(pages.select(id_col, url, html), run, f"`{id_col}` {kinds[id_col]}, `{url}` {kinds[url]}, text string")
