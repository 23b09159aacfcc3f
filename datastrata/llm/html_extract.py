"""Operator 10: main text of web pages.

A page becomes flat blocks of text. Each block has its word count and link density, those
of the blocks before and after it, and what its enclosing elements say. A decision tree
grown on the small labelled table below (Gini impurity, grown once in each worker) tells main text from the rest.

Blocks: text between block-level tags, character references decoded, white space made one
space, trimmed; line breaks and inline tags do not end a block. Scripts, styles, templates, the head and
comments are not text. Unclosed elements end with their parent, an
unclosed menu or page header where an article or main element begins, an unclosed button or image where a paragraph does;
only scripts and styles that are not closed run to the end of the page. Names count as whole words at the ends of a class name, of any number and length, never
those of the body or of what holds the main element; those of what holds the first article do not count where no paragraph and no article is outside of
such names. An article in a sidebar is a teaser. A block is outside if any element around it is, at any depth.
A page is read once, in time linear in its length.

Defined cases: a null or empty page has no text; plain text without tags is one block;
equal rows get equal results; null page_id and url are kept; an empty table gives no row; other
columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datastrata.llm.common import small_batches, table

BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose content is not markup: it ends at their closing tag only.
RAW_TAGS = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements without main text. The second kind holds no paragraphs: one that is not closed ends where one begins.
SILENT_TAGS = frozenset("noscript template object head svg button select canvas audio video".split())
SMALL_SILENT_TAGS = frozenset("svg button select head".split())
PARAGRAPHS = frozenset("article main section p h1 h2 h3 h4 h5 h6 header footer nav aside body".split())
OUTSIDE_TAGS = frozenset("nav header footer aside form menu dialog".split())
#: Words of class names and ids that mark what is around an article, and words before or after them that
#: only say how a page looks.
OUTSIDE_WORDS = frozenset(
    "ad ads adbox adsense adslot adunit advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus "
    "footer header menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promotion related replies reply "
    "respond share sharing sidebar social sponsor sponsored subscribe teaser teasers thread toolbar widget widgets".split()
)
LOOK_WORDS = frozenset("has no with without is not show hide enable enabled disable disabled open closed on off visible hidden layout template theme".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)?\s*(=)?\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    outside: bool
    article: bool
    heading: bool
    paragraph: bool


@dataclass(eq=False)
class Element:
    tag: str
    outside: bool = False  # by its tag or role
    named: bool = False  # by a class name or id
    silent: bool = False
    holder: Element | None = None  # of a named one: the next named one around it
    marked: bool = False  # it or one around it is named


class Tags:
    """Tags of a page, one after another. Every character is looked at a bounded number of times: what is not found once is
    not looked for again."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in "\"'>"}
        self.loose = False  # a tag with quotes had no end: from there on a tag ends at the first ">"

    def end(self, at: int) -> tuple[int, dict[str, str]] | None:
        """From after a tag's name: where it ends and its class, id and role; None if nowhere."""
        page, n = self.page, len(self.page)
        if at > self.last[">"]:
            return None
        if self.loose:
            return page.index(">", at) + 1, {}
        found: dict[str, str] = {}
        start = at
        while at < n:
            if page[at] == ">":
                return at + 1, found
            m = _ATTRIBUTE.match(page, at)
            at = m.end()
            if m[2]:
                quote = page[at : at + 1]
                if quote in ("'", '"') and at < self.last[quote]:
                    close = page.index(quote, at + 1)
                    value, at = page[at + 1 : close], close + 1
                else:
                    m2 = _UNQUOTED.match(page, at)
                    value, at = m2[0], m2.end()
                if m[1] and (name := m[1].lower()) in ("class", "id", "role"):
                    found.setdefault(name, value)
            elif m.end() == m.start():  # cannot be: a character is a space, a name or one of / > =
                at += 1
        self.loose = True
        return page.index(">", start) + 1, {}


def outside_name(value: str) -> bool:
    """Whether a class or id names what is around an article."""
    for token in value.split():
        parts = _PARTS.findall(_HUMP.sub("-", token).lower())
        if parts and not LOOK_WORDS.intersection(parts) and (parts[0] in OUTSIDE_WORDS or parts[-1] in OUTSIDE_WORDS):
            return True
    return False


def _element(tag: str, attributes: dict[str, str]) -> Element:
    e = Element(tag, tag in OUTSIDE_TAGS or attributes.get("role", "").lower() in OUTSIDE_ROLES, silent=tag in SILENT_TAGS)
    if tag not in ("html", "body", "main"):
        e.named = any(outside_name(attributes[key]) for key in ("class", "id") if key in attributes)
    return e


def _mark(frames: list[Element]) -> None:
    """From the outside in: what is named, or in something that is."""
    for e in frames:
        e.marked = e.named or (e.holder is not None and e.holder.marked)


def blocks(page: str) -> list[Block]:
    out: list[tuple[Block, Element | None]] = []  # with the nearest named element around it
    stack: list[Element] = []
    named: list[Element] = []  # those of the stack
    open_: Counter[str] = Counter()
    n = Counter()  # open elements that are silent, outside, article or main, headings, links
    parts: list[str] = []
    frames: list[Element] = []  # all named elements, outer ones first
    around: list[Element] = []  # those around the first article
    linked = 0
    tags, raw_end = Tags(page), {}

    def count(e: Element, by: int) -> None:
        open_[e.tag] += by
        n["silent"] += by * e.silent
        # A header in an article is the article's own.
        n["outside"] += by * e.outside
        n["article"] += by * (e.tag in ("article", "main"))
        n["heading"] += by * (e.tag in HEADINGS)
        n["links"] += by * (e.tag == "a")

    def push(e: Element) -> None:
        if e.tag == "header" and n["article"]:
            e.outside = False
        stack.append(e)
        count(e, 1)
        if e.named:
            e.holder = named[-1] if named else None
            named.append(e)
            frames.append(e)

    def pop() -> Element:
        e = stack.pop()
        count(e, -1)
        if named and named[-1] is e:
            named.pop()
        return e

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                words = text.count(" ") + 1
                out.append((Block(text, words, min(linked, words), n["outside"] > 0, n["article"] > 0, n["heading"] > 0, open_["p"] > 0), named[-1] if named else None))
            parts.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not n["silent"]:
            parts.append(raw)
            if n["links"]:
                linked += len(raw.split())

    at, seen_article = 0, False
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > tags.last[">"]:  # no tag is left
            say(page[at:])
            break
        follows = page[lt + 1 : lt + 2]
        if follows in ("!", "?"):
            say(page[at:lt])
            if page.startswith("<!--", lt):
                close, size = page.find("-->", lt + 4), 3
            elif page.startswith("<![CDATA[", lt):
                close, size = page.find("]]>", lt), 3
                say(html.escape(page[lt + 9 : close if close >= 0 else len(page)]))
            else:
                close, size = page.find(">", lt), 1
            at = close + size if close >= 0 else len(page)
            continue
        closing = follows == "/"
        m = _NAME.match(page, lt + 1 + closing)
        stop = tags.end(m.end()) if m else None
        if stop is None:  # not a tag
            say(page[at : lt + 1])
            at = lt + 1
            continue
        say(page[at:lt])
        at, attributes = stop
        tag = m[0].lower()
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS:
            end()
        if closing:
            if open_[tag]:
                while pop().tag != tag:
                    pass
            continue
        whole = page[at - 2] == "/"
        if tag in RAW_TAGS:
            if not whole:
                if raw_end.get(tag, 0) >= 0 and raw_end.get(tag, 0) < at:
                    close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                    raw_end[tag] = close.start() if close else -1
                if raw_end[tag] >= at:
                    at = raw_end[tag]
                elif tag in ("script", "style"):
                    at = len(page)
            continue
        if tag in PARAGRAPHS:
            while stack and stack[-1].tag in SMALL_SILENT_TAGS:
                pop()
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1].tag == tag:
            pop()
        if tag in ("article", "main"):
            while stack and stack[-1].tag in ("nav", "header", "ul", "li"):
                pop()
            if tag == "main":  # what holds it is the page's frame, whatever its name
                for e in named:
                    e.named = False
                named.clear()
            elif not seen_article:
                around = list(named)
            seen_article = True
        if tag not in VOID_TAGS and not whole:
            push(_element(tag, attributes))
    end()
    _mark(frames)
    inner = lambda: any(not (b.outside or (e is not None and e.marked)) for b, e in out if b.paragraph or b.article)
    if around and not inner():
        for e in around:
            e.named = False
        _mark(frames)
    for block, e in out:
        block.outside |= e is not None and e.marked
        block.article &= not block.outside
    return [block for block, _ in out]


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "outside", "article", "other_article", "heading")


def features(found: list[Block]) -> np.ndarray:
    """A row per block, in the order of ``FEATURES``."""
    n = len(found)
    words = np.array([b.words for b in found], dtype=float)
    density = np.array([b.linked / b.words for b in found], dtype=float)
    shift = lambda x, by: np.concatenate([[0.0], x[:-1]]) if by < 0 else np.concatenate([x[1:], [0.0]])
    article = np.array([b.article for b in found], dtype=float)
    return np.stack(
        [
            words,
            density,
            shift(words, -1),
            shift(density, -1),
            shift(words, 1),
            shift(density, 1),
            np.array([b.outside for b in found], dtype=float),
            article,
            np.full(n, article.max() if n else 0.0) - article,
            np.array([b.heading for b in found], dtype=float),
        ],
        axis=1,
    )


#: The labelled table: blocks of made-up pages as in ``FEATURES``, and whether each is main text.
LABELLED: list[tuple[tuple[float, ...], int]] = [
    # an article element with a menu, an advert and a footer around it
    ((1, 1.0, 0, 0, 1, 1.0, 1, 0, 1, 0), 0), ((1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0), 0), ((9, 0, 1, 1.0, 8, 0, 1, 0, 1, 0), 0),
    ((8, 0, 9, 0, 12, 0, 0, 1, 0, 1), 1), ((12, 0, 8, 0, 150, 0, 0, 1, 0, 0), 1), ((150, 0, 12, 0, 40, 0, 0, 1, 0, 0), 1),
    ((40, 0, 150, 0, 3, 0, 0, 1, 0, 0), 1), ((3, 0, 40, 0, 10, 0, 0, 1, 0, 0), 1), ((14, 0, 3, 0, 0, 0, 1, 0, 1, 0), 0),
    ((60, 0, 5, 0, 80, 0, 0, 1, 0, 0), 1), ((1, 0, 60, 0, 90, 0, 0, 1, 0, 0), 1), ((30, 0.9, 60, 0, 20, 0, 0, 1, 0, 0), 1),
    ((2, 1.0, 60, 0, 50, 0, 0, 1, 0, 0), 1), ((45, 0.1, 20, 0.2, 50, 0, 0, 1, 0, 0), 1), ((25, 0, 3, 0, 12, 0, 0, 1, 0, 0), 1),
    # inside an article, but a share bar, a form, reader comments
    ((4, 1.0, 80, 0, 30, 0, 1, 1, 0, 0), 0), ((30, 0, 4, 1.0, 25, 0, 1, 1, 0, 0), 0), ((70, 0, 3, 0, 45, 0, 1, 1, 0, 0), 0),
    ((6, 0, 40, 0, 2, 0, 1, 1, 0, 1), 0),
    # beside an article element: notices, sidebars, credits without a telling name
    ((20, 0, 0, 0, 4, 1.0, 0, 0, 1, 0), 0), ((35, 0, 4, 1.0, 8, 0, 0, 0, 1, 0), 0), ((60, 0.1, 150, 0, 10, 0, 0, 0, 1, 0), 0),
    ((5, 0, 70, 0, 3, 1.0, 0, 0, 1, 1), 0), ((3, 1.0, 5, 0, 3, 1.0, 0, 0, 1, 0), 0), ((100, 0, 20, 0, 9, 0, 0, 0, 1, 0), 0),
    # pages without article or main elements
    ((2, 1.0, 0, 0, 2, 1.0, 0, 0, 0, 0), 0), ((3, 1.0, 2, 1.0, 7, 0, 0, 0, 0, 0), 0), ((7, 0, 3, 1.0, 90, 0, 0, 0, 0, 1), 1),
    ((90, 0, 7, 0, 120, 0.02, 0, 0, 0, 0), 1), ((120, 0.02, 90, 0, 35, 0, 0, 0, 0, 0), 1), ((35, 0, 120, 0.02, 5, 0, 0, 0, 0, 1), 1),
    ((5, 0, 35, 0, 60, 0, 0, 0, 0, 1), 1), ((60, 0, 5, 0, 12, 0.5, 0, 0, 0, 0), 1), ((12, 0.5, 60, 0, 3, 1.0, 0, 0, 0, 0), 0),
    ((3, 1.0, 12, 0.5, 6, 0, 0, 0, 0, 0), 0), ((6, 0, 3, 1.0, 0, 0, 0, 0, 0, 0), 0), ((15, 0.8, 60, 0, 14, 0.9, 0, 0, 0, 0), 0),
    ((200, 0.01, 4, 0, 0, 0, 0, 0, 0, 0), 1), ((80, 0, 0, 0, 0, 0, 0, 0, 0, 0), 1), ((9, 0, 0, 0, 0, 0, 0, 0, 0, 0), 1),
    ((18, 0, 60, 0, 70, 0, 0, 0, 0, 0), 1), ((11, 0, 90, 0, 45, 0, 0, 0, 0, 0), 1), ((4, 0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), 0),
    ((10, 0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), 0), ((25, 0, 6, 0, 40, 0, 0, 0, 0, 0), 1), ((50, 0, 4, 1.0, 8, 0, 1, 0, 0, 0), 0),
    ((28, 0, 0, 0, 60, 0, 1, 0, 0, 0), 0), ((8, 0, 28, 0, 60, 0, 1, 0, 0, 1), 0),
    # paragraphs before links, and links after paragraphs
    ((60, 0, 45, 0, 1, 1.0, 0, 0, 0, 0), 1), ((45, 0, 30, 0, 2, 1.0, 0, 0, 0, 0), 1), ((80, 0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), 1),
    ((1, 1.0, 60, 0, 0, 0, 0, 0, 0, 0), 0), ((2, 1.0, 45, 0, 3, 1.0, 0, 0, 0, 0), 0), ((1, 1.0, 80, 0, 40, 0, 0, 0, 0, 0), 0),
    ((4, 0.75, 90, 0, 12, 0, 0, 0, 0, 0), 0), ((20, 0.7, 100, 0, 5, 0, 0, 0, 0, 0), 0), ((40, 0, 20, 0.7, 60, 0, 0, 0, 0, 0), 1),
    ((70, 0.15, 60, 0, 60, 0, 0, 0, 0, 0), 1), ((50, 0.25, 40, 0.1, 80, 0, 0, 0, 0, 0), 1), ((120, 0.3, 60, 0.2, 30, 0, 0, 0, 0, 0), 1),
    ((2, 1.0, 30, 0, 40, 0, 0, 1, 0, 0), 1), ((50, 0, 12, 0, 3, 1.0, 0, 1, 0, 0), 1), ((15, 0, 2, 1.0, 4, 1.0, 0, 1, 0, 0), 1),
]


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, rows: list[tuple[tuple[float, ...], int]] = LABELLED, depth: int = 6):
        x, y = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows])
        self.root = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if not depth or len(set(y.tolist())) < 2:
            return bool(2 * y.sum() > len(y)) if len(y) else False
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= cut
                cost = sum(m.sum() * 2 * (p := y[m].mean()) * (1 - p) for m in (low, ~low))
                if best is None or cost < best[0] - 1e-9:
                    best = (cost, f, cut)
        if best is None:
            return bool(2 * y.sum() > len(y))
        _, f, cut = best
        low = x[:, f] <= cut
        return f, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), dtype=bool)

        def walk(node, rows: np.ndarray) -> None:
            if isinstance(node, bool):
                out[rows] = node
            elif len(rows):
                f, cut, low, high = node
                below = x[rows, f] <= cut
                walk(low, rows[below])
                walk(high, rows[~below])

        walk(self.root, np.arange(len(x)))
        return out


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree.predict(features(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = Tree()
    for batch in batches:
        texts = [main_text(p, tree) for p in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    small_batches(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return p.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
