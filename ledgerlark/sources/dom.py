"""Listings of web pages by selectors: a tolerant tree of elements, and CSS selectors compiled to a matcher.

A page becomes one list of elements in order; each knows where its subtree and its text end. A selector becomes its steps
from left to right, and one pass over the elements carries, as bits, how many steps the ancestors of an element have
matched, so a page costs its elements times the steps, whatever their nesting. Of several lists of selectors the first
one that finds rows counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.sources import web
from ledgerlark.sources.tags import Tags, attributes

# fixed values of the HTML standard: elements without an end, and which open ones an element ends
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS |= {tag: ("p",) for tag in BLOCKS}
#: An open element isn't looked for beyond these.
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}


@dataclass(slots=True)
class Element:
    tag: str
    attrs: dict[str, str]
    classes: frozenset[str]
    parent: int
    text: int  # number of the first piece of text inside
    end: int = -1  # number of the first element behind the subtree
    text_end: int = -1


class Page:
    """The elements of a page in order, the page itself first, and its pieces of text."""

    def __init__(self, html: str):
        self.elements = [Element("", {}, frozenset(), -1, 0)]
        self.open, self.texts = [0], []
        # how many elements of a tag are open, so that none is looked for in vain
        self.opened: Counter[str] = Counter()
        self._read(html)
        self._end(0)

    def _end(self, depth: int) -> None:
        for i in self.open[depth:]:
            self.elements[i].end, self.elements[i].text_end = len(self.elements), len(self.texts)
            self.opened[self.elements[i].tag] -= 1
        del self.open[depth:]

    def _close(self, tags: Iterable[str], walls: Iterable[str]) -> None:
        if not any(self.opened[tag] for tag in tags):
            return None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.elements[self.open[depth]].tag
            if tag in tags:
                return self._end(depth)
            if tag in walls:
                return None
        return None

    def _read(self, html: str) -> None:
        tags, at = Tags(html), 0
        while at < len(html) and (tag := tags.next(at)):
            begin, end, name, attrs, closes = tag
            self._text(html[at:begin])
            at = end
            if name is None:
                continue
            name = name.lower()
            if closes:
                # the end of something small doesn't close a block around it
                self._close((name,), ("table",) if name in BLOCKS or name in ENDS else BLOCKS | {"td", "th", "li"})
                continue
            self._begin(name, attrs)
            if name in RAW:
                inner, at = tags.raw_end(name, end)
                if name in ("textarea", "title"):
                    self._text(html[end:inner])
                self._end(len(self.open) - 1)
        self._text(html[at:])

    def _begin(self, tag: str, attrs: str) -> None:
        if tag in ENDS:
            self._close(ENDS[tag], WALLS.get(tag, ("table", "td", "th", "button")))
        own = {k: unescape(v) for k, v in reversed(attributes(attrs))}
        self.elements.append(Element(tag, own, frozenset(own.get("class", "").split()), self.open[-1], len(self.texts)))
        self.open.append(len(self.elements) - 1)
        self.opened[tag] += 1
        if tag in VOID:
            self._end(len(self.open) - 1)

    def _text(self, text: str) -> None:
        if text:
            self.texts.append(unescape(text))

    def text(self, i: int) -> str:
        """The text of an element with single spaces."""
        return " ".join(" ".join(self.texts[self.elements[i].text : self.elements[i].text_end]).split())


STEP = re.compile(r"\s*(>?)\s*(\*|[\w-]+)?((?:[.#][\w-]+|\[[^\]]*\])*)")
PART = re.compile(r"([.#])([\w-]+)|\[\s*([\w-]+)\s*(?:([*^$~|]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]+))\s*)?\]")
TESTS = {
    "=": str.__eq__,
    "*=": lambda own, v: v != "" and v in own,
    "^=": lambda own, v: v != "" and own.startswith(v),
    "$=": lambda own, v: v != "" and own.endswith(v),
    "~=": lambda own, v: v in own.split(),
    "|=": lambda own, v: own == v or own.startswith(v + "-"),
}


@dataclass(frozen=True)
class Step:
    """What an element must be: its tag (empty: any), classes and attributes; and whether it must be a child."""

    child: bool
    tag: str
    classes: frozenset[str]
    attrs: tuple[tuple[str, str, str], ...]

    def fits(self, e: Element) -> bool:
        if (self.tag and self.tag != e.tag) or not self.classes <= e.classes:
            return False
        return all(name in e.attrs and (not test or TESTS[test](e.attrs[name], value)) for name, test, value in self.attrs)


@lru_cache(maxsize=256)
def compiled(selectors: str) -> tuple[tuple[Step, ...], ...]:
    """The steps of each of the selectors parted by commas: tags, ``*``, classes, ids and attributes (there, equal, with a part,
    a begin, an end or a word), below (a space) or right below (``>``) one another."""
    found = []
    for one in re.split(r",(?![^\[]*\])", selectors):
        one, at, steps = one.strip(), 0, []
        while at < len(one):
            m = STEP.match(one, at)
            if m.end() == at or not (m[2] or m[3]) or (m[1] and not steps):
                raise ValueError(f"not a selector: {one!r}")
            classes, attrs = set(), []
            parts = list(PART.finditer(m[3]))
            if "".join(p[0] for p in parts) != m[3]:
                raise ValueError(f"not a selector: {one!r}")
            for p in parts:
                if p[1] == ".":
                    classes.add(p[2])
                else:
                    attrs.append(("id", "=", p[2]) if p[1] else (p[3].lower(), p[4] or "", p[5] or p[6] or p[7] or ""))
            tag = "" if m[2] in (None, "*") else m[2].lower()
            steps.append(Step(bool(m[1]), tag, frozenset(classes), tuple(attrs)))
            at = m.end()
        if not steps:
            raise ValueError(f"not a selector: {selectors!r}")
        found.append(tuple(steps))
    return tuple(found)


def matched(page: Page, selectors: str) -> list[int]:
    """The numbers of the elements that any of ``selectors`` fits, in order."""
    found: set[int] = set()
    for steps in compiled(selectors):
        # of each element: which numbers of steps it has matched itself, and which it or an ancestor has
        own, below = [0] * len(page.elements), [0] * len(page.elements)
        for i, e in enumerate(page.elements[1:], 1):
            bits = 0
            for k, step in enumerate(steps):
                if (k == 0 or (own if step.child else below)[e.parent] >> k & 1) and step.fits(e):
                    bits |= 2 << k
            own[i], below[i] = bits, below[e.parent] | bits
            if bits >> len(steps) & 1:
                found.add(i)
    return sorted(found)


@dataclass(frozen=True)
class Listing:
    """How a page's listing is read: lists of selectors, of which the first one that finds something counts, for rows and for
    title, date and summary inside a row; a row that is a link itself has a title and an address alone."""

    rows: tuple[str, ...]
    title: tuple[str, ...] = ("a",)
    date: tuple[str, ...] = ()
    summary: tuple[str, ...] = ()
    most: int = 30
    least_chars: int = 5
    summary_chars: int = 500

    def read(self, html: str) -> list[dict[str, str | None]]:
        """title, href, date (the ``datetime`` of its element or else its text) and summary of the first ``most`` rows; those with a
        title of fewer than ``least_chars`` characters are left out of these."""
        page = Page(html)
        rows = next((r for s in self.rows if (r := matched(page, s))), [])
        inner = {s: matched(page, s) for s in (*self.title, *self.date, *self.summary)} if rows else {}

        def first(row: int, lists: tuple[str, ...]) -> int | None:
            for s in lists:
                k = bisect_left(inner[s], row + 1)
                if k < len(inner[s]) and inner[s][k] < page.elements[row].end:
                    return inner[s][k]
            return None

        found = []
        for row in rows[: self.most]:
            link = page.elements[row].tag == "a"
            title = row if link else first(row, self.title)
            said = page.text(title) if title is not None else ""
            if len(said) < self.least_chars:
                continue
            date, summary = (None, None) if link else (first(row, self.date), first(row, self.summary))
            when = None if date is None else page.elements[date].attrs.get("datetime") or page.text(date)
            about = "" if summary is None else page.text(summary)[: self.summary_chars]
            found.append({"title": said, "href": page.elements[title].attrs.get("href", ""), "date": when, "summary": about})
        return found


def rows_of(html: Column, listing: Listing) -> Column:
    """The rows of a page's listing; none for null."""

    @F.pandas_udf("array<struct<title:string,href:string,date:string,summary:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: listing.read(page or ""))

    return run(html)


def listed(pages: DataFrame, key: str, url: str, html: str, listing: Listing) -> DataFrame:
    """key, place (from 0), title, url (against the page's address; empty without one), date and summary of all pages' rows."""
    rows = pages.select(key, F.col(url).alias("__url"), F.posexplode(rows_of(F.col(html), listing)).alias("place", "r"))
    whole = F.when(F.col("r.href") == "", "").otherwise(web.absolute(F.col("__url"), F.col("r.href")))
    return rows.select(key, "place", "r.title", whole.alias("url"), "r.date", "r.summary")
