"""HTML extraction: the main text of a page, by text-to-tag ratios of its lines.

Pages stream through the standard library's event parser. Each block of text is a line, with its
number of characters, its tags and the element that holds it. The ratios of characters to tags are
smoothed along the page with a Gaussian; lines above a threshold (a share of their standard
deviation) cluster into content. The region of a page is the innermost element around the largest
share of the clusters' text; an article (or main) element around it or, where there is none, those
inside it that hold content, take its place. Where no element below the body is the region, it goes
from the first content line, with the headings before it, to the last.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are
no lines at all where element, role, class or id says so plainly. Names that an article's own blocks
have as well (``WEAK``) only break ties: such a line goes where its own ratio is below the threshold.

Time is linear in the page, however deep its elements are and whatever is left open.

Defined cases: null, empty and tagless pages (a tagless text is its own main text); elements left
open end with the element around them; a menu or advert left open ends where an article or main
element starts; white space inside a block becomes one space and blocks are joined by one space.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, table

# Fixed values of HTML and of common page layouts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div html main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset("nav aside footer form script style noscript template iframe head button select textarea svg dialog menu canvas audio video datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs byline comment comments consent cookie cookies "
    "discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager "
    "popup promo promotion recommended reply respond sidebar signup skip sponsor sponsored subscribe subscription toolbar topbar".split()
)
WEAK = frozenset("banner copyright disclaimer related replies share sharing social tags teaser widget widgets".split())
MILD = frozenset("has with no without".split())
IN_ARTICLE = frozenset("header byline".split())  # unwanted outside the article only
OF_ARTICLE = frozenset("article entry post story".split())
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
CLOSED_BY = {t: [a for a, tags in CLOSES.items() if t in tags] for t in BLOCKS}  # of each block: what its start ends
SCOPES = CONTAINERS | {"ul", "ol", "dl", "table"}  # a start ends nothing outside of these
SIGMA, SHARE, MOST = 1.5, 0.5, 0.7
KEPT, TIED, GONE = 0, 1, 2


def _names(said: str) -> set[str]:
    """Words of all class and id names; a name ends before its first ``MILD`` word, as ``no-sidebar`` says nothing of a sidebar here."""
    out: set[str] = set()
    for name in said.split():
        for word in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()):
            if word in MILD:
                break
            out.add(word)
    return out


def _standing(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """What an element says of itself: that it is unwanted (GONE), or so where it is no content (TIED)."""
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return GONE
    if tag in ("html", "body", "main") or tag in HEADINGS:
        return KEPT
    if tag == "header":
        return KEPT if in_article else GONE
    if attrs.get("role") in ROLES:
        return GONE
    if not ("class" in attrs or "id" in attrs):
        return KEPT
    names = _names(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")
    found = names & NAMES
    if found - IN_ARTICLE or found and not in_article and not names & OF_ARTICLE:
        return GONE
    return TIED if names & WEAK else KEPT


class Page(HTMLParser):
    """Lines of a page: text, tags, holder, whether it is a heading, and its standing."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int]] = [("", 0, KEPT)]  # tag, holder, standing
        self.holders: list[tuple[str, int]] = [("", -1)]  # of each containing element: tag, the one around it
        self.count: Counter = Counter()  # of open elements
        # Open elements by tag since the last scope (for what a start ends) and since the last block (for ends of inline elements).
        self.scopes: list[Counter] = [Counter()]
        self.inline: list[Counter] = [Counter()]
        self.titles = [False]  # of each open block: whether it is a heading, or a plain division of one
        self.lines: list[tuple[str, int, int, bool, int]] = []
        self.text: list[str] = []
        self.tags = 0

    def _push(self, tag: str, holder: int, standing: int) -> None:
        self.open.append((tag, holder, standing))
        self.count[tag] += 1
        self.scopes[-1][tag] += 1
        if tag in SCOPES:
            self.scopes.append(Counter())
        if tag in BLOCKS:
            self.inline.append(Counter())
            self.titles.append(tag in HEADINGS or tag == "div" and self.titles[-1])
        else:
            self.inline[-1][tag] += 1

    def _pop(self) -> str:
        tag = self.open.pop()[0]
        self.count[tag] -= 1
        if tag in SCOPES:
            self.scopes.pop()
        self.scopes[-1][tag] -= 1
        if tag in BLOCKS:
            self.inline.pop()
            self.titles.pop()
        else:
            self.inline[-1][tag] -= 1
        return tag

    def _end_line(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                _, holder, standing = self.open[-1]
                self.lines.append((text, self.tags, holder, self.titles[-1], standing))
            self.text.clear()
        self.tags = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in BLOCKS:
            self._end_line()
            if ended := [x for x in CLOSED_BY[tag] if self.scopes[-1][x] > 0]:
                while self._pop() not in ended:
                    pass
        self.tags += 1
        if tag in VOID:
            return
        _, holder, standing = self.open[-1]
        given = {k: v or "" for k, v in attrs}
        own = _standing(tag, given, self.count["article"] > 0)
        if tag in ("article", "main") and not own:
            standing = KEPT
        if tag in CONTAINERS or tag == "header":
            self.holders.append(("main" if given.get("role") == "main" else tag, holder))
            holder = len(self.holders) - 1
        self._push(tag, holder, max(standing, own))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open[-1][0] == tag:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end_line()
        if not self.count[tag]:
            self.tags += 1
        elif tag in BLOCKS or self.inline[-1][tag]:  # else an inline element that blocks have left behind
            while self._pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.open[-1][2] != GONE:
            self.text.append(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """values under a Gaussian window, with edges repeated."""
    r = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def main_text(html: str, chunk: int = 1 << 16) -> str:
    """The main text of one page."""
    page = Page()
    for at in range(0, len(html), chunk):
        page.feed(html[at : at + chunk])
    page.close()
    lines = page.lines
    if not lines:
        return ""
    size = np.array([len(x[0]) for x in lines], float)
    content, dense = clusters(size, np.array([x[1] for x in lines]))
    holder = np.array([x[2] for x in lines])
    weak = np.array([x[4] == TIED for x in lines])
    own = np.flatnonzero(_region(page.holders, holder, size, content, [x[3] for x in lines]) & (dense | ~weak))
    return " ".join(lines[i][0] for i in own)


def clusters(size: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is content, as its smoothed ratio of characters to tags reaches the threshold; and whether its own ratio does."""
    own = size / np.maximum(1, tags)
    ratio = smoothed(own)
    least = SHARE * ratio.std()
    content = ratio >= least
    return (content if content.any() else ~content), own >= least


def _region(holders: list[tuple[str, int]], holder: np.ndarray, size: np.ndarray, content: np.ndarray, heading: list[bool]) -> np.ndarray:
    """Which lines lie in the page's region."""
    n = len(holders)
    mass = np.bincount(holder[content], size[content], minlength=n)
    last = np.arange(n)  # of each element: the last one inside it, as elements are numbered in the order of their starts
    for h in range(n - 1, 0, -1):
        around = holders[h][1]
        mass[around] += mass[h]
        last[around] = max(last[around], last[h])
    best = int(np.flatnonzero(mass >= MOST * mass[0])[-1])
    inside = (holder >= best) & (holder <= last[best])
    for tag in ("article", "main"):
        outer = np.full(n, -1)  # of each element: the outermost such element around it
        for h in range(1, n):
            above = outer[holders[h][1]]
            outer[h] = above if above >= 0 else h if holders[h][0] == tag else -1
        if outer[best] >= 0:
            return outer[holder] == outer[best]
        found = np.unique(outer[holder[content & inside]])
        if len(found := found[found >= 0]):
            return np.isin(outer[holder], found)
    if holders[best][0] not in ("", "html", "body"):
        return inside
    core = np.flatnonzero(content & inside)
    first = core[0]
    while first and inside[first - 1] and heading[first - 1]:
        first -= 1
    at = np.arange(len(holder))
    return inside & (at >= first) & (at <= core[-1])


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text and n_chars."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [main_text(x.as_py() or "") for x in part.column("html")]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_batches(own, run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(table(spark, sf_dir, "pages"))
