"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

The standard library's parser streams events; they are laid out as lines, one for each block of the page, with the text
that stands in links apart. A line's ratio is text outside links by tags; the ratios are smoothed by a Gaussian and cut at a
threshold. The lines above it are content clusters, and they alone vote: from the page down, the container that holds
most of their text is entered, until none does. Element names are a weak prior: an article or main element's lines count double.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfrontier.llm.common import only, table

SIGMA = 1.5
#: Lines above this share of the standard deviation of the smoothed ratios belong to a content cluster.
CUT = 0.5
#: A container takes the vote of its children if no child holds this share of it.
MAJORITY = 0.6
#: How much more a cluster line counts for an article or main element.
PRIOR = 2.0

# Element names by what they mean for text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas audio video select option button textarea datalist map".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CONTAINERS = frozenset("html body main article section div td table tbody tr center".split())
SEMANTIC = frozenset("main article".split())
OPTIONAL_END = frozenset("li dt dd tr td th option p".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

# Words of class and id names that mark what is not the article.
_MARK = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|sidebar|side-bar|"
    r"footer|masthead|site-header|page-header|cookie|cookies|consent|gdpr|notice|notices|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comment|comments|commentlist|reply|replies|respond|disqus|discussion|share|sharing|social|related|recommended|pagination|pager|widget|toolbar|skip-link|skiplink|search)(?:$|[\s_-]|\d)",
    re.IGNORECASE,
)
#: Of those, the words that a layout container around the article may also have in its name.
_LAYOUT = re.compile(r"sidebar|side-bar|header|footer|nav|menu|widget|search", re.IGNORECASE)
_SPACE = re.compile(r"\s+")
#: A decimal reference of more digits than any code point has; the standard library refuses to read the longest ones.
_LONG_REFERENCE = re.compile(r"&#[0-9]{100,};?")
_ROOT = 0


class Line(NamedTuple):
    text: str
    #: Characters outside links, tags, the innermost open container, the innermost layout-named element (-1: none).
    free: int
    tags: int
    node: int
    layout: int


class _Open(NamedTuple):
    name: str
    node: int
    #: 0: text counts, 1: left out up to a nested article, 2: left out.
    out: int
    layout: int


class _Lines(HTMLParser):
    """Parser events to lines. Containers and layout-named elements are trees of numbers, a parent's number is the smaller."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[_Open] = []
        self.opened: Counter[str] = Counter()
        self.lines: list[Line] = []
        self.parent, self.kind = [-1], [""]
        self.outer: list[int] = []
        self.text: list[str] = []
        self.free = self.tags = 0
        self.at = _Open("", _ROOT, 0, -1)

    def flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append(Line(text, self.free, self.tags, self.at.node, self.at.layout))
        self.text, self.free, self.tags = [], 0, 0

    def push(self, element: _Open) -> None:
        self.stack.append(element)
        self.opened[element.name] += 1
        self.at = element

    def pop(self) -> str:
        name = self.stack.pop().name
        self.opened[name] -= 1
        self.at = self.stack[-1] if self.stack else _Open("", _ROOT, 0, -1)
        return name

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag not in INLINE:
            self.flush()
            if tag in OPTIONAL_END and self.opened[tag]:
                self.close_open(tag)
            if self.at.name == "p":
                self.pop()
        named = dict(attrs)
        marks = f"{named.get('class') or ''} {named.get('id') or ''}"
        mark = _MARK.search(marks) if tag not in ("html", "body", "main", "article") or "comment" in marks.lower() else None
        layout_name = bool(mark and _LAYOUT.search(mark.group()))
        boilerplate = tag in SKIPPED or tag in BOILERPLATE or (named.get("role") or "").lower() in ROLES or "hidden" in named or (mark and not layout_name)
        out, layout = self.at.out, self.at.layout
        if tag in SEMANTIC and out < 2:  # an article ends what a layout name left out
            out, layout = 0, -1
        if boilerplate:
            out = 2
        elif layout_name and tag in INLINE:
            out = max(out, 1)
        elif layout_name:  # decided when all lines are known
            self.outer.append(layout)
            layout = len(self.outer) - 1
        node = self.at.node
        if tag in CONTAINERS:
            self.parent.append(node)
            self.kind.append(tag)
            node = len(self.parent) - 1
        self.push(_Open(tag, node, out, layout))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML ignores the slash

    def close_open(self, tag: str) -> None:
        """An element whose end tag is optional ends where the next of its kind begins, up to the nearest container."""
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i].name
            if name == tag:
                while len(self.stack) > i:
                    self.pop()
                return
            if name not in INLINE and name != "p":
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        if tag not in INLINE:
            self.flush()
        if self.opened[tag]:
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.at.out:
            self.text.append(data)
            if not self.opened["a"]:
                self.free += len(data.strip())

    def parse_marked_section(self, i, report=1):
        """`<![...`: a bogus comment up to the next `>` or the page's end; the inherited method raises on most of them."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else len(self.rawdata)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolution with a Gaussian that is cut at three sigma; edges use what there is."""
    r = int(3 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[r : r + len(values)] / np.convolve(np.ones(len(values)), kernel)[r : r + len(values)]


def ratios(lines: list[Line]) -> np.ndarray:
    return np.array([x.free / max(1, x.tags) for x in lines], "f8")


def clusters(lines: list[Line]) -> np.ndarray:
    """Which lines lie in content clusters."""
    even = smooth(ratios(lines))
    return even >= CUT * even.std()


def _totals(weights: list[float], at: list[int], parent: list[int]) -> list[float]:
    """The weight of every subtree; parents have smaller numbers than their children."""
    total = [0.0] * len(parent)
    for weight, n in zip(weights, at, strict=True):
        if n >= 0:
            total[n] += weight
    for n in range(len(parent) - 1, -1, -1):
        if parent[n] >= 0:
            total[parent[n]] += total[n]
    return total


def _heaviest(total: list[float], parent: list[int]) -> dict[int, int]:
    """The child with the largest total of every node that has children; -1 is the parent of what has none."""
    best: dict[int, int] = {}
    for n in range(len(parent)):
        if (p := parent[n]) not in best or total[n] > total[best[p]]:
            best[p] = n
    return best


def admitted(lines: list[Line], outer: list[int]) -> list[Line]:
    """The lines outside elements with layout names. Such an element that holds most of the page's cluster text counts as unnamed, and so does one inside it."""
    if not outer or not lines:
        return lines
    weights = [len(x.text) if high else 0.0 for x, high in zip(lines, clusters(lines), strict=True)]
    total, enough, free, n = _totals(weights, [x.layout for x in lines], outer), MAJORITY * sum(weights), {-1}, -1
    best = _heaviest(total, outer)
    while (n := best.get(n, -1)) >= 0 and total[n] >= enough:
        free.add(n)
    return [x for x in lines if x.layout in free]


def content(lines: list[Line], parent: list[int], kind: list[str]) -> list[str]:
    """The blocks that the clusters choose, in page order.

    An article or main element that wins the vote is the article as a whole. Of another container its cluster lines
    stay, and lines outside clusters that aren't mostly links (short paragraphs, headings); so do cluster lines outside it.
    """
    if not lines:
        return []
    above = clusters(lines)
    semantic = [False] * len(parent)
    for n in range(1, len(parent)):
        semantic[n] = kind[n] in SEMANTIC or semantic[parent[n]]
    weights = [len(x.text) * (PRIOR if semantic[x.node] else 1.0) if high else 0.0 for x, high in zip(lines, above, strict=True)]
    total = _totals(weights, [x.node for x in lines], parent)
    own = _totals([1] * len(lines), [x.node for x in lines], parent)
    best, chosen = _heaviest(total, parent), _ROOT
    while kind[chosen] not in SEMANTIC:
        n = best.get(chosen, -1)
        if n < 0 or total[n] < MAJORITY * total[chosen] or (own[n] < 2 and kind[n] not in SEMANTIC):
            break
        chosen = n
    inside = [False] * len(parent)
    inside[chosen] = True
    for n in range(chosen + 1, len(parent)):
        inside[n] = inside[parent[n]]
    if kind[chosen] in SEMANTIC:
        return [x.text for x in lines if inside[x.node]]
    return [x.text for x, high in zip(lines, above, strict=True) if high and x.free or inside[x.node] and 2 * x.free >= len(x.text)]


def extract(html: str | None) -> str:
    """The main text of a page, blocks joined by one line feed; null, empty and textless pages give an empty text.

    Any page is read, however malformed, in time linear in its length.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(_LONG_REFERENCE.sub("�", html))
    parser.close()
    parser.flush()
    return "\n".join(content(admitted(parser.lines, parser.outer), parser.parent, parser.kind))


def extract_pages(pages: DataFrame, keep: list[str] | None = None, html_col: str = "html") -> DataFrame:
    """pages (or its columns in `keep`) with main_text; one row per input row, whole pages of any length, no cap.

    A page's text depends on its html alone, so repeated rows get equal texts and the order of rows doesn't matter; of
    containers with equal votes the first on the page is chosen. A null html gives an empty text. An input column named
    main_text is replaced, others are kept whatever their name. An empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def main_text(html: pd.Series) -> pd.Series:
        return pd.Series([extract(h) for h in html], dtype=object)

    kept = [c for c in only(pages, keep) if c.lower() != "main_text"]
    return pages.select(*[F.col(f"`{c}`") for c in kept], main_text(F.col(html_col)).alias("main_text"))


def op10_html_extraction(spark, sf_dir):
    out = extract_pages(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE_SQL: dict[str, str] = {}
