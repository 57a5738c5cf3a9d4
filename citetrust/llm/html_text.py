"""The main text of web pages, from parser events and the ratio of text to tags."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citetrust.llm.work import by_slices

SIGMA = 1.5  # of the Gaussian, in lines
RADIUS = 4
SPREAD = 0.5  # a line is content if its smoothed ratio is over this many standard deviations of the page's ratios
SHARE = 0.25  # of a page's content that an article element has to hold to be taken for the article
DEPTH = 512  # elements nested deeper count as siblings, as in browsers
INNER = 0.6  # of an element's content that a child has to hold for the search to go on inside it

# Elements of HTML by their role, and words that authors give to parts that are not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table"
    " tbody td tfoot th thead title tr ul".split()
)
SILENT = set(
    "aside audio button canvas datalist dialog embed footer form head iframe input menu nav noscript object script search select"
    " style svg template textarea title video".split()
)
IN_HEAD = set("base link meta noscript script style template title".split())
PIECES = set("blockquote dl li ol table ul".split())  # parts of an article
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
PARTS = set(
    "ad ads adsbox adsense adv advert adverts advertisement advertisements advertising aside banner breadcrumb breadcrumbs"
    " colophon comment comments commentlist commentform consent cookie cookies copyright discussion disqus"
    " footer form gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay"
    " pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup"
    " skip social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets".split()
)
HEADER = {"header"}  # not part of the article, unless they stand inside it
NOT_ABOUT_ITSELF = {"has", "is", "no", "with", "without"}  # as in has-sidebar
CLOSES = {  # a start tag ends the open element on the left if one is found before those on the right
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dd": ({"dd", "dt"}, {"dl"}),
    "dt": ({"dd", "dt"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
MARKUP = re.compile(r"<(?=[A-Za-z/!?])")
WORD_EDGE = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])")


class Line(NamedTuple):
    text: str
    ratio: float  # characters outside of links for each tag
    place: int  # the element it stands in
    heading: str


class Open(NamedTuple):
    name: str
    silent: bool
    linked: bool
    place: int


class Lines(HTMLParser):
    """Lines of text in page order, without those in parts that are never the article, and the elements they stand in.

    A line ends where a block element begins or ends. An element's place is its number in ``parents`` and ``names``.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents, self.names = [0], ["html"]
        self.stack = [Open("", False, False, 0)]
        self.open: Counter[str] = Counter()
        self.words: list[str] = []
        self.tags = self.linked = 0
        self.heading = ""

    def _end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            ratio = max(len(text) - self.linked, 0) / max(self.tags, 1)
            self.lines.append(Line(text, ratio, self.stack[-1].place, self.heading))
        self.words, self.tags, self.linked, self.heading = [], 0, 0, ""

    def _pop(self, start: int, end: int | None = None) -> None:
        for gone in self.stack[start:end]:
            self.open[gone.name] -= 1
        del self.stack[start:end]

    def _close(self, names: set[str], before: set[str]) -> None:
        if not any(self.open[n] for n in names):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name in names:
                self._pop(k)
                return
            if self.stack[k].name in before:
                return

    def _inside(self) -> bool:
        return self.open["article"] + self.open["main"] > 0

    def _silent(self, tag: str, attributes: dict[str, str | None]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if tag in SILENT or "hidden" in attributes or attributes.get("aria-hidden") == "true":
            return True
        if attributes.get("role") in ROLES or HIDDEN.search(attributes.get("style") or ""):
            return True
        if tag == "header" and not self._inside():
            return True
        for name in f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split():
            words = [w.lower() for w in WORD_EDGE.split(name)]
            if words[0] in NOT_ABOUT_ITSELF:
                continue
            if not PARTS.isdisjoint(words) or (not HEADER.isdisjoint(words) and not self._inside()):
                return True
        return False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end_line()
            self._close({"p"}, {"table", "td", "th", "caption", "button"})
        if tag not in IN_HEAD:
            self._close({"head"}, {"body"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.words.append(" ")
            return
        above = self.stack[-1]
        if len(self.stack) == DEPTH:
            self._pop(DEPTH - 1)
        place = self.stack[-1].place
        if tag in BLOCK and tag != "p" and tag not in HEADINGS and not above.silent:
            self.parents.append(place)
            self.names.append(tag)
            place = len(self.names) - 1
        silent = above.silent or self._silent(tag, dict(attrs))
        self.open[tag] += 1
        self.stack.append(Open(tag, silent, above.linked or tag == "a", place))
        if tag in HEADINGS:
            self.heading = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self._end_line()
        self.tags += 1
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].name == tag:
                self._pop(k, None if tag in BLOCK else k + 1)
                return

    def handle_data(self, data: str) -> None:
        state = self.stack[-1]
        if not state.silent:
            self.words.append(data)
            if state.linked:
                self.linked += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        """Marked sections are markup, whatever they hold."""

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        end = super().parse_comment(i, report)
        return end if end >= 0 else len(self.rawdata)  # one without an end is all that is left

    @classmethod
    def of(cls, html: str) -> Lines:
        """Of a whole page. What begins like markup after the last ``>`` has no end, and is none of the text."""
        parser = cls()
        end = html.rfind(">") + 1
        parser.feed(html[:end])
        parser.close()
        parser.handle_data(unescape(MARKUP.split(html[end:], maxsplit=1)[0]))
        parser._end_line()
        return parser


def content(ratios: np.ndarray) -> np.ndarray:
    """Which lines are content: their ratios, smoothed by a Gaussian, are clustered by one threshold."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel)[RADIUS : RADIUS + len(ratios)]
    smooth = np.convolve(ratios, kernel)[RADIUS : RADIUS + len(ratios)] / weight
    return smooth > min(SPREAD * float(np.std(ratios)), float(np.max(smooth)) * 0.999)


def _sums(weight: np.ndarray, place: np.ndarray, parents: list[int]) -> np.ndarray:
    """What stands in each element and below; an element's number is larger than its parent's."""
    total = np.bincount(place, weight, len(parents))
    for k in range(len(parents) - 1, 0, -1):
        total[parents[k]] += total[k]
    return total


def _below(tops: set[int], parents: list[int]) -> np.ndarray:
    """Elements that are one of ``tops`` or stand in one."""
    inside = np.zeros(len(parents), bool)
    for k in range(len(parents)):
        inside[k] = k in tops or (k > 0 and inside[parents[k]])
    return inside


def main_text(html: str) -> str:
    """The article's blocks, joined by line breaks.

    Lines of the page get a ratio of text outside of links to tags; smoothing and one threshold tell content lines.
    The element that is named an article (or main) and holds most content is the article, with all its lines. On pages
    without one, the search goes down as long as one child holds most content and no main heading is lost, and lines
    from the first to the last content line there, with headings before, are the article, without those that
    are mostly links.
    """
    page = Lines.of(html)
    if not page.lines:
        return ""
    place = np.array([line.place for line in page.lines])
    size = np.array([len(line.text) for line in page.lines], float)
    chosen = content(np.array([line.ratio for line in page.lines]))
    if not chosen.any():
        chosen[:] = True
    mass = _sums(size * chosen, place, page.parents)
    for name in ("article", "main"):
        named = {k for k, n in enumerate(page.names) if n == name}
        under = _below(named, page.parents)
        outer = [k for k in named if not under[page.parents[k]]]
        best = max((mass[k] for k in outer), default=0)
        if best > 0 and best >= SHARE * mass[0]:
            inside = _below({k for k in outer if 2 * mass[k] >= best}, page.parents)
            return "\n".join(line.text for line in page.lines if inside[line.place])
    top = 0
    titles = _sums(np.array([line.heading == "h1" for line in page.lines], float), place, page.parents)
    heavy = {page.parents[k]: k for k in range(1, len(page.parents)) if mass[k] >= INNER * mass[page.parents[k]] > 0}
    while top in heavy and titles[heavy[top]] == titles[top] and page.names[heavy[top]] not in PIECES:
        top = heavy[top]
    inside = _below({top}, page.parents)[place]
    lines = [line for line, there in zip(page.lines, inside, strict=True) if there]
    there = np.flatnonzero(chosen[inside])
    first, last = int(there[0]), int(there[-1])
    while first > 0 and lines[first - 1].heading:
        first -= 1
    kept = [line for line in lines[first : last + 1] if line.heading or line.ratio > 0]
    return "\n".join(line.text for line in kept)


def _texts(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [main_text(html) if html else "" for html in batch.column("html").to_pylist()]
    made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), *made], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html), its main text and code points.

    White space inside a block (a line break element is white space too) is one space, blocks are joined by one ``\\n``,
    character references are decoded. A null or empty page, or one without text, has an empty text; null and
    repeated ids keep a row each; other columns are not read; no rows, no texts. Pages are read whole, one
    after the other, so a worker needs room for the lines of the longest one.
    """
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(by_slices("html", _texts), schema)
