"""Operator 8: the main text of web pages by smoothed text-to-tag ratios.

The standard library's parser streams events; text between block boundaries makes a line, with the
tags met in it. The ratio of text to tags of each line is smoothed by a Gaussian over its
neighbours, and lines from a threshold on, SPREAD standard deviations of the smoothed ratios, cluster
as content. The content region is the deepest container that holds MOST of their text; it grows
to the container around it as long as that adds headings and content alone. Whatever their ratio, all lines
of the region are returned; where only the page itself holds the content, they reach from the first to
the last line of content. No element is taken for the article by its name.

Elements, roles and class names only veto: what they surely name (menus, forms, adverts, comments) goes,
and what they may name (WEAK, as a box of tags) goes if its own ratio is below the
threshold. A line that is mostly links goes if its smoothed ratio is below it.

Defined cases: a null or empty page, and one without any content, gives an empty text; unclosed and
stray tags are borne; a tag that the page's end cuts off is dropped, as browsers do, a page cut off in its
midst gives what it has; repeated rows give repeated results; other columns stay out of the result.
Empty in, empty out. Elements of any depth are tracked, in time linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridtally.llm.texts import releasing, text_slices

SLICE_CHARS, REACH, SPREAD, MOST, LINKS = 4_000_000, 2, 0.5, 0.55, 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Blocks that can be the content region.
CONTAINERS = frozenset("article center details div main section table tbody td tr".split())
CLOSES_P = BLOCKS - {"body", "html", "title", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
DROPPED = frozenset("aside button canvas dialog fieldset footer form head iframe input label menu nav noscript object search select style script svg template textarea title".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of a class, id or role that tell of anything but the article, and those that may.
STRONG = frozenset("ad ads advert advertisement advertising adverts breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus disclaimer footer gdpr masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related replies respond share sharing sidebar signup sponsor sponsored sponsors subscribe widget widgets".split())
WEAK = frozenset("banner caption form header login reply search skip social tags toc toolbar".split())
#: Words that name a box or its place: what stands before them says what the box holds.
BOXES = WEAK | frozenset("area articles bar block body bottom box button buttons card cards col column container content entry feed grid group head holder icons inner item items label left link links list main module outer overlay panel posts primary region right row secondary section slot stories tab text thread title toggle top unit wrap wrapper".split())
#: A class name with one of these says what stands beside the element, not what it is.
BESIDE = frozenset("has with no not without".split())
_SPACE = re.compile(r"\s+")
#: Where a tag begins.
_TAG = re.compile(r"<[a-zA-Z/!?]")
_TOKEN = re.compile(r"[^a-z0-9]+")

#: A line of an article's header goes too, but for the headings in it.
KEEP, MAYBE, HEADER, DROP = range(4)


class Line(NamedTuple):
    text: str
    tags: int
    veto: int
    container: int
    heading: bool
    linked: int  # characters in links


class Element(NamedTuple):
    tag: str
    veto: int
    container: int
    link: bool


def marks(attrs: list) -> int:
    """What the class, id and role of an element say of it."""
    worst = KEEP
    for name, value in attrs:
        if name == "hidden":
            return DROP
        if value and name in ("class", "id", "role"):
            for word in value.lower().split():
                tokens = _TOKEN.split(word)
                if BESIDE.isdisjoint(tokens):
                    # a compound is what its last word says, boxes aside: a cookie-notice is a notice, a notice-period none
                    if next((t for t in reversed(tokens) if t and t not in BOXES and not t.isdigit()), "") in STRONG:
                        return DROP
                    if not WEAK.isdisjoint(tokens):
                        worst = MAYBE
    return worst


class Page(HTMLParser):
    """The lines of one page and the containers that they stand in; container 0 is the page itself.

    It is fed the whole page at once: a comment or section that nothing ends goes to the page's end, which is looked for but once.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents = [-1]
        self.open = [Element("", KEEP, 0, False)]
        self.blocks: Counter = Counter()  # open blocks by tag
        self.inner: list[tuple[str, Counter, int]] = [("", Counter(), KEEP)]  # each open block, the inline elements open right in it, its veto
        self.parts, self.tags, self.linked = [], 0, 0

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                top = self.open[-1]
                self.lines.append(Line(text, self.tags, top.veto, top.container, self.inner[-1][0] in HEADINGS, self.linked))
                self.tags = 0
            self.parts, self.linked = [], 0

    def skipped(self, start: int, end: str) -> int:
        """Where the text goes on behind the next end."""
        found = self.rawdata.find(end, start)
        return len(self.rawdata) if found < 0 else found + len(end)

    def parse_comment(self, i: int, report: int = 1) -> int:
        for short in (">", "->"):  # a comment that ends before it has begun
            if self.rawdata.startswith(short, i + 4):
                return i + 4 + len(short)
        return self.skipped(i + 4, "-->")

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.skipped(i + 3, "]]>" if self.rawdata.startswith("CDATA[", i + 3) else ">")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if (tag in CLOSES_P and self.inner[-1][0] == "p") or (tag == "li" and self.inner[-1][0] == "li"):
                self.close_block(self.inner[-1][0])
        elif tag in ("br", "img"):
            self.parts.append(" ")
        if tag in VOID:
            return
        top = self.open[-1]
        veto, container = top.veto, top.container
        if tag in DROPPED or (tag == "header" and not (self.blocks["article"] or self.blocks["main"] or self.blocks["section"])):
            veto = DROP
        elif tag == "header":
            veto = max(veto, HEADER)
        elif tag in HEADINGS and veto == HEADER:
            veto = KEEP  # an article's own title
        elif veto < DROP and attrs and tag not in ("html", "body"):
            veto = max(veto, marks(attrs))
        if tag in CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        self.open.append(Element(tag, veto, container, tag == "a" or (top.link and tag not in BLOCKS)))
        if tag in BLOCKS:
            self.blocks[tag] += 1
            self.inner.append((tag, Counter(), veto))
        else:
            self.inner[-1][1][tag] += 1

    def close_block(self, tag: str) -> None:
        """Ends the innermost open block of that tag and all that is open in it."""
        while True:
            name = self.open.pop().tag
            if name in BLOCKS:
                self.blocks[name] -= 1
                self.inner.pop()
                if name == tag:
                    return

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            if self.blocks[tag]:
                self.close_block(tag)
        elif (inline := self.inner[-1][1])[tag]:  # it ends nothing outside the block
            while True:
                name = self.open.pop().tag
                inline[name] -= 1
                if name == tag:
                    return

    def handle_data(self, data: str) -> None:
        if self.open[-1].veto == DROP and self.inner[-1][2] < DROP:  # a script, a style, an advert in the midst of a line
            return
        self.parts.append(data)
        if self.open[-1].link:
            self.linked += len(data)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    """Each ratio's Gaussian mean over REACH neighbours on either side; the ends are repeated."""
    weights = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / max(1, REACH / 2)) ** 2)
    return np.convolve(np.pad(ratio, REACH, mode="edge"), weights / weights.sum(), mode="valid")


def content_lines(lines: list[Line], parents: list[int], spread: float = SPREAD) -> list[str]:
    """The texts of the content region's lines, in page order."""
    if not lines:
        return []
    size = np.array([len(x.text) for x in lines])
    ratio = size / np.maximum(1, [x.tags for x in lines])
    smooth = smoothed(ratio)
    least = spread * smooth.std()
    high, own_high = smooth >= least, ratio >= least
    veto = np.array([x.veto for x in lines])
    links = np.array([x.linked for x in lines]) >= LINKS * size
    usable = ((veto == KEEP) | ((veto == MAYBE) & own_high)) & (~links | high)
    content = usable & high
    if not content.any():
        content = usable
    if not content.any():
        return []
    place = np.array([x.container for x in lines])
    heading = np.array([x.heading for x in lines])
    n = len(parents)
    held = np.bincount(place, size * content, minlength=n)
    foreign = np.bincount(place, usable & ~heading & ~(content & own_high), minlength=n)
    for c in range(n - 1, 0, -1):  # children come after their parents
        held[parents[c]] += held[c]
        foreign[parents[c]] += foreign[c]
    region = int(np.flatnonzero(held >= MOST * held[0])[-1])  # those that hold most lie on one path
    while region and parents[region] and foreign[parents[region]] == foreign[region]:
        region = parents[region]
    inside = np.zeros(n, bool)
    inside[region] = True
    for c in range(region + 1, n):
        inside[c] |= inside[parents[c]]
    chosen = usable & inside[place]
    if not region:
        where = np.flatnonzero(content)
        first = where[0]
        while first and usable[first - 1] and heading[first - 1]:
            first -= 1
        with_content = np.zeros(n, bool)
        with_content[place[content]] = True
        with_content[0] = False
        at = np.arange(len(lines))
        chosen &= ((at >= first) & (at <= where[-1])) | with_content[place]
    return [x.text for x, c in zip(lines, chosen.tolist()) if c]


def main_text(html: str) -> str:
    page = Page()
    cut = _TAG.search(html, html.rfind(">") + 1)  # nothing ends what begins behind the last >
    page.feed(html[: cut.start()] if cut else html)
    page.close()
    page.flush()
    return "\n\n".join(content_lines(page.lines, page.parents))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row."""

    def run(batches):
        for batch in batches:
            for part, htmls in text_slices(batch, "html", SLICE_CHARS):
                texts = [main_text(h) if h else "" for h in htmls]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(releasing(run), f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long")
