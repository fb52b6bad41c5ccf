"""Main text of web pages (operator 2).

The page is read as a stream of parser events, once. Text gathers into blocks,
the lines of the method; each remembers the tags since the block before, so a
line's text-to-tag ratio is its characters per tag. The logarithms of the ratios are
smoothed with a Gaussian kernel over neighbouring lines and split into two clusters at the
threshold that sets them furthest apart (the greatest variance between them). The content region is
the innermost element with two thirds of the upper cluster's characters. It widens to
its parent while what that adds is upper cluster too, to the article
or main element around it, and to the page's only `h1`. All lines of the region are text, short ones
too, but for menus: elements of lower-cluster lines that are mostly links, outside any article.

Before that goes what the markup says outright: elements and roles of menus, page headers, footers,
sidebars, notices, forms, scripts and styles, and elements whose class or id names such
a part, adverts or reader comments outright (`sidebar`, `cookie-notice`, `ad-slot`). Such a name never drops
what holds the `main` element or most of the page's characters. A name that only contains such a word
(`entry-header`, `with-sidebar`, `related-work`) drops an element that lies in the lower cluster altogether, and no heading.
Marks of an article raise the ratio of lines inside by half and don't decide by themselves.

Defined results. A null or empty page gives an empty text. Unclosed and
misnested tags close with the element around them. A page without lines
gives an empty text. Repeated rows are judged one by one; other columns are not
looked at.

Scale: one pass, a page at a time, no shuffle; time is in proportion to the page, however deep it nests.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

# Elements by kind.
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option optgroup p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("aside button datalist dialog footer form head iframe menu nav noframes noscript search select script style template textarea title".split())
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a region can be.
_REGIONS = _BLOCKS - _HEADINGS - {"p", "pre", "hr", "li", "dt", "dd", "summary", "figcaption", "legend", "address", "option", "tr", "thead", "tbody", "tfoot"}
# Words of classes and ids; those that name a part, reader comments, and those that only say which or where.
_PARTS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising alert alerts aside banner banners breadcrumb breadcrumbs cookie cookies consent footer footers form forms gdpr header headers login masthead menu menus modal nav navbar
    navigation newsletter notice notices popup popups promo promos promotion related share sharing sidebar sidebars signup social sponsor sponsored subscribe toolbar widget widgets""".split()
)
_COMMENTS = frozenset("comment comments commentlist discussion disqus replies respond".split())
_NEUTRAL = frozenset("area bar block body bottom box container content global inner item items left link links list main outer page primary right secondary section site slot text top unit wrap wrapper".split())
_WORDS = re.compile(r"[a-z]+|\d+")
#: A `p` ends when one of these begins; so do items of lists and tables with their own kind.
_ENDS_P = _BLOCKS - {"html", "body", "head", "title", "option", "optgroup", "legend"}
_OWN_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: No implied end reaches beyond these.
_WALLS = frozenset("table ul ol dl article main section div aside nav footer header form blockquote body".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")

SIGMA = 1.0
#: Factor to the ratio of lines in article or main; share of the upper cluster that makes a region; what a wider
#: element must add to it, and how much of that must be upper cluster; links that make a menu.
RAISED, SHARE, ADDED, PURE, LINKED = 1.5, 2 / 3, 0.15, 0.8, 0.5
WEAK, STRONG, COMMENT = 1, 2, 3


def named(value: str) -> int:
    """What a class or id says of its element."""
    found = 0
    for token in value.lower().split():
        words = _WORDS.findall(token)
        parts, comments = sum(w in _PARTS for w in words), sum(w in _COMMENTS for w in words)
        if parts or comments:
            outright = all(w in _PARTS or w in _COMMENTS or w in _NEUTRAL or w.isdigit() for w in words)
            found = max(found, WEAK if not outright else COMMENT if comments else STRONG)
    return found


class Page(HTMLParser):
    """Parser events to lines and the block elements that they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # block elements: tag, parent, what the class or id says
        self.tag, self.parent, self.mark = ["html"], [-1], [0]
        self.open: list[tuple[str, int, bool]] = []  # tag, element around it, dropped
        self.where: dict[str, list[int]] = {}  # places of open tags
        self.walls: list[int] = []
        self.node = self.dropped = self.links = self.article = 0
        self.text: list[str] = []
        self.tags = self.linked = 0
        # lines: text, tags, element, characters of links, inside an article
        self.lines: list[tuple[str, int, int, int, bool]] = []

    def _end_line(self) -> None:
        if self.text:
            line = _SPACE.sub(" ", "".join(self.text)).strip()
            self.text = []
            if line:
                self.lines.append((line, self.tags, self.node, self.linked, self.article > 0))
                self.tags = 0
            self.linked = 0

    def _close(self, i: int) -> None:
        """Close the open elements from place i on."""
        while len(self.open) > i:
            if self.open[-1][0] in _BLOCKS:
                self._end_line()
            tag, self.node, dropped = self.open.pop()
            self.where[tag].pop()
            if tag in _WALLS:
                self.walls.pop()
            self.dropped -= dropped
            self.links -= tag == "a"
            self.article -= tag in ("article", "main")

    def _last(self, tag: str) -> int:
        places = self.where.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in _BLOCKS
        if block:
            self._end_line()
        if not self.dropped:
            self.tags += 1
        if tag == "br" and not self.dropped:
            self.text.append(" ")
        if tag in _VOID:
            return
        ends = _OWN_KIND.get(tag, ())
        if tag in _ENDS_P:
            ends = (*ends, "p")
        if ends:
            # the outermost of its kind within the innermost wall: a cell may be open inside the row that ends
            wall, at = self.walls[-1] if self.walls else -1, [p for p in map(self._last, ends) if p >= 0]
            at = [p for p in at if p > wall]
            if at:
                self._close(min(at))
        says = {k: v or "" for k, v in attrs}
        dropped = tag in _DROPPED or (tag == "header" and not self.article) or says.get("role") in _ROLES or "hidden" in says or says.get("aria-hidden") == "true" or ("style" in says and _UNSEEN.search(says["style"]) is not None)
        mark = 0 if tag in ("html", "body", "main") or tag in _HEADINGS else max(named(says.get("class", "")), named(says.get("id", "")))
        if not block and mark >= STRONG:  # part of a line
            dropped = True
        if tag == "p":  # says less than it would of a part of the page
            mark = min(mark, WEAK)
        if tag in _WALLS:
            self.walls.append(len(self.open))
        self.where.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, self.node, dropped))
        self.dropped += dropped
        self.links += tag == "a"
        self.article += tag in ("article", "main")
        if block and not self.dropped:
            self.tag.append(tag)
            self.parent.append(self.node)
            self.mark.append(mark)
            self.node = len(self.tag) - 1

    def handle_endtag(self, tag: str) -> None:
        if not self.dropped:
            self.tags += 1
        if tag in _BLOCKS:
            self._end_line()
        i = self._last(tag)
        if i >= 0:
            self._close(i)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
            if self.links:
                self.linked += len(data.strip())

    def finish(self) -> Page:
        self.close()
        self._end_line()
        return self


def smooth(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at the ends."""
    radius = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel, "full")[radius:-radius] / np.convolve(np.ones(len(ratios)), kernel, "full")[radius:-radius]


def threshold(values: np.ndarray) -> float:
    """The least value of the upper of two clusters, split where the variance between them is greatest."""
    x = np.sort(values)
    n = np.arange(1, len(x))
    sums = np.cumsum(x)
    low, high = sums[:-1] / n, (sums[-1] - sums[:-1]) / (len(x) - n)
    between = np.where(x[1:] > x[:-1], np.round(n * (len(x) - n) * (high - low) ** 2, 6), -1.0)
    if not len(between) or between.max() <= 0:
        return float(x[0])
    return float(x[1:][int(np.argmax(between))])


def _sums(page: Page, per_line: np.ndarray) -> np.ndarray:
    """What each element and all inside it hold; parents come before their children."""
    total = np.zeros(len(page.tag), np.int64)
    np.add.at(total, [line[2] for line in page.lines], per_line)
    held, parent = total.tolist(), page.parent
    for k in range(len(held) - 1, 0, -1):
        held[parent[k]] += held[k]
    return held


def _inherited(page: Page, own: list[bool]) -> list[bool]:
    """Own, or that of an element around it."""
    out = list(own)
    for k in range(1, len(out)):
        out[k] = out[k] or out[page.parent[k]]
    return out


def content_lines(page: Page, *, sigma: float = SIGMA) -> list[int]:
    """Lines of content, by ratio, smoothing and clusters."""
    lines, tag, parent, mark = page.lines, page.tag, page.parent, page.mark
    if not lines:
        return []
    nodes = range(len(tag))
    chars = np.array([len(line[0]) for line in lines], np.int64)
    held = _sums(page, chars)
    # what is named outright goes, but no wrapper of the page's text
    comments = _inherited(page, [m == COMMENT for m in mark])
    marked = [int(tag[k] == "main" or (tag[k] == "article" and not comments[k])) for k in nodes]
    if not any(marked):
        marked = [int(t == "h1") for t in tag]
    mains = [int(t == "main") for t in tag]
    for k in range(len(tag) - 1, 0, -1):
        marked[parent[k]] += marked[k]
        mains[parent[k]] += mains[k]
    comments = _inherited(page, [mark[k] == COMMENT and not mains[k] for k in nodes])
    others = sum(int(c) for c, line in zip(chars, lines, strict=True) if not comments[line[2]])
    wraps = [mains[k] > 0 or (mark[k] != COMMENT and 2 * held[k] > others and marked[k] == marked[0]) for k in nodes]
    gone = _inherited(page, [mark[k] >= STRONG and not wraps[k] for k in nodes])
    left = [i for i, line in enumerate(lines) if not gone[line[2]]]
    if not left:
        return []
    ratios = np.array([len(lines[i][0]) / max(1, lines[i][1]) * (RAISED if lines[i][4] else 1.0) for i in left])
    smoothed = np.round(smooth(np.log1p(ratios), sigma), 9)  # so that equal ratios stay equal
    upper = np.zeros(len(lines), bool)
    upper[left] = smoothed >= threshold(smoothed)
    # names that only contain such a word: elements that lie in the lower cluster altogether
    high, rest = _sums(page, chars * upper), _sums(page, chars * np.isin(np.arange(len(lines)), left))
    weak = _inherited(page, [mark[k] == WEAK and not high[k] and rest[k] > 0 and not mains[k] for k in nodes])
    # the region: innermost with its share, then wider
    root = 0
    for k in nodes[1:]:
        if tag[k] in _REGIONS and high[k] >= SHARE * high[0]:
            root = k  # of two that hold two thirds one is inside the other, and comes later
    while parent[root] >= 0:
        up = parent[root]
        more, added = high[up] - high[root], rest[up] - rest[root]
        if added and not (more >= ADDED * high[root] and more >= PURE * added):
            break
        root = up
    for wide in ("article", "main"):
        k, found = root, -1
        while k >= 0:
            found = k if tag[k] == wide else found
            k = parent[k]
        if found >= 0:
            root = found
            break
    inside = _inherited(page, [k == root for k in nodes])
    # menus: lower-cluster elements of links, outside articles
    linked, in_article = _sums(page, np.array([line[3] for line in lines], np.int64)), _inherited(page, [t in ("article", "main") for t in tag])
    menus = _inherited(page, [k != root and tag[k] in ("ul", "ol", "dl", "div", "table", "section", "p") and not in_article[k] and not high[k] and linked[k] > LINKED * rest[k] for k in nodes])
    heads = [i for i in left if tag[lines[i][2]] == "h1"]
    kept = {i for i in left if inside[lines[i][2]] and not menus[lines[i][2]] and (not weak[lines[i][2]] or tag[lines[i][2]] in _HEADINGS)}
    return sorted(kept | set(heads if len(heads) == 1 else ()))


def main_text(html: str | None, *, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    page = Page()
    page.feed(html)
    page.finish()
    return "\n".join(page.lines[i][0] for i in content_lines(page, sigma=sigma))


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id_col, the kept columns, text and n_chars (code points) for each page."""
    kept = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept)
    return arrow_map(pages.select(*kept, F.col(html_col).cast("string").alias("__html")), run, f"{kinds}, text string, n_chars long")
