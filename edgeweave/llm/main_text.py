"""HTML extraction (operator 4): text-to-tag ratios of lines from a streaming parser.

The standard library's parser gives events; text between two block-level tags is a line, with the number of tags
in it.  A line's ratio of characters to tags is smoothed over its neighbours with a Gaussian; lines over the
standard deviation of the smoothed ratios form the content clusters (Weninger et al., 2010).  The element that
holds the clusters' text is the content region: the main elements, or the articles, with some of it, else the
innermost element around all of it, with the headings before it.  The text goes from the region's first cluster to its
last, and on at both ends as long as lines have LOW of the threshold at least; so short paragraphs stay, and what is
all tags and hardly a letter does not.  Tags, roles, classes and ids correct this: lines in menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, hidden elements and reader comments are left out; a form or a name
does not leave out what holds the article, nor all there is.

Defined cases: null and empty html give an empty text; character references are decoded; white space in a block is
one space; unclosed and wrongly closed tags end with the element around them; a declaration that HTML does not know is
a comment; where the parser gives up, what it read until then counts; a page without any cluster gives the lines of
its article or main element, or all that are not named as above; ties (a line right at the threshold) are in; whole
pages are read, in time that does not depend on how deep elements are nested; repeated rows each get their row;
further columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeweave.llm.common import bounded, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold article text, wherever they stand.
NEVER = frozenset(
    "applet area aside audio button canvas datalist dialog embed footer frame frameset head iframe input link map menu meta nav noframes noscript "
    "object option script select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of classes and ids that name what is not the article.
NAMES = frozenset(
    "ad ads advert advertisement advertisements advertising adverts alert banner banners breadcrumb breadcrumbs captcha comment commentlist comments consent "
    "cookie cookies disqus feedback footer form gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager "
    "pagination paywall popup promo promotion promotions recommended related replies respond search share sharing sidebar sidebars signup skyscraper social "
    "sponsor sponsored sponsors subscribe subscription toolbar topbar tracking widget widgets".split()
)
#: What follows one of these in a name is not what the element is.
MODIFIERS = frozenset(["has", "no", "with", "without"])
#: These count as whole names only.
ALONE = frozenset(["widget", "widgets"])
#: In an article, these name parts of it.
SECTIONS = frozenset(["alert", "notice", "notices"])
#: Named so outside an article only: an article's own header holds its heading.
HEADERS = frozenset(["header", "headers"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(["html", "body", "article", "main"])
#: Too small to be the content region.
PARTS = HEADINGS | frozenset("p li dt dd blockquote pre td th tr caption figcaption".split())
#: What a start tag closes if it is open in the same element.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("html body article main section div table ul ol dl td th blockquote aside nav header footer form".split())
SIGMA = 1.0
#: At the ends of the region a line is in if its smoothed ratio is over so much of the bar.
LOW = 0.01
_WORDS = re.compile(r"[^a-z0-9]+")


def named_away(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if tag in WHOLE and not (tag == "article" and inside):
        return False
    if "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
        return True
    if (attrs.get("role") or "").strip().lower() in ROLES:
        return True
    return False


def marked(tag: str, attrs: dict[str, str | None], inside: bool) -> bool:
    """Whether a form or a word of a class or id marks the element, which ``held`` may overrule."""
    if tag == "form":
        return True
    if tag in WHOLE and not (tag == "article" and inside):
        return False
    names = NAMES - SECTIONS if inside else NAMES | HEADERS
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w for w in _WORDS.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), len(words))]
        if any(w in names and not (w in ALONE and len(words) > 1) and not (w == "related" and words[i + 1 : i + 2] in (["work"], ["works"])) for i, w in enumerate(words)):
            return True
    return False


class Page(HTMLParser):
    """The page's elements, numbered from 1 in their order (0 is around all), and its lines.

    Elements know what is around them, so a line needs its own element only, however deep it stands.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.end = [""], [0], [0]
        #: Whether named away by itself or around; whether by one that stands inside a line.
        self.away, self.mute = [False], [False]
        #: The next element around, or the element itself, that is marked; a block; article or main. 0: none.
        self.mark, self.block, self.whole = [0], [0], [0]
        self.stack, self.open = [0], Counter()
        self.lines: list[Line] = []
        self.text: list[tuple[str, int]] = []
        self.tags = 0

    def end_line(self) -> None:
        if any(not text.isspace() for text, _ in self.text):
            at = self.stack[-1]
            self.lines.append(Line(self.text, self.tags, self.block[at], self.away[at]))
            self.tags = 0
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        if tag == "br":
            self.text.append((" ", self.mark[self.stack[-1]]))
        if tag in VOID:
            return
        for open_tag in CLOSES.get(tag, "").split():
            self.shut(open_tag, within=True)
        if tag in BLOCK and tag not in ("p", "head", "html", "body"):
            self.shut("p", within=True)
        around, n = self.stack[-1], len(self.tag)
        away, mark = self.away[around], self.mark[around]
        if not away:
            inside = self.whole[around] > 0
            away = named_away(tag, dict(attrs), inside)
            if not away and marked(tag, dict(attrs), inside):
                mark = n
        self.tag.append(tag)
        self.parent.append(around)
        self.end.append(0)
        self.away.append(away)
        self.mute.append(self.mute[around] or (away and not self.away[around] and tag not in BLOCK))
        self.mark.append(mark)
        self.block.append(n if tag in BLOCK else self.block[around])
        self.whole.append(n if tag in ("article", "main") else self.whole[around])
        self.stack.append(n)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # as in HTML, where the slash means nothing

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        self.tags += 1
        self.shut(tag)

    def shut(self, tag: str, within: bool = False) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            here = self.tag[self.stack[i]]
            if here == tag:
                for n in self.stack[i:]:
                    self.end[n] = len(self.tag) - 1
                    self.open[self.tag[n]] -= 1
                del self.stack[i:]
                return
            if within and here in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        if not self.mute[self.stack[-1]]:
            self.text.append((data, self.mark[self.stack[-1]]))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A declaration that HTML does not know is a comment up to the next ``>``."""
        return self.parse_bogus_comment(i)

    def read(self, html: str) -> None:
        try:
            self.feed(html)
            self.close()
        except (AssertionError, ValueError):  # the parser gives up: what was read until then counts
            pass
        self.end_line()
        for n in self.stack:
            self.end[n] = len(self.tag) - 1

    def holds(self, element: int, node: int) -> bool:
        return element <= node <= self.end[element]

    def outer(self, kind: list[int], n: int) -> int:
        """The next element of the kind (mark, block or whole) around element n."""
        return kind[self.parent[n]] if n else 0

    def chain(self, kind: list[int], starts: set[int]) -> set[int]:
        """The elements of the kind in ``starts`` and all around them."""
        out: set[int] = set()
        for n in starts:
            while n and n not in out:
                out.add(n)
                n = self.outer(kind, n)
        return out

    def around(self, nodes: list[int]) -> int:
        """The lowest block that holds all of the blocks."""
        at, last = min(nodes), max(nodes)
        while not self.holds(at, last):
            at = self.outer(self.block, at)
        return at


@dataclass
class Line:
    pieces: list[tuple[str, int]]  # text and the mark on it
    tags: int
    block: int
    away: bool

    def joined(self, left_out: frozenset[int] | set[int] = frozenset()) -> str:
        """The text without the pieces whose mark is left out."""
        return " ".join("".join(text for text, mark in self.pieces if mark not in left_out).split())


def left_out(page: Page, content: np.ndarray) -> set[int]:
    """The marks that leave their text out, by themselves or by one around them.

    None does that holds main, or the page's articles, or outside an article 3/4 of the clusters' characters; and if
    but headings were left, those with 3/4 of the characters don't, or else none.
    """
    lines = [(line, yes) for line, yes in zip(page.lines, content, strict=True) if not line.away]
    if not any(yes for _, yes in lines):
        lines = [(line, True) for line, _ in lines]
    marks = page.chain(page.mark, {m for line, _ in lines for _, m in line.pieces})
    size, total = dict.fromkeys(marks, 0), 0
    for line, yes in lines:
        for text, mark in line.pieces if yes else ():
            n = len(" ".join(text.split()))
            total += n
            if mark:
                size[mark] += n
    for m in sorted(marks, reverse=True):
        if up := page.outer(page.mark, m):
            size[up] += size[m]
    wholes = page.chain(page.whole, {page.whole[line.block] for line, _ in lines})
    above = {w: page.outer(page.mark, w) for w in wholes}
    mains = page.chain(page.mark, {m for w, m in above.items() if page.tag[w] == "main"})
    articles = page.chain(page.mark, {m for w, m in above.items() if page.tag[w] == "article"})
    free = any(not m for m in above.values())
    free_article = any(not m and page.tag[w] == "article" for w, m in above.items())
    inner = {m for m in marks if page.outer(page.whole, m)}
    large = {m for m in marks if 4 * size[m] >= 3 * total}
    stays = mains | {m for m in articles if not free_article and (m not in inner or m in large)} | {m for m in large if m not in inner and not free}
    for more in (set(), large, marks):
        out: set[int] = set()
        for m in sorted(marks):
            if m not in stays | more or page.outer(page.mark, m) in out:
                out.add(m)
        if any(line.joined(out) and page.tag[line.block] not in HEADINGS for line, _ in lines):
            return out
    return set()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def region(page: Page, kept: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which lines the content region has, whether kept or not.

    It is the main elements with chosen lines; without such, the articles with some; else the lowest element around
    all chosen lines.  The headings right before it belong to it, and those between and before articles too.
    """
    lines = page.lines
    blocks = [line.block for line, yes in zip(lines, chosen & kept, strict=True) if yes]
    if not blocks:
        return np.ones(len(lines), dtype=bool)
    every = page.chain(page.whole, {page.whole[n] for n in blocks})
    wholes = {w for w in every if page.tag[w] == "main"} or every
    within = lambda box: np.array([page.holds(box, line.block) for line in lines])
    if wholes:
        outermost: list[int] = []
        for w in sorted(wholes):
            if not outermost or not page.holds(outermost[-1], w):
                outermost.append(w)
        starts, ends = np.array(outermost), np.array([page.end[w] for w in outermost])
        at = np.array([line.block for line in lines])
        own = np.searchsorted(starts, at, side="right") - 1
        inside = (own >= 0) & (at <= ends[np.maximum(own, 0)])
        box = page.around([page.outer(page.block, w) for w in outermost])
    else:
        box = page.around(blocks)
        # Of a paragraph, heading, item or cell, the element around it.
        while page.tag[box] in PARTS:
            box = page.outer(page.block, box)
        inside = within(box)
        box = page.outer(page.block, box)
    near = within(box)
    first, last = np.flatnonzero(inside)[[0, -1]]
    # From the first line of the region back: headings, and what stands between them and the region in the same element.
    heads = np.array([page.tag[line.block] in HEADINGS for line in lines]) & near & ~inside & kept
    heads[last:] = False
    before = np.flatnonzero(heads[:first])
    if len(before) and page.tag[box] not in ("", "html", "body"):
        inside[before[0] : first] |= near[before[0] : first]
    elif len(before):
        at = first
        while at > 0 and (not kept[at - 1] or heads[at - 1]):
            at -= 1
            inside[at] = True
    inside[first:] |= heads[first:]
    return inside


def reached(smooth: np.ndarray, bar: float, lines: np.ndarray) -> np.ndarray:
    """Of the region's lines, those from its first cluster to its last, and around these what is over LOW of the bar."""
    strong = np.flatnonzero(smooth[lines] >= bar)
    if not len(strong):
        return lines
    first, last, weak = strong[0], strong[-1], smooth[lines] >= LOW * bar
    while first > 0 and weak[first - 1]:
        first -= 1
    while last + 1 < len(lines) and weak[last + 1]:
        last += 1
    return lines[first : last + 1]


def main_text(html: str | None) -> str:
    page = Page()
    page.read(html or "")
    if not page.lines:
        return ""
    smooth = smoothed(np.array([len(line.joined()) / max(1, line.tags) for line in page.lines]))
    bar = smooth.std()
    content = smooth >= bar
    out = left_out(page, content)
    texts = [line.joined(out) for line in page.lines]
    kept = np.array([bool(text) and not line.away for text, line in zip(texts, page.lines, strict=True)])
    if not (content & kept).any():
        content = kept
    inside = np.flatnonzero(region(page, kept, content) & kept)
    heads = [i for i in inside if page.tag[page.lines[i].block] in HEADINGS]
    return "\n".join(texts[i] for i in sorted({*reached(smooth, bar, inside), *heads}))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page; see op4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return bounded(pages).select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
