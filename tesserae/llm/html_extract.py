"""Main text of web pages, from the standard library's parser events.

Blocks of text are measured by their ratio of text to tags. The ratios, smoothed by a Gaussian along the page, are weighed
up inside article and main elements, and down where tags, roles or names speak of menus, notices and other page
furniture; they fall into two clusters, of which the upper marks the page's content. The elements that hold it are the
regions of the text, and every block inside them stands, short ones too, but for those that are weighed down and not of the
upper cluster themselves. Only what no reader sees (scripts, styles, form fields, hidden elements) is left out by tag. Forms
stay where they hold content. Time and memory grow with the page's length, however deep its elements are, and whatever
it leaves unclosed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul caption".split()
)
#: No text of a page.
UNSEEN = frozenset(
    "button canvas datalist dialog embed head iframe input map math noembed noframes noscript object optgroup option script select style svg"
    " template textarea title video audio".split()
)
FURNITURE = frozenset("aside footer label menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words of class and id names.
NAMES = frozenset(
    "ad ads adbox adslot advert advertisement adverts advertising banner banners billboard breadcrumb breadcrumbs comment comments"
    " commentlist consent cookie cookies disqus discussion footer gdpr header login masthead menu menus modal nav navbar navigation"
    " newsletter notice notices notification overlay pagination pager popup promo promoted promotion recommended related replies reply"
    " respond search share sharing sidebar sidebars signup skyscraper social sponsor sponsored sponsors subscribe subscription toolbar"
    " topbar widget widgets".split()
)
#: Of these, words that parts of an article carry too; inside an article or main element they are only a doubt.
DOUBTFUL = frozenset(
    "banner banners consent discussion header login masthead modal notice notices notification overlay pager popup promo promoted"
    " promotion recommended related replies reply respond search share sharing signup social sponsor sponsored sponsors subscription"
    " toolbar topbar widget widgets".split()
)
#: A name hides none of these inside an article or main element.
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p".split())
INLINE = TEXTUAL | frozenset("a b blockquote dd dt em i li pre span strong td th tr".split())
#: After these, a name says what a page has or lacks.
WITHOUT = frozenset("no not has with without".split())
#: These hold an article's own header.
CONTENT = frozenset(("article", "main"))
_CLOSED_BY = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "td", "th")),
    "td": frozenset(("td", "th")),
    "th": frozenset(("td", "th")),
    "option": frozenset(("option",)),
}
_SCOPE = frozenset("ul ol dl table select article section div body main aside nav footer form".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    tag: str
    parent: int
    hidden: bool
    soft: bool = False  # furniture, by what its tag or name says
    doubt: int = 0  # outermost element with a doubtful name that holds it
    inside: bool = False  # of an article or main element, or one itself


@dataclass
class Block:
    element: int
    text: list[str] = field(default_factory=list)
    tags: int = 1
    linked: int = 0


def _named(term: str, names: frozenset[str]) -> bool:
    """Whether one class or id names furniture: ``left-sidebar`` does, ``no-sidebar`` does not."""
    words = [x.lower() for x in _NAME.findall(term)]
    return any(x in names and before not in WITHOUT for before, x in zip(["", *words], words, strict=False))


def is_unseen(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    if tag in UNSEEN:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value or "", re.I) for name, value in attributes)


def is_furniture(tag: str, attributes: list[tuple[str, str | None]], inside: bool) -> bool:
    """``inside``: of an article or main element."""
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        value = value or ""
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and not (inside and tag in TEXTUAL) and any(_named(x, NAMES - DOUBTFUL if inside else NAMES) for x in value.split()):
            return True
    return False


def is_doubtful(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a form, or what an article holds under such a name, is doubtful; its text decides. An article's own header
    is not."""
    if tag in TEXTUAL or tag in CONTENT:
        return False
    return any(name in ("class", "id") and any(_named(x, DOUBTFUL - {"header"}) for x in (value or "").split()) for name, value in attributes)


_BOUND = BLOCK | FURNITURE | UNSEEN
_CELLS = _SCOPE | frozenset(_CLOSED_BY)


class _Reader(HTMLParser):
    """Events to elements and blocks of text; what is hidden leaves no blocks.

    Beside the open elements stand the places of those among them that close others or bound a paragraph, so that a tag
    looks at a few of these, however many inline elements are open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", -1, False)]
        self.open = [0]
        self.bounds: list[int] = []
        self.cells: list[int] = []
        self.blocks: list[Block] = []
        self.counts: Counter[str] = Counter()
        self.fresh = True
        self.links = 0

    def _top(self) -> Element:
        return self.elements[self.open[-1]]

    def _pop(self) -> None:
        gone = self.elements[self.open.pop()]
        for places in (self.bounds, self.cells):
            if places and places[-1] == len(self.open):
                places.pop()
        self.counts[gone.tag] -= 1
        self.fresh |= gone.tag in BLOCK
        self.links -= gone.tag == "a"

    def _pop_to(self, place: int) -> None:
        while len(self.open) > place:
            self._pop()

    def _tag(self) -> None:
        if self.blocks and not self.fresh:
            self.blocks[-1].tags += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tag()
        if tag in BLOCK:
            self.fresh = True
            if self.bounds and self.elements[self.open[self.bounds[-1]]].tag == "p":
                self._pop_to(self.bounds[-1])
        elif tag in ("br", "td", "th", "img"):
            self._space()
        if tag in VOID:
            return
        if tag in _CLOSED_BY:
            k = len(self.cells)
            while k:  # of each kind one, at most, is open in a scope
                k -= 1
                name = self.elements[self.open[self.cells[k]]].tag
                if name in _CLOSED_BY[tag]:
                    self._pop_to(self.cells[k])
                elif name in _SCOPE:
                    break
        top = self._top()
        inside = top.inside
        hidden = top.hidden or is_unseen(tag, attrs)
        soft = top.soft or is_furniture(tag, attrs, inside)
        doubt = top.doubt or (len(self.elements) if not hidden and (tag == "form" or inside and is_doubtful(tag, attrs)) else 0)
        if tag in _BOUND:
            self.bounds.append(len(self.open))
        if tag in _CELLS:
            self.cells.append(len(self.open))
        self.elements.append(Element(tag, self.open[-1], hidden, soft, doubt, inside or tag in CONTENT))
        self.open.append(len(self.elements) - 1)
        self.counts[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._top().tag == tag and tag in ("svg", "math", "path", "use"):
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._tag()
        if self.counts[tag]:
            while self._top().tag != tag:
                self._pop()
            self._pop()
        if tag in BLOCK:
            self.fresh = True

    def _space(self) -> None:
        if self.blocks and not self.fresh:
            self.blocks[-1].text.append(" ")

    def handle_data(self, data: str) -> None:
        if self._top().hidden:
            return
        if self.fresh:
            if data.isspace():
                return
            self.blocks.append(Block(self.open[-1]))
            self.fresh = False
        self.blocks[-1].text.append(data)
        if self.links:
            self.blocks[-1].linked += len(data)


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, mirrored at the ends."""
    reach = min(len(values), math.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="symmetric"), weights / weights.sum(), "valid")


def two_means(values: np.ndarray) -> float:
    """The threshold between the means of two clusters of values; the least value if they are all alike."""
    low, high = float(values.min()), float(values.max())
    while True:
        upper = values >= (low + high) / 2
        if upper.all() or not upper.any():
            return float(values.min())
        means = float(values[~upper].mean()), float(values[upper].mean())
        if means == (low, high):
            return (low + high) / 2
        low, high = means


@dataclass(frozen=True)
class HtmlExtraction:
    """``sigma``: of the smoothing, in blocks; ``prior``: weight of the ratio inside article and main elements;
    ``doubt``: its weight in what speaks of furniture; ``threshold``: in units of that between the two clusters; ``share``: of
    the content, for a region of its own."""

    sigma: float = 1.5
    prior: float = 1.5
    doubt: float = 0.1
    threshold: float = 1.0
    share: float = 0.15

    def main_text(self, html: str | None) -> str:
        """Blocks of the main text, one a line; empty without any."""
        if not html:
            return ""
        reader = _Reader()
        reader.feed(html)
        reader.close()
        elements = reader.elements
        blocks = [(block, text) for block in reader.blocks if (text := " ".join("".join(block.text).split()))]
        if not blocks:
            return ""
        ratio = np.array([(len(text) - min(len(text), block.linked)) / block.tags for block, text in blocks])
        soft = np.array([elements[block.element].soft for block, _ in blocks])
        if soft.all():
            return ""
        weighed = np.where(soft, self.doubt, 1.0)  # before smoothing too, so that furniture lifts no neighbour
        score = smooth(ratio * weighed, self.sigma) * weighed * np.where([elements[block.element].inside for block, _ in blocks], self.prior, 1.0)
        content = score >= self.threshold * two_means(score)
        if not content[~soft].any():  # furniture alone is no page's text
            content = ~soft & (score >= two_means(score[~soft]))
        # what is doubtful stays if half of its text, at least, is content and not links
        total: dict[int, list[int]] = {}
        for (block, text), chosen in zip(blocks, content, strict=True):
            if doubt := elements[block.element].doubt:
                size = total.setdefault(doubt, [0, 0])
                size[0] += len(text)
                size[1] += len(text) * bool(chosen and block.linked <= 0.5 * len(text))
        gone = {k for k, (n, good) in total.items() if 2 * good < n}
        stay = [elements[block.element].doubt not in gone for block, _ in blocks]
        blocks, content, soft = [x for x, y in zip(blocks, stay, strict=True) if y], content[np.array(stay)], soft[np.array(stay)]
        if soft.all():
            return ""
        if not content.any():
            content = ~soft
        weight, filled = np.zeros(len(elements)), np.zeros(len(elements), bool)
        for (block, text), chosen in zip(blocks, content, strict=True):
            filled[block.element] |= chosen or not elements[block.element].soft
            if chosen:
                weight[block.element] += len(text)
        children: list[list[int]] = [[] for _ in elements]
        for k in range(len(elements) - 1, 0, -1):  # parents come before their children
            weight[elements[k].parent] += weight[k]
            filled[elements[k].parent] |= filled[k]
            children[elements[k].parent].append(k)
        regions = self._regions(elements, children, weight)
        inside = np.zeros(len(elements), bool)
        inside[regions] = True
        whole = np.zeros(len(elements), bool)  # regions of which no block is left out
        if any(elements[k].tag in CONTENT for k in regions):
            whole[[k for k, x in enumerate(elements) if x.tag in CONTENT and not x.hidden and not x.soft and filled[k]]] = True
            inside |= whole
        for k in range(1, len(elements)):
            inside[k] |= inside[elements[k].parent]
            whole[k] |= whole[elements[k].parent]
        lead = [] if whole.any() else self._lead(elements, [block.element for block, _ in blocks], inside)
        return "\n".join(
            text
            for i, (block, text) in enumerate(blocks)
            if i in lead or inside[block.element] and (content[i] or not soft[i]) and (whole[block.element] or block.linked <= 0.5 * len(text) or weight[block.element] > 0)
        )

    def _regions(self, elements: list[Element], children: list[list[int]], weight: np.ndarray) -> list[int]:
        """The lowest elements that hold the content, or the article or main elements around them.

        Content in several parts of the page has a region in each part that holds a share of it.
        """
        out, todo = [], [0]
        while todo:
            at = todo.pop()
            parts = [k for k in children[at] if weight[k] > 0]
            if len(parts) == 1 and weight[parts[0]] >= weight[at] and elements[parts[0]].tag not in INLINE:
                todo.append(parts[0])
            elif elements[at].tag in ("", "html", "body") and weight[at] <= sum(weight[k] for k in parts) and all(elements[k].tag in BLOCK - TEXTUAL for k in parts):
                todo += [k for k in parts if weight[k] >= self.share * weight[0]] or [max(parts, key=lambda k: weight[k])]
            else:
                while elements[at].inside and elements[at].tag not in CONTENT:
                    at = elements[at].parent
                out.append(at)
        return out

    def _lead(self, elements: list[Element], owners: list[int], inside: np.ndarray) -> list[int]:
        """Blocks (``owners``: their elements) from the last heading before the first region on, if the regions hold none."""
        first = next((i for i, k in enumerate(owners) if inside[k]), 0)
        head = np.zeros(len(elements), np.int8)
        for k in range(1, len(elements)):
            head[k] = {"h1": 1, "h2": 2}.get(elements[k].tag, head[elements[k].parent])
        for tag in (1, 2):
            heads = [i for i, k in enumerate(owners) if head[k] == tag and not elements[k].soft]
            if any(inside[owners[i]] for i in heads):
                break
            if before := [i for i in heads if i < first]:
                return [i for i in range(before[-1], first) if not elements[owners[i]].soft]
        return []

    def text(self, html: str | F.Column = "html") -> F.Column:
        """The main text of a column of pages; null and empty pages give the empty text.

        A page's text is a function of the page alone: repeated rows have equal texts, other columns are not looked at, an
        empty table gives none. End tags that close nothing are passed over, and what is left open ends with the page; blocks
        of equal scores stand or fall together.
        """
        extract = self.main_text

        def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array([extract(x.as_py()) for x in column], pa.string())

        return F.arrow_udf(run, "string")(html)
