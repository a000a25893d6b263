"""Main text of web pages: parser events, text-to-tag ratios, smoothing, threshold clustering.

The standard library's parser streams events over the whole page. Every block element ends a line;
a line knows its text, its tags, how much of the text is linked and whether an ancestor marks it as
page furniture. The ratio of text to tags per line (zero for furniture and for link lists) is smoothed
with a Gaussian, and lines above a share of its standard deviation form the content clusters; very
long lines are clipped for that deviation. The regions of the page tree that hold the clusters are then
taken as a whole: inside them no line is lost to shortness, only furniture is left out. A page with
articles gives all of them and the clusters beside them; on any other page the region grows while text
that is neither furniture nor a link list lies beside it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import frugal, slices

# Smoothing width in lines, and the share of the standard deviation that separates content.
SIGMA, SHARE = 1.0, 0.5
# Ratios count in the deviation up to so many times their third quartile.
CLIP = 4.0

# Fixed values of HTML: elements without an end tag, elements that break a line, elements never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup option p pre"
    " section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset(
    "script style noscript template head title iframe object embed svg math canvas audio video map"
    " select textarea button input datalist".split()
)
# Furniture by element, by landmark role, and by names in class and id. A name counts if it is one of the
# marks, or put together from marks and words for parts of a page ("site-footer", but not "share-price").
FURNITURE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert toolbar".split()
)
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot banner banners"
    " sponsor sponsored sponsors promo promoted promotion promotions nav navbar navigation navi menu menus"
    " breadcrumb breadcrumbs sidebar sidebars aside widget widgets footer foot masthead topbar toolbar cookie"
    " cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter"
    " subscribe subscription signup login register share sharing social related recommended recommendations"
    " comment comments commentlist disqus respond replies reply pagination pager skip search tags"
    " copyright legal".split()
)
PARTS = frozenset(
    "area article bar block blocks body box bottom button buttons col column container content entry form global"
    " group header heading icon icons inner item items layer left line link links list main message messages outer"
    " page panel placeholder post posts primary reader readers right row secondary section single site slot thread"
    " title toggle top unit user users wrap wrapper zone".split()
)
# An article of its own that is a reader's comment or an advert says so in its marks.
ARTICLE_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adbox adslot sponsor sponsored"
    " sponsors promo promoted promotion promotions comment comments commentlist disqus respond replies reply"
    " related recommended recommendations".split()
)
HEADERS = frozenset("header head heading site-header page-header".split())
CONTENT = frozenset("article main".split())
# Start tags that close an open element of the same group (end tags the author may leave out).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select article section div body main".split())


class Node:
    """An open or closed element that can hold lines.

    ``top`` is the outmost content element around it and ``in_p`` whether a paragraph is open in its scope, so no
    step has to walk up the page.
    """

    __slots__ = ("tag", "parent", "hidden", "furniture", "depth", "top", "in_p")

    def __init__(self, tag: str, parent: Node | None, hidden: bool, furniture: bool) -> None:
        self.tag, self.parent, self.hidden, self.furniture = tag, parent, hidden, furniture
        self.depth = parent.depth + 1 if parent else 0
        self.top = parent.top if parent else None
        if self.top is None and tag in CONTENT and not furniture:
            self.top = self
        self.in_p = tag == "p" or bool(parent) and tag not in SCOPE and parent.in_p


class Lines(HTMLParser):
    """Turns parser events into lines ``[text, tags, linked characters, element, furniture]``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.node = self.root = Node("", None, False, False)
        self.links = 0
        self.open: Counter[str] = Counter()
        self.lines: list[tuple[str, int, int, Node, bool]] = []
        self._text: list[str] = []
        self._tags = self._linked = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            self.lines.append((text, self._tags, self._linked, self.node, self.node.furniture))
            self._tags = 0
        self._text, self._linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag in VOID:
            if tag in BLOCK:
                self._end_line()
            elif tag in ("br", "img"):
                self._text.append(" ")
            return
        if tag in BLOCK:
            self._end_line()
            if tag in CLOSES:
                self._close_open(CLOSES[tag])
            elif self.node.in_p:
                self._close_open({"p"})
        if tag == "a":
            self.links += 1
        if tag in BLOCK or tag in HIDDEN or tag in FURNITURE:
            hidden = self.node.hidden or tag in HIDDEN or not _shown(attrs)
            self.node = Node(tag, self.node, hidden, self.node.furniture or self._is_furniture(tag, attrs))
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag in HIDDEN:
            if tag in VOID:
                self.handle_starttag(tag, attrs)
        else:  # HTML ignores the slash of other elements
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag == "p" and not self.node.in_p:
            self._end_line()
        elif self.open[tag]:  # a stray end tag closes nothing
            self._end_line()
            node = self.node
            while node.tag != tag:
                node = node.parent
            self._leave(node)
            if tag in SCOPE:
                self.links = 0

    def handle_data(self, data: str) -> None:
        if self.node.hidden:
            return
        self._text.append(data)
        if self.links:
            self._linked += len(data.strip())

    def close(self) -> None:
        super().close()
        self._end_line()

    def _leave(self, node: Node) -> None:
        """Close an open element and all in it."""
        while self.node is not node.parent:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent

    def _close_open(self, tags: set[str]) -> None:
        if not any(self.open[tag] for tag in tags):
            return
        node = self.node
        while node.parent and node.tag not in SCOPE:
            if node.tag in tags:
                self._leave(node)
                return
            node = node.parent

    def _is_furniture(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in FURNITURE:
            return True
        named = {k: (v or "").lower() for k, v in attrs}
        if named.get("role", "") in ROLES:
            return True
        in_content = self.node.top is not None
        if tag == "header" and not in_content:
            return True
        if tag in ("html", "body", "main"):
            return False
        names = f"{named.get('class', '')} {named.get('id', '')}".split()
        if tag == "article":
            return any(_marked(name, ARTICLE_MARKS) for name in names)
        return any(_marked(name, MARKS) for name in names) or (
            not in_content and any(_marked(name, HEADERS) for name in names)
        )


def _marked(name: str, marks: frozenset[str]) -> bool:
    """Whether a class or id is a mark, or marks put together with numbers and parts of a page."""
    words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
    return bool(marks.intersection(words)) and all(w in marks or w in MARKS or w in PARTS or w.isdigit() for w in words)


def _shown(attrs: list[tuple[str, str | None]]) -> bool:
    for k, v in attrs:
        if k == "hidden" or k == "aria-hidden" and (v or "").lower() == "true":
            return False
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", (v or "").lower()):
            return False
    return True


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; lines beyond either end of the page count as empty."""
    reach = max(1, int(np.ceil(2 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel / kernel.sum(), mode="full")[reach : reach + len(ratios)]


def content_lines(lines: list[tuple], sigma: float = SIGMA, share: float = SHARE) -> list[int]:
    """Numbers of the lines whose smoothed text-to-tag ratio reaches ``share`` standard deviations."""
    ratios = np.array(
        [
            0.0 if furniture or linked * 2 > len(text) else len(text) / max(1, tags)
            for text, tags, linked, _, furniture in lines
        ]
    )
    if not ratios.any():
        return [i for i, line in enumerate(lines) if not line[4]]
    clipped = np.minimum(ratios, CLIP * np.quantile(ratios[ratios > 0], 0.75))
    high = smooth(ratios, sigma) >= share * clipped.std()
    return [int(i) for i in np.flatnonzero(high & (ratios > 0))]


def _shared(homes: Iterable[Node]) -> Node | None:
    """The inmost element that holds all of the given ones."""
    seen: dict[Node, int] = {}
    first, n = {}, 0
    for home in homes:
        n += home not in first
        first[home] = 1
    for node in first:  # every element around them once
        while node is not None and node not in seen:
            seen[node] = first.get(node, 0)
            node = node.parent
    for node in sorted(seen, key=lambda e: -e.depth):
        if seen[node] == n:
            return node
        if node.parent is not None:
            seen[node.parent] += seen[node]
    return None


def _outmost_outside(home: Node, around: set[Node], known: dict[Node, Node | None]) -> Node | None:
    """The largest element about ``home`` that is not in ``around``; ``known`` keeps what was found."""
    path, node = [], home
    while node is not None and node not in around and node not in known:
        path.append(node)
        node = node.parent
    found = known.get(node) if node in known else None
    found = found or (path[-1] if path else None)
    known.update(dict.fromkeys(path, found))
    return found


def region(lines: list[tuple], chosen: list[int]) -> set[Node]:
    """Elements whose lines are taken: all articles with what lies beside them, or what the chosen lines share."""
    articles = {home.top for _, _, _, home, furniture in lines if home.top is not None and not furniture}
    if articles:
        around: set[Node] = set()
        for article in articles:
            node = article.parent
            while node is not None and node not in around:
                around.add(node)
                node = node.parent
        known: dict[Node, Node | None] = {}
        beside = {_outmost_outside(lines[i][3], around, known) for i in chosen if lines[i][3].top not in articles}
        return articles | (beside - {None})
    if not chosen:
        return set()
    # the element that holds the clusters and all text which is neither furniture nor a link list
    homes = [lines[i][3] for i in chosen]
    homes += [home for text, _, linked, home, furniture in lines if not furniture and linked * 2 <= len(text)]
    found = _shared(homes)
    return {found} if found is not None else set()


def _within(home: Node, inside: dict[Node, bool]) -> bool:
    path, node = [], home
    while node is not None and node not in inside:
        path.append(node)
        node = node.parent
    found = node is not None and inside[node]
    inside.update(dict.fromkeys(path, found))
    return found


def main_text(html: str | None) -> str:
    """The content blocks of a page in order, one per line; empty for a null or empty page."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    lines = parser.lines
    chosen = content_lines(lines)
    taken = region(lines, chosen)
    known, inside = set(chosen), dict.fromkeys(taken, True)
    out = []
    for i, (text, _, linked, home, furniture) in enumerate(lines):
        whole = home.top is not None
        # link lists around the clusters of a page, outside its articles, are furniture too
        if furniture or not whole and linked * 2 > len(text) and not chosen[0] < i < chosen[-1]:
            continue
        if i in known or _within(home, inside):
            out.append(text)
    return "\n".join(out)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``(…keep, text, n_chars)`` of every page's ``html``.

    Pages are worked on where they are read; nothing moves. A null or empty page, or one without
    content, has the empty text. Repeated rows stay; other columns are ignored.
    """
    fields = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*keep, "text", "n_chars"],
            )

    given = pages.select(*keep, F.col("html").cast("string").alias("html"))
    return given.mapInArrow(frugal(work), f"{fields}, text string, n_chars long")
