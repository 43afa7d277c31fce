"""Main text of web pages, from the events of the standard library's HTML parser.

Events cut a page into lines, one for each block of text. Each line has a ratio of text to tags; the ratios, smoothed by a
Gaussian, fall into two clusters, and the lines of the upper cluster mark where the content lies. The page's text is that of
the article that holds most of the marked text (with others beside it that are more than a linked teaser), or else of the smallest element
that holds all of it, without the parts that are no article by their element, role, class or id (menus, headers, footers,
sidebars, notices, adverts, comments, scripts, styles). A name never drops what holds the page's `main`, or all its articles and most of its text, or where there are none nearly all its
text; and a form that holds most of the text is a wrapper too. Names with a word that isn't one of such parts (has-sidebar, social-history), and names that may as well stand for
a section of an article (related work, legal), are votes: the marked lines decide.

Elements are numbered in the order in which they open, so that what lies in one is a range of numbers: every pass over the
elements or lines is linear, whatever their nesting. Null, empty and textless pages give an empty text. Pages of any length are
read whole, in pieces. Broken markup doesn't fail: open elements end where their parent ends, and a tag or comment that nobody closes reaches to the page's end. Equal pages give equal texts; an
empty table gives an empty one; extra columns are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readmill.llm.common import map_batches, rows

#: Elements that end a line where they begin and where they end.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option optgroup p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never part of an article.
DROPPED = set("nav footer aside script style noscript template head title button select option textarea iframe object svg canvas dialog menu audio video map datalist search".split())
#: Elements whose content isn't text at all.
UNSEEN = set("script style noscript template head title svg canvas iframe object".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist status".split())
#: Words in class or id that mark parts outside the article.
DROPPED_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription signup login signin register sidebar sidebars sidenav aside nav navbar navigation menu menus submenu breadcrumb breadcrumbs crumbs pagination pager paging footer masthead topbar toolbar share sharing social "
    "comment comments commentlist disqus replies reply respond widget widgets copyright disclaimer".split()
)
#: Words that do so alone or with a word of PARTS.
PERHAPS = set("related recommended recommendations trending popular discussion hidden skip legal foot tags tagcloud byline meta".split())
#: Of these, the ones that alone may well name a section of an article: there the marked lines decide.
SECTIONS = set("related recommended discussion legal register share sharing social notice notices banner promotion disclaimer copyright subscription".split())
#: Words that leave a name as certain as it is without them.
GENERAL = set(
    "bar box slot top bottom main site inner outer left right header wrap col column columns row panel unit button buttons icon icons form global primary secondary fixed sticky mobile desktop text title body group tab tabs toggle "
    "center head footer label count large small first last new all your our us the and by on for js id".split()
)
PARTS = set("posts post articles article stories story links link content items item list box block news reading topics topic entry page info more to wrapper container section area".split())
#: The same, where they aren't inside an article.
OUTSIDE_ONLY = {"header", "head"}
#: Unless they go with one of these, as in post-header.
OF_ARTICLES = {"post", "entry", "article", "content", "story", "title"}
ARTICLES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
NO_REGION = set("p b i em strong span a h1 h2 h3 h4 h5 h6 li td blockquote pre font u small".split())
LISTS = {"ul", "ol", "dl", "table"}
BESIDE = {"p", "blockquote", "pre", "ul", "ol", "li"}
#: Clusters whose centres are nearer than this (a factor of two between ratios) are one.
APART = float(np.log(2))
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


class Lines(HTMLParser):
    """Lines of a page: text, tags, characters inside links, and the number of the element they stand in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # of each element, in the order in which they open: tag, number of its parent, whether it is dropped, has a name that drops it, may be dropped, is in an article or a link
        self.tag, self.up, self.dropped, self.named, self.doubtful, self.article, self.link = [""], [-1], [False], [False], [False], [False], [False]
        self.path = [0]  # the numbers of the open elements
        self.open: dict[str, list[int]] = {}  # the depths at which each tag is open
        self.blocks = [0]  # the depths of the open block elements
        self.lines: list[tuple[str, int, int, int]] = []
        self.text: list[str] = []
        self.tags = self.linked = 0

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers aren't needed

    def end_line(self) -> None:
        if self.text:
            if text := " ".join("".join(self.text).split()):
                self.lines.append((text, self.tags, self.linked, self.path[-1]))
                self.tags = 0
            self.text = []
            self.linked = 0

    def _end_at(self, depth: int) -> None:
        """Close the element at this depth and all inside it."""
        while len(self.path) > depth:
            tag = self.tag[self.path.pop()]
            self.open[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()

    def _judged(self, tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
        """Whether an element is no part of an article, is none by its name, or perhaps is none."""
        inside = self.article[self.path[-1]]
        if tag in DROPPED or (tag == "header" and not inside and not any(OF_ARTICLES & set(_NAME.findall((v or "").lower())) for n, v in attrs if n in ("class", "id"))):
            return True, False, False
        doubtful, named = tag == "form", False
        for name, value in attrs:
            if name in ("class", "id") and value and tag not in ("html", "body", "main"):
                found = {w.lower() for w in _NAME.findall(value)}
                if tag == "article":
                    named = named or bool(found & {"comment", "comments", "reply", "ad", "ads", "sponsored", "promo"})
                    continue
                for one in value.split():
                    words = {w.lower() for w in _NAME.findall(one) if not w.isdigit()}
                    if words & DROPPED_NAMES:
                        if not words <= DROPPED_NAMES | PERHAPS | PARTS | GENERAL or words <= SECTIONS:
                            doubtful = True
                        else:
                            named = True
                    elif words & PERHAPS and words <= PERHAPS | PARTS:
                        if words <= SECTIONS:
                            doubtful = True
                        else:
                            named = True
                if not inside and found & OUTSIDE_ONLY and not found & OF_ARTICLES:
                    named = True
            elif name == "role" and (value or "").strip().lower() in DROPPED_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                if tag != "form":
                    return True, False, False
            elif name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, False, False
        return False, named, doubtful

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        if tag in VOID:
            return
        if tag in ARTICLES and self.dropped[self.path[-1]]:  # a menu or header that nobody closed
            depth = len(self.path)
            while depth > 1 and self.dropped[self.path[depth - 1]] and self.tag[self.path[depth - 1]] in ("nav", "header", "ul", "li", "a", "head", "title"):
                depth -= 1
            if not self.dropped[self.path[depth - 1]]:
                self._end_at(depth)
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):  # these end the one before
            for depth in range(len(self.path) - 1, max(0, len(self.path) - 9), -1):
                over = self.tag[self.path[depth]]
                if over in ("div", "section", "ul", "ol", "table", "dl", "select") or over in ARTICLES:
                    break
                if over == tag:
                    self._end_at(depth)
                    break
        here = self.path[-1]
        dropped, named, doubtful = (True, False, False) if self.dropped[here] else self._judged(tag, attrs)
        self.open.setdefault(tag, []).append(len(self.path))
        if tag in BLOCKS:
            self.blocks.append(len(self.path))
        self.path.append(len(self.tag))
        self.tag.append(tag)
        self.up.append(here)
        self.dropped.append(dropped)
        self.named.append(named)
        self.doubtful.append(doubtful)
        self.article.append((self.article[here] or tag in ARTICLES) and not dropped)
        self.link.append(tag == "a" or self.link[here])

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        depths = self.open.get(tag)
        # an inline end doesn't end blocks
        if depths and (tag in BLOCKS or depths[-1] > self.blocks[-1]):
            self._end_at(depths[-1])

    def handle_data(self, data: str) -> None:
        here = self.path[-1]
        if self.dropped[here]:
            if not self.text and self.tag[here] not in UNSEEN and not data.isspace():
                self.lines.append(("", self.tags, 0, here))
                self.tags = 0
            return
        self.text.append(data)
        if self.link[here]:
            self.linked += len(data)


def smooth(x: np.ndarray, sigma: float) -> np.ndarray:
    """A Gaussian mean of each value and its neighbours; at the ends, of those there are."""
    r = int(3 * sigma + 0.5)
    weights = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    part = lambda y: np.convolve(np.pad(y, r), weights, "valid")
    return part(x) / part(np.ones_like(x))


def threshold(x: np.ndarray, rounds: int = 30) -> float:
    """Midway between the centres of two clusters of the values (two-means from the extremes); below all values if they are one cluster."""
    low, high = float(x.min()), float(x.max())
    for _ in range(rounds):
        upper = x > (low + high) / 2
        if upper.all() or not upper.any():
            break
        a, b = float(x[~upper].mean()), float(x[upper].mean())
        if (a, b) == (low, high):
            break
        low, high = a, b
    return (low + high) / 2 if high - low >= APART else float(x.min())


def sums(values: np.ndarray, at: np.ndarray, ups: list[int]) -> np.ndarray:
    """The sum of the lines' values in each element and all inside it. at: the lines' elements."""
    total = np.bincount(at, values, len(ups)).tolist()
    for k in range(len(ups) - 1, 0, -1):
        total[ups[k]] += total[k]
    return np.array(total)


def parsed(html: str, piece: int) -> Lines:
    """What the parser makes of a page. It looks for the end of what is open whenever it is fed, and at a page's end once for each beginning that has none, so that it
    never gets to see what comes after the last `>`."""
    parser, end = Lines(), html.rfind(">") + 1
    for a in range(0, end, piece):
        parser.feed(html[a : min(a + piece, end)])
    left = parser.rawdata
    parser.rawdata = ""
    tag = re.search(r"<[a-zA-Z/!?]", left + html[end:])  # markup that the page ends in
    parser.handle_data(unescape((left + html[end:])[: tag.start() if tag else None]))
    parser.end_line()
    return parser


def unnamed(parser: Lines, last: list[int], plain: np.ndarray) -> np.ndarray:
    """For each element whether it goes with an element of a name that drops it. plain: the characters outside links in each element."""
    out = np.zeros(len(parser.up), bool)
    found = np.flatnonzero(parser.named).tolist()
    if found:
        tags = np.array(parser.tag)
        main, articles = np.flatnonzero(tags == "main"), np.flatnonzero((tags == "article") & ~np.array(parser.named))
        within = lambda k, some: ((some > k) & (some <= last[k])).sum()
        for k in found:
            holds = within(k, articles)
            wrapper = within(k, main) or plain[k] >= plain[0] * (0.5 if holds and holds == len(articles) else 0.8 if not len(articles) else 2)
            if not (wrapper and plain[k]):
                out[k : last[k] + 1] = True
    return out


def main_text(html: str, sigma: float = 1.5, share: float = 0.75, piece: int = 1 << 20) -> str:
    """The text of the article with at least `share` of the text in lines above the threshold, and of those next to it; or of the region with all of it."""
    parser = parsed(html, piece)
    lines, ups, tags = parser.lines, parser.up, parser.tag  # lines of dropped parts have no text: they count as the lower cluster
    at = np.array([k for *_, k in lines], int)
    size = np.array([len(t) for t, *_ in lines], float)
    linked = np.array([n for _, _, n, _ in lines], float)
    if not size.any():
        return ""
    last = list(range(len(ups)))  # the last element inside each
    for k in range(len(ups) - 1, 0, -1):
        last[ups[k]] = max(last[ups[k]], last[k])
    named = unnamed(parser, last, sums(np.maximum(size - linked, 0), at, ups))
    in_article = [a and not n for a, n in zip(parser.article, named.tolist())]
    size[named[at]] = linked[named[at]] = 0
    if not size.any():
        return ""
    ratio = np.maximum(size - linked, 0) / np.maximum([n for _, n, _, _ in lines], 1)

    def clusters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.log1p(ratio)
        level = smooth(own, sigma)
        upper = level >= threshold(level)
        marked = upper & (ratio > 0)
        return upper, marked, marked & (own >= own[marked].mean() if marked.any() else False)

    _, marked, dense = clusters()
    if any(parser.doubtful):
        all_text, all_marked, all_linked = (sums(x, at, ups) for x in (size, size * dense, linked))  # by their own ratios: a short line amid long ones isn't prose
        gone = np.zeros(len(lines), bool)
        for k in np.flatnonzero(parser.doubtful).tolist():
            prose = all_marked[k] >= 0.5 * all_text[k] and all_linked[k] <= 0.3 * all_text[k]
            if all_text[k] < 0.5 * all_text[0] and (tags[k] == "form" or not prose):
                gone |= (at >= k) & (at <= last[k])
        if gone.any() and not gone[size > 0].all():
            size[gone] = ratio[gone] = linked[gone] = 0
    upper, marked, _ = clusters()
    if not marked.any():
        marked = size > 0
    held, level = sums(size * marked, at, ups), [0] * len(ups)
    for k in range(1, len(ups)):
        level[k] = level[ups[k]] + 1
    total, region = held[0], 0
    for k in range(1, len(ups)):  # the deepest element with enough of the marked text
        if held[k] >= share * total and tags[k] not in NO_REGION and level[k] > level[region]:
            region = k
    up = region
    while up >= 0:  # the article around it, if it is in one
        if tags[up] in ARTICLES:
            region = up
            break
        up = ups[up]
    article = in_article[region]
    # articles that stand in no other one
    whole = [k for k in range(len(ups)) if tags[k] == "article" and in_article[k]]
    outer, end = [], -1
    for k in whole:
        if k > end:
            outer.append(k)
            end = last[k]
    while not article and ups[region] >= 0 and (held[region] < total or tags[region] in NO_REGION):
        region = ups[region]  # outside articles nothing marked may stay out
    regions = [region]
    if article and tags[region] == "article" or not article and len(outer) > 1 and sum(held[k] for k in outer) >= share * total:
        own, of_links = (sums(x.astype(float), at, ups) for x in ((size > 0) & (linked <= 0.5 * size), linked > 0.5 * size))
        regions = [k for k in outer if k == region or own[k] > 1 or own[k] and not of_links[k]]  # a line beside a linked title is a teaser
        article = True
    inside = np.zeros(len(lines), bool)
    for k in regions:
        inside |= (at >= k) & (at <= last[k])
    inside &= size > 0
    if not article:
        # lists of links stay where the smoothed level is high, or paragraphs of the content stand around them
        direct = set(np.array(ups)[at[marked & inside]].tolist())
        span = np.flatnonzero(marked & inside)
        for k in np.flatnonzero(inside & ~upper & (linked > 0.5 * size)).tolist():
            up, steps = at[k], 0
            while up > 0 and tags[up] not in LISTS and steps < 5:
                up, steps = ups[up], steps + 1
            inside[k] = tags[up] in LISTS and ups[up] in direct and span[0] < k < span[-1]
    chosen = np.flatnonzero(inside).tolist()
    if not article:  # outside articles, from the first marked line to the last, and what stands beside these in an element with marked lines
        seen = [i for i, k in enumerate(chosen) if marked[k]]
        first, final = seen[0], seen[-1]
        near = lambda k: (up := ups[at[k]]) >= 0 and held[up] > 0 and tags[at[k]] in BESIDE or tags[at[k]] in HEADINGS
        while first > 0 and near(chosen[first - 1]):
            first -= 1
        while final + 1 < len(chosen) and near(chosen[final + 1]):
            final += 1
        chosen = chosen[first : final + 1]
    return " ".join(lines[k][0] for k in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            out = pa.schema([batch.schema.field("page_id"), batch.schema.field("url"), pa.field("text", pa.string()), pa.field("n_chars", pa.int64())])
            yield rows(out, [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]])

    return map_batches(pages.select("page_id", "url", "html"), run, schema)
