"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element gives a line; white space in a
line is collapsed. Parts that name themselves as something else than content
(scripts, menus, footers, adverts, forms, comments ...) give one line without
text, and so without weight. A line weighs its characters, or nothing where
most of them are links. Over the whole page, weights are summed in sliding
windows of ``WINDOW`` lines: a surge point is a line whose window reaches
``SURGE`` characters, a dive point one from which the windows are empty or the
lines end. All text from the first surge to the dive after the last one is
kept, lists of links between them included, and the short lines and the
heading that lead up to the first surge. Marked articles that overlap this
stretch, and one that is the page's only one, are taken in whole; where they
hold at least half of the weight, lines outside them are left out.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches

WINDOW, SURGE = 3, 80

_MARK = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*|[^>]*)(?:>|\Z)""",
    re.DOTALL,
)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr "
    "object audio video canvas math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mspace mpadded semantics annotation".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_DROP = frozenset("nav header footer aside form button select option dialog menu svg map fieldset head datalist".split())
_HEAD = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Text of its own, in which a name may be a subject: the id is often made of the heading's words.
_TEXT = _HEAD | frozenset("p pre blockquote li dl dt dd table thead tbody tfoot caption tr td th figure figcaption details summary".split())
#: Parts of a name that say enough, and names that do only as a whole.
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox adbanner sponsor sponsored sponsors "
    "nav navbar navi submenu menu menus breadcrumb breadcrumbs pagination pager masthead topbar footer bottombar sidebar sidebars "
    "cookie cookies gdpr popup newsletter commentlist disqus searchform".split()
)
_BAD_NAMES = frozenset(
    "banner banners promo promos promotion promoted navigation aside header widget widgets consent modal overlay subscribe subscription signup login signin register "
    "search form notice notices comment comments respond reply replies share sharing social related recommended recommendations toolbar skip hidden discussion".split()
)
#: Of these, names that an article's own parts have as well.
_OWN = frozenset("header form notice notices discussion overlay promotion register subscription navigation comment reply".split())
#: Ambiguous words with the name of a container.
_BAD_PAIR = re.compile(
    r"""(?:[a-z]+[-_])??(?:comments?|respond|repl(?:y|ies)|related|recommended|shar(?:e|ing)|social|search|promo|widget|banner|login|signup|subscribe|cookie|consent|toolbar|skip)
    [-_](?:area|list|section|box|bar|form|buttons?|icons?|links?|widgets?|wrapper|container|block|posts?|articles?|stories|respond|count|banner|notice|message|overlay|modal|nav)
    |(?:post|page|site|top|user|blog|entry|article|global|main)[-_](?:comments|share|sharing|search|social|banner|navigation|related|widgets)
    |site[-_]?header|page[-_]?header|top[-_]?header|(?:comment|widget|share)[-_]?\d+|share[-_]this""",
    re.VERBOSE,
)
#: Says what a page has beside this element.
_LAYOUT = re.compile(r"\b(?:has|with|no|without|show|hide)[-_]\w+")
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_MAIN = frozenset(("article", "main"))
_P_ENDERS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


def _named_bad(tag: str, kind: str, value: str, inside: bool) -> bool:
    """Whether a class or id says that an element is something else than content."""
    names = value.split()
    if tag in _TEXT:  # classes alone, as a whole
        return kind == "class" and any(n in _BAD or n == "hidden" for n in names)
    if kind == "id" and tag == "section":
        return False
    for n in names:
        n = re.sub(r"(?<=[a-z])\d+$", "", n)
        if n in _BAD or _BAD_PAIR.fullmatch(n):
            return True
        if n in _BAD_NAMES and not (n in _OWN and (inside or tag == "section" or kind == "id" and n != "header")):
            return True
        if not (kind == "id" and inside) and not _BAD.isdisjoint(re.split(r"[^a-z0-9]+", n)):
            return True
    return False


def _bad(tag: str, attrs: str, inside: bool = False) -> bool:
    if tag in _DROP:
        return True
    if not attrs or tag in ("body", "html"):
        return False
    found = {}
    for name, value in _ATTR.findall(attrs):
        found.setdefault(name.lower(), value.strip("\"'").lower())
    slug = "section" in found.get("class", "").split()  # a heading's text as id
    for name, value in found.items():
        if name == "class" or name == "id" and not slug:
            if _named_bad(tag, name, _LAYOUT.sub("", value), inside):
                return True
        if name == "role" and value in _BAD_ROLE or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class _Open:
    """Open elements, with the places of each tag, so that ends are found without a search."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool]] = []  # tags and whether they are dropped
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.mains: list[int] = []

    def push(self, tag: str, bad: bool) -> None:
        k = len(self.stack)
        self.stack.append((tag, bad))
        self.places.setdefault(tag, []).append(k)
        if tag not in _INLINE:
            self.blocks.append(k)
        if tag in _MAIN:
            self.mains.append(k)

    def pop(self) -> tuple[str, bool]:
        tag, bad = self.stack.pop()
        self.places[tag].pop()
        if tag not in _INLINE:
            self.blocks.pop()
        if tag in _MAIN:
            self.mains.pop()
        return tag, bad

    def last(self, tags: tuple[str, ...]) -> int:
        """Place of the innermost of these tags, or -1."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def end_of(self, tag: str) -> int | None:
        """Place of the element that an end tag closes; -1 if there is none,
        None if a block (for an inline end) or an article stands between."""
        k = self.last((tag,))
        if tag in _INLINE and self.blocks and self.blocks[-1] > k or tag not in ("body", "html") and self.mains and self.mains[-1] > k:
            return None
        return k


_SAME = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "li": ("li",), "option": ("option",)}
_OUTER = ("ul", "ol", "dl", "table", "div", "section", "article", "select")


class Line(NamedTuple):
    text: str
    linked: int  # characters in links
    article: int  # number of the marked article, or 0
    heading: bool
    dropped: bool  # stands for parts that aren't content, without their text

    @property
    def weight(self) -> int:
        """Characters that count for a surge; none where links are most of the line."""
        return max(0, len(self.text) - 2 * self.linked) if self.linked * 2 > len(self.text) else len(self.text)


def lines_of(page: str) -> list[Line]:
    """The page's lines in order; neighbouring parts that are dropped are one
    line without text. Linear in the page, however deep its elements."""
    out: list[Line] = []
    parts: list[str] = []
    linked, links, article, heading = 0, 0, 0, 0
    opened = _Open()
    dropped = 0
    at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append(Line(text, linked, article if opened.mains else 0, heading > 0, False))
        parts, linked = [], 0

    def close(k: int) -> None:
        nonlocal dropped, links, heading
        while len(opened.stack) > k:
            tag, bad = opened.stack[-1]
            if tag not in _INLINE:
                flush()
            opened.pop()
            heading -= tag in _HEAD
            dropped -= bad
            links -= tag == "a"

    while m := _MARK.search(page, at):
        if m.start() > at and not dropped:
            piece = page[at : m.start()]
            parts.append(piece)
            if links:
                linked += len(piece.strip())
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = opened.end_of(tag)
            if k is not None and k >= 0:
                close(k)
            elif k is not None and tag not in _INLINE:
                flush()
            continue
        if tag in _RAW:
            at = _raw_end(tag).search(page, at).end()
            continue
        if tag == "br" or tag == "hr":
            if not dropped:
                parts.append(" ")
            if tag == "br":
                continue
        if tag not in _INLINE:
            if tag in _P_ENDERS:
                if opened.blocks and opened.stack[opened.blocks[-1]][0] == "p":
                    close(opened.blocks[-1])
            elif tag in _SAME:
                outer = opened.last(_OUTER)
                while (k := opened.last(_SAME[tag])) > outer:
                    close(k)
                    if tag != "tr":
                        break
            flush()
        if tag in _VOID or m[3].endswith("/") and tag in ("svg", "path"):
            continue
        bad = _bad(tag, m[3], bool(opened.mains))
        if bad and tag == "header" and opened.mains and not dropped:
            bad = False  # an article's own head
        if tag in _MAIN:
            article += not opened.mains
        opened.push(tag, bad)
        if bad and not dropped and tag not in _INLINE and not (out and out[-1].dropped):
            out.append(Line("", 0, article if opened.mains else 0, False, True))
        dropped += bad
        links += tag == "a"
        heading += tag in _HEAD
    if at < len(page) and not dropped:
        parts.append(page[at:])
    close(0)
    flush()
    return out


def _raw_end(tag: str) -> re.Pattern[str]:
    if tag not in _RAW_ENDS:
        _RAW_ENDS[tag] = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)|\Z", re.IGNORECASE)
    return _RAW_ENDS[tag]


_RAW_ENDS: dict[str, re.Pattern[str]] = {}


def stretch(weights: list[int], headings: list[bool] | None = None, dropped: list[bool] | None = None, window: int = WINDOW, surge: int = SURGE) -> tuple[int, int]:
    """First and last + 1 line from the first surge, with what leads up to it,
    to the dive after the last surge; (0, 0) if there is none.

    What leads up are the short lines next to it, dropped parts not counted,
    and a heading across less than a window of lines without weight.
    """
    n = len(weights)
    sums, total = [0] * n, 0
    for i in range(n - 1, -1, -1):
        total += weights[i] - (weights[i + window] if i + window < n else 0)
        sums[i] = total
    surges = [i for i in range(n) if sums[i] >= surge and weights[i]]
    if not surges:
        return 0, 0
    a, b = surges[0], surges[-1]
    while b < n and sums[b] > 0:
        b += 1
    while a:
        k, gap = a - 1, 0
        while k > 0 and not weights[k]:
            gap += not (dropped and dropped[k])
            if gap == window:
                break
            k -= 1
        if not weights[k] or gap and not (headings and headings[k]):
            break  # lines of links lead up to nothing but a heading
        a = k
    return a, b


def main_text(page: str) -> str:
    lines = lines_of(page)
    weights = [x.weight for x in lines]
    a, b = stretch(weights, [x.heading for x in lines], [x.dropped for x in lines])
    if (a, b) == (0, 0):
        b = len(lines)  # a short page: no surge, so no lines to cut off
    articles = {x.article for x in lines if not x.dropped} - {0}
    if len(articles) > 1:
        articles &= {x.article for x in lines[a:b]}
    inside = sum(n for n, x in zip(weights, lines) if x.article in articles)
    outside = sum(n for n, x in zip(weights[a:b], lines[a:b]) if x.article not in articles)
    trimmed = bool(articles) and inside >= outside
    return " ".join(x.text for i, x in enumerate(lines) if not x.dropped and (x.article in articles or a <= i < b and not trimmed))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null and empty html give an empty text, n_chars 0; unclosed elements end
    with the page. Repeated rows and null ids each give their row, other
    columns are ignored, an empty table gives no rows.
    """
    text_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
