"""The main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page, with what the tags around
each say: scripts, styles and forms have no lines, and lines inside menus, headers, footers,
sidebars, notices, adverts and comments weigh nothing, as does the text of links. Sums of
weights over a sliding window of lines surge where the text begins and dive where it ends.
The lines between that weigh something are the text. Where a page marks its article, lines
outside it weigh nothing either, and every range inside that surges counts. What stands in
the same container as text that is kept stays too: short lines, and lines of links between.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Comments, declarations and tags; an open comment reaches to the end. A quote after "=" reaches to the next one, however
#: far, and may hold ">". Nothing is tried twice but what follows the last quote of its sort, so a page costs linear time.
_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*+>?"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>=]++|=(?:\s*+(?:\"[^\"]*+\"|'[^']*+'))?+)*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.S,
)
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style noscript template textarea select option button iframe object svg math canvas audio video map head title".split())
#: Of these, the content isn't even markup.
RAW = frozenset("script style textarea title iframe noscript".split())
#: Elements that are no part of an article.
APART = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset("article main".split())
#: Elements that hold the parts of a page; those beside each other with the same classes are one container.
CONTAINERS = frozenset("article div main section".split())
#: Words in a class, id or role that set an element apart.
APART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements sponsor sponsored sponsors promo promotion banner menu menus nav navbar navigation "
    "breadcrumb breadcrumbs sidebar sidebars footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe "
    "signup login comment comments disqus respond replies reply share sharing social related recommended recommendations widget widgets "
    "pagination pager toolbar alert toc complementary contentinfo search dialog".split()
)
#: Of these, some set apart whatever they are joined with; others only by themselves or with words for a place on a page.
APART_ANYWHERE = frozenset(
    "ads advert adverts advertisement advertisements sponsored sponsors navbar navigation breadcrumb breadcrumbs sidebar sidebars cookie cookies "
    "comments disqus newsletter pagination pager popup masthead recommendations complementary contentinfo".split()
)
#: Words for a place or a part, which leave a name what it is.
PLACE_WORDS = frozenset(
    "area bar block bottom box btn button buttons center container content form group head inner item items left link links list main outer page panel "
    "posts articles right row section site small top unit view wrap wrapper zone".split()
)
#: What belongs to an article: with these, what is said about it is apart, and what introduces it isn't.
ARTICLE_WORDS = frozenset("article blog entry news post story".split())
INTRODUCES = frozenset("header banner alert notice".split())
#: A name with one of these tells of what an element has and not of what it is.
LAYOUT_WORDS = frozenset("with has no without".split())
_NAMED = re.compile(r"(?:\b(?:class|id|role)\s*=\s*)(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN_BY = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"\s+")
#: An ``article`` that leads elsewhere and is smaller than the largest by this factor is a teaser.
TEASER = 4
#: Lines in a window, and what a surge has to reach unless the whole page stays below it.
WINDOW, SURGE = 3, 80


_CLASS = re.compile(r"\bclass\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)


class Line:
    """A block of the page; ``place`` is its container and ``unit`` its ``article``, each 0 outside of all."""

    __slots__ = ("apart", "linked", "main", "place", "text", "unit")

    def __init__(self, text: str, linked: int, apart: bool, main: bool, place: int, unit: int):
        self.text, self.linked, self.apart, self.main, self.place, self.unit = text, linked, apart, main, place, unit


def _name_sets_apart(words: list[str], inside: bool) -> bool:
    """Whether a class, id or role says that an element is no part of the article; ``inside`` one that is marked, only if all of the name does."""
    if LAYOUT_WORDS.intersection(words) or not APART_WORDS.intersection(words):
        return False
    if not inside or len(words) == 1 or APART_ANYWHERE.intersection(words):
        return True
    rest = {w for w in words if w not in APART_WORDS and w not in PLACE_WORDS}
    return not rest or rest <= ARTICLE_WORDS and not INTRODUCES.intersection(words)


def _sets_apart(tag: str, rest: str, inside: bool = False) -> bool:
    if tag in APART:
        return True
    if tag in MAIN or tag in ("body", "html") or "=" not in rest and "hidden" not in rest:
        return False
    if _HIDDEN_BY.search(rest):
        return True
    for names in _NAMED.findall(rest):
        for name in "".join(names).split():
            if _name_sets_apart([w.lower() for w in _WORDS.findall(name)], inside):
                return True
    return False


def lines(page: str) -> tuple[list[Line], list[int]]:
    """The page's blocks in order, references decoded, white space as one space, trimmed; empty ones left out. And what each place lies in."""
    out: list[Line] = []
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool, int, int]] = []  # tag, hidden, apart, main, place, unit: with all around it
    hidden = apart = main = in_link = False
    place, places, unit, units = 0, {}, 0, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.append(Line(text, min(linked, len(text)), apart, main, place, unit))
        parts, linked = [], 0

    at, end, last = 0, len(page), page.rfind(">") + 1  # beyond the last ">" there is no tag
    while at < end:
        m = _MARKUP.search(page, at, last) if at < last else None
        text = page[at : m.start()] if m else page[at:].partition("<!--")[0]
        if text and not hidden:
            parts.append(text)
            if in_link:
                linked += len(text.strip())
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<!--") and not m[0].endswith("-->") or m[0].startswith("<![CDATA[") and not m[0].endswith("]]>"):
            break
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, rest = tag.lower(), m["rest"] if m["tag"] else m["rest2"]
        if m["close"] or m["close2"]:
            if tag in BLOCKS:
                flush()
            if tag == "a":
                in_link = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s[0] in BLOCKS for s in stack[k:]):
                        flush()
                    del stack[k:]
                    hidden, apart, main, place, unit = stack[-1][1:] if stack else (False, False, False, 0, 0)
                    break
                if stack[k][0] in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag closes nothing beyond
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            stop = close.start() if close else end
            at = page.find(">", stop) + 1 if close else end
            at = at or end
            continue
        if tag == "a":
            in_link = True
            continue
        if tag in ("p", "li", "tr", "td", "th", "dd", "dt", "option"):  # such an element ends one of its sort that is open
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    hidden, apart, main, place, unit = stack[-1][1:] if stack else (False, False, False, 0, 0)
                    break
                if stack[k][0] in BLOCKS and stack[k][0] not in ("p", "td", "th", "tr"):
                    break
        if tag in BLOCKS or tag in HIDDEN or "=" in rest:
            hidden = hidden or tag in HIDDEN
            away = _sets_apart(tag, rest, main)
            if away and not apart:
                flush()
            apart = apart or away
            main = main or tag in MAIN or "articleBody" in rest
            if tag in CONTAINERS:
                named = _CLASS.search(rest)
                place = places.setdefault((place, tag, "".join(x or "" for x in named.groups()) if named else ""), len(places) + 1)
            if tag == "article" or "articleBody" in rest:
                units += 1
                unit = units
            stack.append((tag, hidden, apart, main, place, unit))
    flush()
    return out, [0, *(outer for outer, _, _ in places)]


def _ranges(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """First line and end of each range from a surge to a dive, with short lines right before, such as a title."""
    n, out, i = len(weights), [], 0
    sums = [sum(weights[k : k + window]) for k in range(n)]
    least = min(surge, max(sums))
    while i < n:
        if sums[i] < least or not weights[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:  # the dive: a whole window without text
            j += 1
        while i and weights[i - 1]:
            i -= 1
        out.append((i, j))
        i = j
    return out


def _near(found: list[Line], weights: list[int], outer: list[int], ranges: list[tuple[int, int]]) -> set[int]:
    """The lines of the heaviest range, and those of other ranges that lie in its container.

    Its container is the innermost place around all its lines. Where they have none in
    common, it is the places that they are in.
    """
    i, j = max(ranges, key=lambda r: (sum(weights[r[0] : r[1]]), -r[0]))
    kept = {k for k in range(i, j) if weights[k]}
    own = [0] * len(outer)
    for k in kept:
        own[found[k].place] += 1
    below = own[:]
    for p in range(len(outer) - 1, 0, -1):  # a place comes after the one it lies in
        below[outer[p]] += below[p]
    base = max(p for p in range(len(outer)) if below[p] == len(kept))
    inside = [False] * len(outer)
    for p in range(len(outer)):
        inside[p] = p == base or inside[outer[p]] if base else own[p] > 0
    return kept | {k for first, end in ranges for k in range(first, end) if weights[k] and inside[found[k].place]}


def _beside(found: list[Line], usable: list[bool], weights: list[int], outer: list[int], kept: set[int], edge: int, around: bool) -> set[int]:
    """Other lines in the containers of kept ones: short ones, what stands between, and at either end fewer links than ``edge``.

    Unless a mark is ``around`` them, lines that no container holds stay only between kept ones.
    Lines between two kept ones also stay where their place holds, is in, or is beside both.
    """

    def near(p: int, q: int) -> bool:
        return p == q or outer[p] == q > 0 or outer[q] == p > 0 or outer[p] == outer[q] > 0

    of: dict[int, list[int]] = {found[i].place: [] for i in kept}
    for i, x in enumerate(found):
        if usable[i] and x.place in of:
            of[x.place].append(i)
    more: set[int] = set()
    for place, at in of.items():
        heavy = [k for k, i in enumerate(at) if (weights[i] if place or around else i in kept)]
        first, last = heavy[0], heavy[-1]
        more.update(at[0 if first < edge else first : len(at) if len(at) - 1 - last < edge else last + 1])
    stay = sorted(kept | more)
    for a, b in zip(stay, stay[1:], strict=False):
        more.update(i for i in range(a + 1, b) if usable[i] and near(found[i].place, found[a].place) and near(found[i].place, found[b].place))
    return more


def _teasers(found: list[Line], usable: list[bool]) -> set[int]:
    """Units that tease to other pages: beside an ``article`` that is ``TEASER`` times as large, and with a link in them."""
    size: dict[int, int] = {}
    linked: set[int] = set()
    for x, u in zip(found, usable, strict=True):
        if u and x.unit:
            size[x.unit] = size.get(x.unit, 0) + len(x.text) - x.linked
            if x.linked:
                linked.add(x.unit)
    most = max(size.values(), default=0)
    return {k for k in linked if size[k] * TEASER <= most}


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks, joined by line feeds; empty where there are none or the page is null."""
    found, outer = lines(page or "")
    marked = any(x.main and not x.apart for x in found)
    usable = [not x.apart and (x.main or not marked) for x in found]
    if marked and (teasers := _teasers(found, usable)):
        usable = [u and x.unit not in teasers for x, u in zip(found, usable, strict=True)]
    weights = [max(0, len(x.text) - x.linked) if u else 0 for x, u in zip(found, usable, strict=True)]
    if not any(weights):
        return ""
    ranges = _ranges(weights, window, surge)
    if marked:  # the article may have several parts, with adverts between
        kept = {i for first, end in ranges for i in range(first, end) if weights[i]}
    else:
        kept = _near(found, weights, outer, ranges)
    kept |= _beside(found, usable, weights, outer, kept, window if marked else 1, marked)
    return "\n".join(found[i].text for i in sorted(kept))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``page_id, url, html``.

    A null or empty page, and one without an article, gives an empty text. Repeated rows each
    give a row; an empty table gives an empty table. One scan, nothing shuffled.
    """
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py()) for p in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    cols = [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")]
    return pages.select(*cols).mapInArrow(run, "page_id long, url string, text string, n_chars long")
