"""Main-text extraction from raw pages by the distribution of text over line blocks."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm.common import table

#: Lines in a sliding window, and the text length at which a window is a surge.
WINDOW, SURGE = 3, 80

# The element names of HTML, by what they do to the text around them.
RAW = "script style noscript textarea title iframe noembed noframes xmp".split()
DROPPED = "template svg object canvas nav header footer aside form button select dialog menu fieldset".split()
BLOCK = (
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary "
    "table tbody td tfoot th thead tr ul"
).split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HEADING = "h1 h2 h3 h4 h5 h6".split()
MAIN = ("article", "main")
#: An open element of the first kind ends where one of the second starts, or at the end of its parent.
IMPLIED = {
    "p": BLOCK, "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "tbody", "tfoot"],
    "td": ["td", "th", "tr", "tbody", "tfoot"], "th": ["td", "th", "tr", "tbody", "tfoot"],
}
#: End tags of other elements don't reach through an open one of these.
SCOPE = "td th caption table ul ol dl button object template".split()
#: Words of a block's class, id or role that mark a part of the page as not of the article: of readers, and of the site.
COMMENTS = "comment comments commentlist disqus discussion replies reply respond".split()
MARKED = (
    "banner notice notices notification alert popup modal overlay paywall sidebar "
    "sidenav rail nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer foot "
    "share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager toolbar widget complementary contentinfo"
).split()
#: These mark a part wherever they stand in its name, as in ad-300x250.
ANYWHERE = "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr".split()
#: What a name may end in without being about it: sidebar-right is a sidebar, social-impact is no matter of sharing.
ENDINGS = (
    "left right top bottom main primary secondary inner outer wrapper wrap container area box block section list item items "
    "widget content text link links bar row col column region form button buttons icon icons slot unit zone holder panel "
    "group posts articles stories news media"
).split()
#: A class with these tells what a part has around it, not what it is.
STATES = ("no", "has", "with", "without")

_BLOCKS, _VOIDS, _SCOPES = frozenset(BLOCK), frozenset(VOID), frozenset(SCOPE)
_MARKABLE = _BLOCKS - frozenset([*HEADING, *MAIN, "html", "body"])
#: What is dropped even where a page has no large area outside of dropped parts.
_ALWAYS = frozenset(["template", "svg", "object", "canvas", "nav", "footer", "select", "dialog"])
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_CLOSERS: dict[str, list[str]] = {}
for _open, _starts in IMPLIED.items():
    for _name in _starts:
        _CLOSERS.setdefault(_name, []).append(_open)

_MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*+)|(/))")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?)""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!|;|$)", re.I)
_SPACE = re.compile(r"\s+")


class Token(NamedTuple):
    """A stretch of text (``text``), or a start or end tag; ``why`` tells why a start tag opens a dropped part,
    ``teaser`` whether a main element has the name of something else."""

    name: str = ""
    text: str = ""
    end: bool = False
    closed: bool = False
    why: str = ""
    teaser: bool = False


@lru_cache(maxsize=10_000)
def name_marks(name: str) -> str:
    """'comments', 'marked' or nothing for one class name, id or role in lower case: by its last word but ENDINGS."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    if not words or any(w in STATES for w in words[:-1]):
        return ""
    if any(w in ANYWHERE for w in words):
        return "marked"
    while len(words) > 1 and words[-1] in ENDINGS:
        words.pop()
    return "comments" if words[-1] in COMMENTS else "marked" if words[-1] in MARKED else ""


def _marks(attributes: dict[str, str]) -> str:
    found = {name_marks(n) for key in ("class", "id", "role") for n in attributes.get(key, "").lower().split()}
    return "comments" if "comments" in found else "marked" if "marked" in found else ""


def _why_dropped(name: str, attributes: dict[str, str]) -> str:
    """'element', 'hidden', 'comments', 'marked', or nothing where the part stays."""
    if name not in ("html", "body"):
        hidden = attributes.get("hidden", "until-found").lower() != "until-found" or attributes.get("aria-hidden", "").lower() == "true"
        if hidden or _NO_DISPLAY.search(attributes.get("style", "")):
            return "hidden"
    if name in DROPPED:
        return "element"
    return _marks(attributes) if name in _MARKABLE else ""


def tokens(page: str) -> list[Token]:
    """Text and tags of a page in one pass; comments, declarations and raw elements are left out.

    A comment runs as HTML has it (``<!-->`` is empty), a raw element to its end tag, a tag to the
    ``>`` behind its attributes; what has no end runs to the end of the page.
    """
    found: list[Token] = []
    at = 0
    while (markup := _MARKUP.search(page, at)) is not None:
        if markup.start() > at:
            found.append(Token(text=entities.unescape(page[at : markup.start()])))
        at = markup.end()
        if markup[1]:  # the second dash may belong to the end, as in <!-->
            end = _COMMENT_END.search(page, at)
            at += 1 if page.startswith(">", at) else 2 if page.startswith("->", at) else (end.end() if end else len(page)) - at
            continue
        if markup[2] or markup[5]:
            end_at = page.find(">", at)
            at = end_at + 1 if end_at >= 0 else len(page)
            continue
        attributes: dict[str, str] = {}
        closed = False
        while (part := _ATTRIBUTE.match(page, at)) is not None and not part[1]:
            attributes.setdefault(part[2].lower(), next((v for v in part.groups()[2:] if v is not None), ""))
            at = part.end()
        if part is None:
            return found
        closed, at = page[part.end() - 2] == "/", part.end()
        name = markup[4].lower()
        if markup[3]:
            found.append(Token(name, end=True))
            continue
        attributes = {key: entities.unescape(value).strip() for key, value in attributes.items()}
        if name in _ENDS:
            end = _ENDS[name].search(page, at)
            at = end.start() if end else len(page)
            found.append(Token(name, closed=True))
        else:
            found.append(Token(name, closed=closed, why=_why_dropped(name, attributes), teaser=name in MAIN and bool(_marks(attributes))))
    if at < len(page):
        found.append(Token(text=entities.unescape(page[at:])))
    return found


def part_ends(page: list[Token]) -> dict[int, int]:
    """For each start tag of a dropped part the index of the token behind the part.

    A part ends at its end tag, where its end is implied, or with its parent. One that lacks an
    end tag also ends where the next main element starts.
    """
    ends: dict[int, int] = {}
    open_: list[tuple[str, int]] = []
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    blocks: list[int] = []
    lacking: list[tuple[int, int]] = []

    def pop(end: int, explicit: bool) -> None:
        name, k = open_.pop()
        places[name].pop()
        for held in (scopes, blocks):
            if held and held[-1] == len(open_):
                held.pop()
        if k >= 0:
            ends[k] = end
            if not explicit and name not in IMPLIED:
                lacking.append((k, end))

    def close(name: str, below: int, end: int, explicit: bool) -> None:
        if places.get(name) and places[name][-1] > below:
            place = places[name][-1]
            while len(open_) > place + 1:
                pop(end - explicit, False)
            pop(end, explicit)

    for k, (name, _, end, closed, why, _) in enumerate(page):
        block = name in _BLOCKS or name in DROPPED
        if not name or name in _VOIDS or not (block or why or end):
            continue
        if end:
            own = scopes[-2:-1] if scopes and places.get(name) and places[name][-1] == scopes[-1] else scopes[-1:]
            if name in _SCOPES or name in ("tr", "tbody", "thead", "tfoot", *MAIN, "body", "html"):
                own = []
            close(name, (own or [-1])[0] if block else (blocks or [-1])[-1], k + 1, True)
            continue
        for other in _CLOSERS.get(name, ()):
            limit = [p for p in scopes[-1:] if open_[p][0] not in ("td", "th") or other in ("p", "li", "dt", "dd")]
            close(other, (limit or [-1])[0], k, False)
        if why and closed:
            ends[k] = k + 1
            continue
        places.setdefault(name, []).append(len(open_))
        if name in _SCOPES:
            scopes.append(len(open_))
        if block:
            blocks.append(len(open_))
        open_.append((name, k if why else -1))
    while open_:
        pop(len(page), False)
    following = len(page)
    nexts = {}
    for k in range(len(page) - 1, -1, -1):
        nexts[k] = following
        if page[k].name in MAIN and not page[k].end:
            following = k
    for k, end in lacking:
        ends[k] = min(end, nexts[k])
    return ends


class Line(NamedTuple):
    """A block's text, how much of it is outside links, the main element around it, whether a dropped
    part (else only the border of a main element) lies before it, whether it is a heading, and its last token."""

    text: str
    weight: int
    root: int
    after_part: bool
    heading: bool
    at: int


def page_lines(read: list[Token], ends: dict[int, int], kept: frozenset[int] = frozenset()) -> tuple[list[Line | None], list[int]]:
    """Lines of text in page order, and the parent of each main element (0 is none).

    Markup is stripped and block elements end lines. A dropped part and the border of a main
    element leave WINDOW lines of None, so no window reaches over them. The parts in ``kept``, by
    their start tags, are not dropped.
    """
    lines: list[Line | None] = []
    parents, roots = [0], [0]
    names: list[str] = []
    opened = dict.fromkeys(MAIN, 0)
    piece: list[str] = []
    weight, link, part, heading = 0, False, False, False

    def close() -> None:
        nonlocal weight, part, heading
        text = _SPACE.sub(" ", "".join(piece)).strip()
        if text:
            lines.append(Line(text, min(weight, len(text)), roots[-1], part, heading, k))
            part = False
        piece.clear()
        weight, heading = 0, False

    def gap() -> None:
        if lines and lines[-1] is not None:
            lines.extend([None] * WINDOW)

    k = 0
    while k < len(read):
        name, text, end, _, why, _ = read[k]
        if not name:
            piece.append(text)
            weight += 0 if link else len(text.strip())
        elif why and k not in kept:
            close()
            gap()
            part = True
            k = max(k + 1, ends.get(k, k + 1))
            continue
        elif name in _BLOCKS:
            close()
            heading = name in HEADING and not end
            if name in MAIN:
                gap()
                if not end:
                    parents.append(roots[-1])
                    roots.append(len(parents) - 1)
                    names.append(name)
                    opened[name] += 1
                elif opened[name]:
                    last = ""
                    while last != name:
                        last = names.pop()
                        opened[last] -= 1
                        roots.pop()
        elif name == "br":
            piece.append(" ")
        elif name == "a":
            link = not end
        k += 1
    close()
    return lines, parents


class Area(NamedTuple):
    """The lines between a surge and its dive, and the largest window in between."""

    lines: list[Line]
    peak: int


def areas(lines: list[Line | None]) -> list[Area]:
    """Stretches in which sliding windows of WINDOW lines hold text: from surge to dive.

    The height of a window is its text outside links, or all of its text on a page of links only.
    """
    plain = any(line.weight for line in lines if line)
    found: list[Area] = []
    start = None
    for k, line in enumerate([*lines, None]):
        if line is not None and start is None:
            start = k
        elif line is None and start is not None:
            held = [x for x in lines[start:k] if x]
            sizes = [x.weight if plain else len(x.text) for x in held]
            found.append(Area(held, max(sum(sizes[n : n + WINDOW]) for n in range(len(sizes)))))
            start = None
    return found


def _chosen(found: list[Area], parents: list[int]) -> list[Line]:
    most = max((area.peak for area in found), default=0)
    least = max(min(SURGE, most), most / 5)
    # few lines, such as a title and a sentence, are a part of the article only if they are as much as two thirds of its best
    large = [k for k, area in enumerate(found) if area.peak >= (least if len(area.lines) >= WINDOW or not area.lines[0].root else max(least, most * 2 / 3))]
    if not large:
        return []
    root = [area.lines[0].root for area in found]
    joins = [k > 0 and not area.lines[0].after_part for k, area in enumerate(found)]
    if root[max(large, key=lambda k: found[k].peak)]:
        of_article = {root[k] for k in large if root[k]}
        around: set[int] = set()
        for r in of_article:
            while r and r not in around:
                around.add(r)
                r = parents[r]
        kept = {k for k in range(len(found)) if root[k] in of_article}
        for order, step in ((range(len(found) - 1), 1), (range(len(found) - 1, 0, -1), -1)):
            for k in order:
                if k in kept and root[k + step] in around and joins[max(k, k + step)]:
                    kept.add(k + step)
        out = []
        for k in range(len(found)):
            if k in kept:
                out += found[k].lines
            elif k + 1 in kept and joins[k + 1] and k + 1 in large and root[k] in (0, *around):  # headings right before the article
                n = len(found[k].lines)
                while n and found[k].lines[n - 1].heading:
                    n -= 1
                out += found[k].lines[n:]
        return out
    first, last = large[0], large[-1]
    while first and joins[first] and not root[first - 1]:
        first -= 1
    while last + 1 < len(found) and joins[last + 1] and not root[last + 1]:
        last += 1
    held = [line for k in range(first, last + 1) if not root[k] or found[k].peak >= least for line in found[k].lines]
    if any(line.weight for line in held):  # menus without a mark: links before and behind all text
        while not held[0].weight and not held[0].heading:
            held.pop(0)
        while not held[-1].weight and not held[-1].heading:
            held.pop()
    return held


def _surge_at(lines: list[Line | None], barred: list[tuple[int, int]]) -> int | None:
    """The token at the highest window of the lines outside of ``barred`` stretches; None without a surge."""
    at = [line is not None and not any(a <= line.at < b for a, b in barred) for line in lines]
    sizes = [line.weight if line and good else 0 for line, good in zip(lines, at)]
    best, place, held = 0, None, 0
    for k, size in enumerate(sizes):
        held += size - (sizes[k - WINDOW] if k >= WINDOW else 0)
        if held > best and size:
            best, place = held, lines[k].at
    return place if best >= SURGE else None


def main_text(page: str | None) -> str:
    """The article of one page; its blocks are joined by newlines.

    Sums of text lengths over sliding windows of lines surge where text begins and dive to nothing
    at dropped parts and at the borders of main elements. The stretch between a surge and its dive
    is an area, large if its highest window is a surge and at least a fifth of the page's highest (of few
    lines in a main element: two thirds).
    If the highest is in a main element, the article is every main element with a large area,
    short areas in it included, what borders it in the main elements around, and headings right before it; other main
    elements, such as teasers, go. On other pages it is all from the first to the last large area
    and what borders them with no dropped part between.

    Class words drop a part, but the windows of the whole page, readers' comments left out, overrule them: a part around
    the page's highest window that holds a main element stays, and so does one in a main element with a heading of
    the first level. If nothing that is left has a surge, all parts around the highest window stay,
    asides, forms and headers too; parts beside it still go.
    """
    read = tokens(page or "")
    ends = part_ends(read)
    soft = [k for k in ends if read[k].why == "marked" or read[k].why == "element" and read[k].name not in _ALWAYS]
    kept: frozenset[int] = frozenset()
    around: list[int] = []
    if soft:
        barred = [(k, ends[k]) for k in ends if read[k].why == "comments"]
        surge = _surge_at(page_lines(read, ends, frozenset(soft))[0], barred)
        around = [k for k in soft if surge is not None and k < surge <= ends[k]]
        mains = [k for k, t in enumerate(read) if t.name in MAIN and not t.end and not t.teaser]
        open_, inside = 0, set()
        for k, t in enumerate(read):
            if t.name in MAIN and not t.teaser:
                open_ = max(0, open_ + (-1 if t.end else 1))
            if open_ and k in ends:
                inside.add(k)
        titles = [k for k, t in enumerate(read) if t.name == "h1" and not t.end]
        within = lambda places, k: (n := bisect_left(places, k)) < len(places) and places[n] < ends[k]
        kept = frozenset(k for k in soft if read[k].why == "marked" and ((k in around and within(mains, k)) or (k in inside and within(titles, k))))
    lines, parents = page_lines(read, ends, kept)
    found = areas(lines)
    if around and max((area.peak for area in found), default=0) < SURGE:
        lines, parents = page_lines(read, ends, kept.union(around))
        found = areas(lines)
    return "\n".join(line.text for line in _chosen(found, parents))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch["html"].to_pylist()]
        yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for each row of pages(page_id, url, html, ...).

    Null, empty and text-free pages give an empty text; null ids and urls are kept; repeated rows
    come back as often; other columns, whatever their names, are ignored; an empty table gives no
    rows. Unclosed tags, comments and scripts are read as far as the page goes. Time and memory are
    linear in the length of a page, which is held in memory whole with its tokens.
    """
    kinds = {name: pages.schema[name].dataType.simpleString() for name in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
