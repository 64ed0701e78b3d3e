"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped to lines: every block element and line break starts a new one.
A line weighs as many characters as it has outside links; lines of elements that
never hold an article (menus, asides, footers, forms, adverts, comments, hidden
parts) weigh nothing.  The weights of a sliding window of lines are summed up.
Where the sum surges over a threshold the main text begins, where it dives under
it the text ends; what lies between is kept.

Two signs of the markup sharpen the edges.  If a page names its article (an
``article`` or ``main`` element), lines outside weigh nothing, so the surge is its
first line and the dive its last.  Otherwise the innermost element around the heavy
lines of the greatest stretch decides whether a short line beside them, such as a
heading, belongs to them.

Defined results: a null or empty page has the empty text; a page without a line
of weight too; character references are decoded as browsers do; any white space
inside a line counts as one space; unclosed elements, comments and tags end as
browsers let them end, at the latest with the page.  Repeated ids are separate
pages, further columns are ignored and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of one window, the middle one and those beside it.
WINDOW = 3
#: Characters of a window that are a surge; a quarter of the fullest window where a page has less text.
SURGE = 80
#: A further stretch is kept if it has this share of the greatest one.
_STRETCH_SHARE = 4

# Fixed values of the HTML standard: elements by how a browser reads them.
_RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset((
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img math").split())
_CLOSES_ITSELF = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"),
                  "th": ("td", "th"), "option": ("option",)}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_CONTAINERS = frozenset("body div section article main td th center blockquote figure details".split())
_SCOPES = _CONTAINERS | frozenset("nav aside header footer form ul ol dl table tbody thead tr dialog".split())
_NEVER = frozenset((
    "nav aside footer dialog menu noscript template object embed svg canvas audio video map select option datalist "
    "button input head frameset").split())
# Fixed words in the class or id of elements that hold no article, and of readers' comments.
_COMMENT_WORDS = frozenset("comment comments replies respond disqus".split())
_OTHER_WORDS = frozenset((
    "ad ads advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs consent cookie "
    "cookies copyright footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo recommended related share sharing sidebar signup skip social sponsor sponsored subscribe "
    "toolbar").split())
_HEAD_WORDS = frozenset("header masthead".split())
_ROLES = {"navigation": "never", "complementary": "never", "contentinfo": "never", "search": "never",
          "dialog": "never", "alertdialog": "never", "banner": "head", "main": "main", "article": "article"}

_ATTRIBUTES = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?:{_RAW})(?=[\s/>]){_ATTRIBUTES}>
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attributes>{_ATTRIBUTES})>
    |<(?:[!?]|/(?![a-z]))[^>]*+(?:>|\Z)
    |</?[a-z][^>]*+\Z""", re.I | re.S | re.X)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in _RAW.split("|")}
_RAW_NAME = re.compile(rf"<({_RAW})[\s/>]", re.I).match
_ATTRIBUTE = re.compile(
    r"""(?<=[\s"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|\Z)""",
    re.I).findall
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+").findall
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I).search

# What an element tells about the text inside it.
_DROP, _SOFT, _HEAD, _LINK, _ARTICLE, _MAIN = 1, 2, 4, 8, 16, 32


@dataclass
class Line:
    """A line of a page: its text, the characters that count, and where it stands."""

    text: str
    weight: int
    flags: int
    container: int


@dataclass
class _Page:
    """Elements that are open while a page is read, and the lines found so far."""

    soft: bool
    lines: list[Line] = field(default_factory=list)
    #: Open elements: name, flags inside, container.
    stack: list[tuple[str, int, int]] = field(default_factory=lambda: [("", 0, 0)])
    places: dict[str, list[int]] = field(default_factory=dict)
    scopes: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [0])
    articles: int = 0
    _parts: list[str] = field(default_factory=list)
    _linked: int = 0
    _flags: int = 0
    _silent: bool = False

    def text(self, raw: str) -> None:
        _, flags, _ = self.stack[-1]
        if flags & (_DROP | _SOFT | _HEAD):
            self._silent = self._silent or not raw.isspace()
            return
        if "&" in raw:
            raw = unescape(raw)
        if not self._parts:
            self._flags, self._linked = flags, 0
        if flags & _LINK:
            self._linked += len(raw.strip())
        self._parts.append(raw)

    def flush(self) -> None:
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            self.lines.append(Line(text, max(len(text) - self._linked, 0), self._flags, self.stack[-1][2]))
        elif self._silent:
            self.lines.append(Line("", 0, 0, self.stack[-1][2]))
        self._parts.clear()
        self._silent = False

    def open(self, tag: str, attributes: str) -> None:
        if tag not in _INLINE:
            self.flush()
            self._close_implied(tag)
        if tag in _VOID:
            return
        _, flags, container = self.stack[-1]
        flags = self._flags_inside(tag, attributes, flags)
        if tag in _CONTAINERS:
            self.parents.append(container)
            container = len(self.parents) - 1
        if tag in _SCOPES:
            self.scopes.append(len(self.stack))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, flags, container))

    def close(self, tag: str) -> None:
        if tag not in _INLINE:
            self.flush()
        at = self.places.get(tag)
        if at and (tag in _SCOPES or not self.scopes or at[-1] > self.scopes[-1]):
            self._pop(at[-1])

    def _close_implied(self, tag: str) -> None:
        edge = self.scopes[-1] if self.scopes else 0
        ends = _CLOSES_ITSELF.get(tag, ()) + ("p",)
        if tag in ("td", "th", "tr") and self.stack[edge][0] in ("td", "th", "tr"):
            ends, edge = ends + (("td", "th") if tag == "tr" else ()), self._row_edge()
        for name in ends:
            at = self.places.get(name)
            if at and at[-1] > edge:
                self._pop(at[-1])

    def _row_edge(self) -> int:
        """Where the innermost table began: its cells and rows close each other."""
        return max((self.places[n][-1] for n in ("table", "tbody", "thead") if self.places.get(n)), default=0)

    def _pop(self, at: int) -> None:
        for name, _, _ in self.stack[at:]:
            self.places[name].pop()
        del self.stack[at:]
        while self.scopes and self.scopes[-1] >= at:
            self.scopes.pop()

    def _flags_inside(self, tag: str, attributes: str, flags: int) -> int:
        words, role, hidden, body = set(), None, False, False
        if attributes and not attributes.isspace():
            for name, *values in _ATTRIBUTE(attributes):
                name, value = name.lower(), "".join(values)
                if name in ("class", "id"):
                    for part in value.split():
                        found = [w.lower() for w in _NAME_WORDS(part)]
                        if found and found[0] not in ("has", "with", "no", "without"):
                            words.update(found)
                elif name == "role":
                    role = _ROLES.get(value.strip().lower())
                elif name == "itemprop":
                    body = value.strip().lower() == "articlebody"
                else:
                    hidden = hidden or name == "hidden" or (
                        value.strip().lower() == "true" if name == "aria-hidden" else bool(_HIDDEN(value)))
        commented = not words.isdisjoint(_COMMENT_WORDS)
        if (tag == "article" or tag == "main" or role in ("main", "article") or body) and not commented:
            if not flags & _ARTICLE and not flags & _DROP and (tag == "article" or role == "article" or body):
                self.articles += 1
            flags &= ~(_SOFT | _HEAD)  # a page's wrapper may be called anything
            flags |= _MAIN if tag == "main" or role == "main" else _ARTICLE
        elif tag not in ("html", "body"):
            if tag in _NEVER or role == "never" or commented:
                flags |= _DROP
            elif self.soft and (tag == "form" or not words.isdisjoint(_OTHER_WORDS)):
                flags |= _SOFT
            elif self.soft and (tag == "header" or role == "head" or not words.isdisjoint(_HEAD_WORDS)):
                flags |= _HEAD
            if tag == "a":
                flags |= _LINK
            elif tag in _HEADINGS and flags & (_ARTICLE | _MAIN):
                flags &= ~_HEAD  # the headline stands in the article's own header
        return flags | _DROP if hidden else flags


def read_lines(html: str, soft: bool = True) -> _Page:
    """The lines of a page.  Without ``soft`` only what can never be an article is left out."""
    page, at = _Page(soft), 0
    while found := _TOKEN.search(html, at):
        if found.start() > at:
            page.text(html[at:found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if raw := _RAW_NAME(html, found.start()):
                end = _RAW_END[raw[1].lower()].search(html, at)
                at = end.end() if end else len(html)
        elif found["end"]:
            page.close(tag.lower())
        else:
            page.open(tag.lower(), found["attributes"])
    page.text(html[at:])
    page.flush()
    return page


def _stretches(weights: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """From each surge to its dive: first line and the one after the last, without weightless lines at the ends."""
    half, n = window // 2, len(weights)
    sums, total = [], sum(weights[:half])
    for i in range(n):
        total += weights[i + half] if i + half < n else 0
        total -= weights[i - half - 1] if i > half else 0
        sums.append(total)
    threshold = max(1, min(surge, max(sums, default=0) // 4))
    found, first = [], None
    for i, value in enumerate([*sums, 0]):
        if value >= threshold:
            first = i if first is None else first
        elif first is not None:
            held = [k for k in range(first, i) if weights[k]]
            found.append((held[0], held[-1] + 1))
            first = None
    return found


def _innermost(containers: set[int], parents: list[int]) -> int:
    """The innermost container around all; a container has a greater number than the one around it."""
    known, waiting = set(containers), [-c for c in containers]
    heapify(waiting)
    while len(waiting) > 1:
        outer = parents[-heappop(waiting)]
        if outer not in known:
            known.add(outer)
            heappush(waiting, -outer)
    return -waiting[0]


def _all_inside(outer: int, parents: list[int]) -> list[bool]:
    inside = [c == outer for c in range(len(parents))]
    for c in range(outer + 1, len(parents)):
        inside[c] = inside[parents[c]]
    return inside


def main_lines(page: _Page, window: int = WINDOW, surge: int = SURGE) -> list[int]:
    """The numbers of the lines that are the main text."""
    lines = page.lines
    every = sum(line.weight for line in lines)
    for flag, enough in ((_ARTICLE, every // 2 if page.articles > 1 else 0), (_MAIN, 0)):
        # Where the markup names the article its links are part of it.
        weights = [len(line.text) if line.flags & flag else 0 for line in lines]
        if sum(weights) > enough:
            found = _stretches(weights, window, 1)
            return [i for a, b in found for i in range(a, b) if weights[i]]
    weights = [line.weight for line in lines]
    found = _stretches(weights, window, surge)
    if not found:
        return []
    sizes = [sum(weights[a:b]) for a, b in found]
    best = max(range(len(found)), key=sizes.__getitem__)
    kept = {i for (a, b), size in zip(found, sizes) if size * _STRETCH_SHARE >= sizes[best] for i in range(a, b)}
    enough = min(surge, max(weights[slice(*found[best])]))
    heavy = [i for i in range(*found[best]) if weights[i] >= enough]
    inner = _innermost({lines[i].container for i in heavy}, page.parents)
    if inner:
        (first, last), inside = found[best], _all_inside(inner, page.parents)
        kept = {i for i in kept if not first <= i < last or inside[lines[i].container]}
        kept |= {i for i, line in enumerate(lines) if line.weight and inside[line.container]}
    return sorted(i for i in kept if lines[i].text)


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> tuple[str, int, int, int]:
    """Text, number of lines of the page, first and last line of the text (-1 if there is none)."""
    if not html:
        return "", 0, -1, -1
    page = read_lines(html)
    if not any(line.text for line in page.lines):
        page = read_lines(html, soft=False)
    kept = main_lines(page, window, surge)
    text = " ".join(page.lines[i].text for i in kept)
    return text, len(page.lines), *((kept[0], kept[-1]) if kept else (-1, -1))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW,
    surge: int = SURGE,
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_lines, first_line, last_line.  No shuffle."""
    import pyarrow as pa

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(html.as_py(), window, surge) for html in batch.column("html")]
            texts, counts, firsts, lasts = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64()), *[pa.array(c, pa.int32()) for c in (counts, firsts, lasts)]],
                names=["page_id", "url", "text", "n_chars", "n_lines", "first_line", "last_line"])

    return pages.mapInArrow(
        extracted, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint, n_lines int, first_line int, "
                   "last_line int")
