"""HTML to leaf blocks: runs of text between block-level tags, each with the path of tags above it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

#: Elements that stay inside a line of text; all others end a block. Fixed values of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe".split())
#: Elements with elements in them whose text is none of the page. One that isn't closed ends with the element around it.
MUTED = frozenset("svg object select annotation annotation-xml".split())
#: Within these, elements start no block.
ZONES = MUTED | {"math"}
FOREIGN = ("svg", "math")
#: Elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An element of the same kind, or one of these, ends an open one up to its container.
ENDS_SAME = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+|[0-9]+")


class Step:
    """An element of a path, linked to the one above it: its name and the parts of its class, id and role. Blocks share what is above them, so that deep
    pages don't copy it. `sums` is room for what a reader adds up along the path."""

    __slots__ = ("above", "names", "sums")

    def __init__(self, above: Step | None, names: tuple[str, ...]):
        self.above, self.names, self.sums = above, names, None

    def nearest(self, n: int) -> list[Step]:
        out, at = [], self
        while at is not None and len(out) < n:
            out.append(at)
            at = at.above
        return out


@dataclass
class Block:
    text: str
    path: Step | None
    linked: int


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    parts: list[str] = []
    if attributes:
        for m in _NAMED.finditer(attributes):
            parts += _PART.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[2] or m[3] or m[4] or "").lower())
    return (tag, *parts)


class _Tags:
    """Finds markup from left to right; whatever is never closed costs one look at the rest of the page, not one for each tag."""

    def __init__(self, page: str):
        self.page = page
        self.close = -2  # the next >, if it isn't behind
        self.none: set[str] = set()  # what there is no more of
        self.quotes = True

    def _next_close(self, at: int) -> int:
        if self.close != -1 and self.close < at:
            self.close = self.page.find(">", at)
        return self.close

    def _find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def _tag_end(self, at: int) -> int:
        """The > that ends a tag: not one within quotes; where that leads to no end at all, quotes mean nothing from there on."""
        if self._next_close(at) < 0:
            return -1
        i = at
        while self.quotes:
            m = _STOP.search(self.page, i)
            if m is None:
                self.quotes = False
                break
            if m[0] == ">":
                return m.start()
            end = self._find(m[0], m.end())
            i = m.end() if end < 0 else end + 1
        return self._next_close(at)

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """(begin, end, kind, name, attributes) of the next markup: kind is open, close or other; begin is the page's end if there is none."""
        page, n = self.page, len(self.page)
        while (lt := page.find("<", at)) >= 0:
            after = page[lt + 1 : lt + 2]
            if page.startswith("<!--", lt):
                end = self._find("-->", lt + 4)
                return lt, n if end < 0 else end + 3, "other", "", ""
            if after in ("!", "?"):
                if (end := self._next_close(lt)) >= 0:
                    return lt, end + 1, "other", "", ""
            elif after == "/":
                if (m := _NAME.match(page, lt + 2)) and (end := self._next_close(m.end())) >= 0:
                    return lt, end + 1, "close", m[0].lower(), ""
            elif after and (m := _NAME.match(page, lt + 1)) and (end := self._tag_end(m.end())) >= 0:
                return lt, end + 1, "open", m[0].lower(), page[m.end() : end]
            at = lt + 1
            if self.close == -1:  # no tag can end any more
                at = page.find("<!--", at)
                if at < 0:
                    break
        return n, n, "", "", ""


class _Open:
    """Open elements, with the places of each name: closing looks at no others."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, Step | None]] = []
        self.places: dict[str, list[int]] = {}
        self.links = self.muted = 0

    def zone(self) -> int:
        """The place of the outermost open element of ZONES; -1 if there is none."""
        return min((self.places[x][0] for x in ZONES if self.places.get(x)), default=-1)

    def push(self, name: str, attributes: str) -> None:
        above = self.stack[-1][1] if self.stack else None
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, above if name in INLINE else Step(above, _names(name, attributes))))
        self.links += name == "a"
        self.muted += name in MUTED

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def _last(self, names: tuple[str, ...] | frozenset[str]) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=-1)

    def pop(self, names: tuple[str, ...], stop: tuple[str, ...] = ()) -> None:
        """Closes the last element of these names and all in it, unless a stop is open within it."""
        at = self._last(names)
        if at < 0 or at < self._last(stop):
            return
        for name, _ in self.stack[at:]:
            self.places[name].pop()
            self.links -= name == "a"
            self.muted -= name in MUTED
        del self.stack[at:]


def blocks(page: str) -> list[Block]:
    """Blocks in page order; white space in each is one space. Blocks without text are left out. Takes time in proportion to the page, whatever its markup."""
    out: list[Block] = []
    tags, open_ = _Tags(page), _Open()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if text:
            body = " ".join(html.unescape("".join(text)).split())
            if body:
                out.append(Block(body, open_.stack[-1][1] if open_.stack else None, min(linked, len(body))))
            text.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        begin, end, kind, name, attributes = tags.next(at)
        if begin > at and not open_.muted:
            text.append(page[at:begin])
            if open_.links:
                linked += begin - at
        at = end
        zone = open_.zone() if kind in ("open", "close") else -1
        if kind == "close":
            within = zone >= 0 and (not open_.has(name) or open_.places[name][-1] >= zone)
            if name not in INLINE and not within or name in ("object", "select"):
                flush()
            if name == "p" and not open_.has("p"):
                continue
            open_.pop((name,), () if name in INLINE else ("html",))
        elif kind == "open":
            if name in RAW:
                ended = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = ended.end() if ended else n
                if name not in ("script", "style", "template") and zone < 0:
                    flush()
                continue
            closed = attributes.rstrip().endswith("/")
            if zone >= 0 and (name in ENDS_P or name == "li") and open_.stack[zone][0] in FOREIGN and not any(open_.has(x) for x in ("foreignobject", "object", "select", "annotation-xml")):
                open_.pop((open_.stack[zone][0],))  # page elements end drawings and formulas that were left open
                zone = open_.zone()
            if zone >= 0 or name in FOREIGN:
                if name not in VOID and not closed:
                    open_.push(name, attributes)
                continue
            if name in VOID:
                if name in ("br", "hr"):
                    flush() if name == "hr" else text.append(" ")
                continue
            if name not in INLINE:
                flush()
                if name in ENDS_P:
                    open_.pop(("p",), ("button", "td", "th", "li"))
                elif name in ENDS_SAME:
                    open_.pop(*ENDS_SAME[name])
            if not closed or name in INLINE:
                open_.push(name, attributes)
    flush()
    return out
