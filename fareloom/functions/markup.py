"""Elements of a saved page: a small reader of nested markup, and Arrow functions around it.

Spark's string functions cannot follow nesting, so the elements of one page are read by plain Python
inside Arrow batches; everything after that is column expressions again.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type as to_spark_type

# Pieces of a page: text, tags, and comments, scripts and styles as wholes.  Case is spelt out (with the four letters that
# case folding takes for i, k and s), which is faster than a flag, and nothing inside a tag is read twice.
_SCRIPT, _STYLE = "[sSſ][cC][rR][iIİı][pP][tT]", "[sSſ][tT][yY][lL][eE]"
_BLOCK = rf"<!--.*?-->|<{_SCRIPT}\b.*?</{_SCRIPT}\s*>|<{_STYLE}\b.*?</{_STYLE}\s*>"
_NAME, _INSIDE = r"[a-zA-ZİıſK][\w:-]*+", r"""(?:[^<>"']++|"[^"]*"|'[^']*')*+"""
_PIECE = re.compile(rf"[^<]+|</?[a-rt-zA-RT-Z][\w:-]*+{_INSIDE}>|{_BLOCK}|</?{_NAME}{_INSIDE}>|<", re.S)
_BLOCK_NAME = re.compile(rf"<(?:{_SCRIPT}|{_STYLE})\b")
_BLOCK, _TAG = re.compile(_BLOCK, re.S), re.compile(f"<(/?)({_NAME})({_INSIDE})>")
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Element:
    __slots__ = ("tag", "raw", "classes", "parent", "text_from", "text_to", "first", "last", "begin", "end")

    def has_class(self, pattern: re.Pattern) -> bool:
        return bool(self.classes) and bool(pattern.search(self.classes))

    def attribute(self, name: str) -> str | None:
        return _attribute_of(self.raw, name)


def _attribute_of(raw: str, name: str) -> str | None:
    """Value of an attribute; null where the tag does not name it."""
    if name not in raw and name not in raw.lower():
        return None
    found = None
    for k, a, b, c in _ATTRIBUTE.findall(raw):
        if k.lower() == name:
            found = unescape(a or b or c or "")
    return found


def _class_of(raw: str) -> str:
    """The class that the attributes of a tag name."""
    found = ""
    for k, a, b, c in _ATTRIBUTE.findall(raw):
        if k.lower() == "class":
            found = unescape(a or b or c or "")
    return found


_SKIP, _TEXT = object(), object()


@lru_cache(maxsize=50_000)
def _markup_of(piece: str):
    """What a piece that begins with "<" is: the name that it closes, or (name, attributes, class, ends at once).
    Tags of a site repeat, so few pieces are looked into."""
    if piece == "<":
        return _TEXT
    if _BLOCK.fullmatch(piece):
        return _SKIP
    closing, tag, attributes = _TAG.fullmatch(piece).groups()
    tag = tag.lower()
    if closing:
        return tag
    return tag, attributes, _class_of(attributes) if "=" in attributes else "", tag in _VOID or attributes.rstrip().endswith("/")


@lru_cache(maxsize=50_000)
def _whole_tag(inside: str) -> str | None:
    """The tag of what stands between "<" and the next ">"; null where it is no tag, or one that does not end there."""
    tag = f"<{inside}>"
    return tag if _TAG.fullmatch(tag) and not _BLOCK_NAME.match(tag) else None


def _plain_pieces(html: str) -> list[str] | None:
    """The pieces of a page that holds text and tags only; null for others."""
    first, *others = html.split("<")
    out = [first] if first else []
    for part in others:
        inside, end, text = part.partition(">")
        tag = _whole_tag(inside) if end else None
        if tag is None:
            found = _TAG.match(f"<{part}")  # a quoted ">"
            if not found or _BLOCK_NAME.match(found.group()):
                return None
            tag, text = found.group(), part[found.end() - 1:]
        out.append(tag)
        if text:
            out.append(text)
    return out


def _pieces(html: str) -> list[str]:
    """The page cut into blocks without offers, tags and texts; all pieces together are the page."""
    plain = _plain_pieces(html)
    if plain is not None:
        return plain
    lowered = html.lower()
    # an opener without its end would be looked for again to the end of the page each time
    last_end = {"<!--": html.rfind("-->"), "<script": lowered.rfind("</script"), "<style": lowered.rfind("</style")}
    if all(lowered.rfind(o) <= last for o, last in last_end.items()):
        return _PIECE.findall(html)
    out, at, size, match = [], 0, len(html), _PIECE.match
    while at < size:
        if html[at] == "<" and html[at + 1:at + 2] in "!sS" and any(
                last < at and lowered.startswith(o, at) for o, last in last_end.items()):
            out.append("<")
        else:
            out.append(match(html, at).group())
        at += len(out[-1])
    return out


class Page:
    """Elements in document order; unclosed ones end with their parent."""

    def __init__(self, html: str):
        self.pieces, self.texts, self.elements = _pieces(html), [], []
        texts, elements, stack = self.texts, self.elements, []

        def close(until: int, end: int):
            n_texts, n_elements = len(texts), len(elements)
            while len(stack) > until:
                e = stack.pop()
                e.text_to, e.last, e.end = n_texts, n_elements, end

        n_texts = n_elements = 0
        for at, piece in enumerate(self.pieces):
            if piece[0] != "<":
                texts.append(unescape(piece) if "&" in piece else piece)
                n_texts += 1
                continue
            kind = _markup_of(piece)
            if kind.__class__ is tuple:
                e = Element()
                e.tag, e.raw, e.classes, alone = kind
                e.begin, e.parent, e.text_from = at, stack[-1] if stack else None, n_texts
                elements.append(e)
                n_elements += 1
                e.first = n_elements
                if alone:
                    e.text_to, e.last, e.end = n_texts, n_elements, at + 1
                else:
                    stack.append(e)
            elif kind is _TEXT:
                texts.append(piece)
                n_texts += 1
            elif kind is not _SKIP:
                if stack and stack[-1].tag == kind:
                    e = stack.pop()
                    e.text_to, e.last, e.end = n_texts, n_elements, at + 1
                    continue
                for k in range(len(stack) - 2, -1, -1):
                    if stack[k].tag == kind:
                        close(k + 1, at)
                        close(k, at + 1)
                        break
        close(0, len(self.pieces))

    def inside(self, e: Element) -> list[Element]:
        return self.elements[e.first:e.last]

    def text(self, e: Element, separator: str | None = None) -> str:
        """All text below; with a separator between the stripped pieces that are not blank."""
        pieces = self.texts[e.text_from:e.text_to]
        if separator is None:
            return "".join(pieces)
        return separator.join(p for p in map(str.strip, pieces) if p)

    def source(self, e: Element) -> str:
        return "".join(self.pieces[e.begin:e.end])


class Found:
    """The elements of a page that are asked for, with all its texts, in one pass over its tags.

    ``kinds`` remembers what the inside of a tag means: what the reader asked for there, the tag, whether it closes and
    whether it ends at once.  Elements begin and end as in ``Page``, which reads the pages that hold more than texts and tags.
    """

    __slots__ = ("texts", "hits")

    def __init__(self, html: str, kinds: dict, asked: Callable[[str, str, str], object]):
        texts: list[str] = []
        hits: list[list] = []  # what was asked for, first text, last text, place after it, last place after it
        self.texts, self.hits = texts, hits
        first, *others = html.split("<")
        if first:
            texts.append(unescape(first) if "&" in first else first)
        tags, open_hits = [], []
        for part in others:
            inside, end, text = part.partition(">")
            kind = kinds.get(inside) if end else None
            if kind is None:
                tag = _whole_tag(inside) if end else None
                if tag is None:
                    found = _TAG.match(f"<{part}")  # a quoted ">"
                    if not found or _BLOCK_NAME.match(found.group()):
                        self._whole(html, asked)
                        return
                    tag, text = found.group(), part[found.end() - 1:]
                kind = _markup_of(tag)
                kind = ((None, kind, True, False) if kind.__class__ is str
                        else (asked(kind[0], kind[2], kind[1]), kind[0], False, kind[3]))
                if len(kinds) > 50_000:
                    kinds.clear()
                if len(tag) == len(inside) + 2:
                    kinds[inside] = kind
            hit, tag, closing, alone = kind
            if closing:
                if tags and tags[-1] == tag:
                    tags.pop()
                    e = open_hits.pop()
                    if e is not None:
                        e[2], e[4] = len(texts), len(hits)
                elif tag in tags:
                    while True:
                        e = open_hits.pop()
                        if e is not None:
                            e[2], e[4] = len(texts), len(hits)
                        if tags.pop() == tag:
                            break
            elif alone:
                if hit is not None:
                    hits.append([hit, len(texts), len(texts), len(hits) + 1, len(hits) + 1])
            else:
                tags.append(tag)
                if hit is None:
                    open_hits.append(None)
                else:
                    e = [hit, len(texts), 0, len(hits) + 1, 0]
                    hits.append(e)
                    open_hits.append(e)
            if text:
                texts.append(unescape(text) if "&" in text else text)
        for e in open_hits:
            if e is not None:
                e[2], e[4] = len(texts), len(hits)

    def _whole(self, html: str, asked):
        page = Page(html)
        held = [(e, hit) for e in page.elements if (hit := asked(e.tag, e.classes, e.raw)) is not None]
        begins = [e.first - 1 for e, _ in held]
        self.texts = page.texts
        self.hits = [[hit, e.text_from, e.text_to, k + 1, bisect_left(begins, e.last)] for k, (e, hit) in enumerate(held)]

    def text(self, hit: list, separator: str | None = None) -> str:
        """As ``Page.text``."""
        pieces = self.texts[hit[1]:hit[2]]
        if separator is None:
            return "".join(pieces)
        return separator.join([p for p in map(str.strip, pieces) if p])


def innermost(wanted: list[Element]) -> list[Element]:
    """Those of ``wanted`` (in document order) that hold no other one: the next begins after their end."""
    return [e for e, after in zip(wanted, [*wanted[1:], None]) if after is None or after.first > e.last]


def over_pages(read, *fields: pa.Field) -> Callable[[Column], Column]:
    """``read(html)`` gives a list for one page, of texts or of tuples with the named fields; an Arrow
    function of the page column.  The entries of a batch become columns as a whole."""
    entry = pa.struct(fields) if fields else pa.string()

    @F.arrow_udf(to_spark_type(pa.list_(entry)))
    def run(html: pa.Array) -> pa.Array:
        found, ends = [], [0]
        for source in html.to_pylist():
            found += read(source or "")
            ends.append(len(found))
        if fields:
            columns = zip(*found) if found else ((),) * len(fields)
            values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=list(fields))
        else:
            values = pa.array(found, pa.string())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return run


def tagged_cards(html: Column, tag: str, card: str, fallback_id: str | None, fields: dict[str, str]) -> Column:
    """Per card of ``tag`` whose class matches: position, text (pieces apart), and the named fields; if
    there is no such card, elements of that tag whose id matches ``fallback_id``."""
    wanted = re.compile(card)
    by_id = re.compile(fallback_id) if fallback_id else None
    patterns = [re.compile(p) for p in fields.values()]
    kinds: dict[str, tuple] = {}

    def asked(name: str, classes: str, raw: str):
        """(a card by its class, one by its id, the fields that its class belongs to)"""
        mine = name == tag and bool(wanted.search(classes))
        identified = bool(by_id) and name == tag and bool(by_id.search(_attribute_of(raw, "id") or ""))
        shown = tuple(k for k, p in enumerate(patterns) if p.search(classes)) if classes else ()
        return (mine, identified, shown) if mine or identified or shown else None

    def read(source: str):
        page = Found(source, kinds, asked)
        cards = [e for e in page.hits if e[0][0]]
        if not cards and by_id:
            cards = [e for e in page.hits if e[0][1]]
        out = []
        for k, e in enumerate(cards):
            shown: list[str | None] = [None] * len(patterns)
            for x in page.hits[e[3]:e[4]]:
                for f in x[0][2]:
                    if shown[f] is None:
                        shown[f] = page.text(x, "")
            out.append((k, page.text(e, " "), *shown))
        return out

    texts = [pa.field(n, pa.string()) for n in ("text", *fields)]
    return over_pages(read, pa.field("position", pa.int32()), *texts)(html)


def run_on_cards(html: Column, words: tuple[str, ...], shape: str) -> Column:
    """Texts (one run) of the innermost div elements whose class has all ``words`` and whose text has
    the shape."""
    looks = re.compile(shape, re.S)
    kinds: dict[str, tuple] = {}

    def asked(name: str, classes: str, raw: str):
        return True if name == "div" and all(w in classes for w in words) else None

    def read(source: str):
        page = Found(source, kinds, asked)
        cards = [(e, text) for e in page.hits if looks.search(text := page.text(e))]
        return [text.strip() for (e, text), after in zip(cards, [*cards[1:], None]) if after is None or after[0][3] > e[4]]

    return over_pages(read)(html)


def priced_pieces(html: Column, tags: tuple[str, ...], marks: tuple[str, ...]) -> Column:
    """Source of the innermost elements of ``tags`` whose text has all ``marks``."""
    patterns = [re.compile(m) for m in marks]

    def read(source: str):
        page = Page(source)
        hits = [e for e in page.elements if e.tag in tags and all(p.search(page.text(e)) for p in patterns)]
        return [page.source(e) for e in innermost(hits)]

    return over_pages(read)(html)


def chip_cards(html: Column, layout: dict[str, str]) -> Column:
    """Per card: its text, departure and arrival text, whether it is marked sold out, the fare chips with
    the price next to each, and the first price of the card."""
    p = {name: re.compile(v) for name, v in layout.items()}

    def read(source: str):
        page = Page(source)
        cards = [e for e in page.elements if e.tag == "div" and e.has_class(p["card"]) and e.attribute("data-journey-key") is not None]
        out = []
        for k, e in enumerate(cards):
            below = page.inside(e)
            prices = [x for x in below if x.tag == "div" and x.has_class(p["price"])]
            chips = []
            for x in (x for x in below if x.tag == "span" and x.has_class(p["chip"])):
                price, box, climbed = None, x.parent, 0
                while box is not None and climbed < 5 and price is None:
                    if box.tag == "div":
                        climbed += 1
                        own = [y for y in prices if box.first <= y.first - 1 < box.last]
                        if len(own) == 1:
                            price = page.text(own[0], "")
                    box = box.parent
                chips.append({"chip": page.text(x, ""), "price": price})
            low = page.source(e).lower()
            gone = "sold out" in low or "unavailable" in low or any(x.has_class(p["sold_out"]) for x in below)
            side = {n: next((page.text(x, " ") for x in below if x.tag == "div" and x.has_class(p[n])), None)
                    for n in ("departure", "arrival")}
            out.append((k, page.text(e, " "), gone, side["departure"], side["arrival"],
                        page.text(prices[0], "") if prices else None, chips))
        return out

    chip = pa.list_(pa.struct([("chip", pa.string()), ("price", pa.string())]))
    return over_pages(read, *(pa.field(n, t) for n, t in (
        ("position", pa.int32()), ("text", pa.string()), ("sold_out", pa.bool_()), ("departure", pa.string()),
        ("arrival", pa.string()), ("first_price", pa.string()), ("chips", chip))))(html)
