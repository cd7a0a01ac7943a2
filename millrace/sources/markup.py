"""Marked-up parts as blocks: a stack of open elements, walked once.

The standard library's parsers give the events (its HTML parser knows void elements, quoted marks and stray signs as browsers do; its
XML parser refuses what is not well formed). What is open when a text comes tells where the text belongs: in a cell before an item,
in an item before a heading or a paragraph. A block keeps its place from when it was opened, a row or an item is numbered within its
block, and a cell within its row, so that cells without text stay where they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, partial
from html.parser import HTMLParser
from itertools import zip_longest
from xml.parsers import expat

from ..functions.text import WHITE
from .model import CodecError

_SPACES = re.compile(r"[ \t\r\n\f]+")


class Blocks:
    """Pieces in the order of their blocks (see ``pieces``), as they are found."""

    def __init__(self) -> None:
        self.found: list[dict] = []
        self.seq = -1

    def next_block(self) -> int:
        self.seq += 1
        return self.seq

    def open(self, t: str, seq: int | None = None, level: int | None = None, row: int = 0, col: int = 0) -> dict:
        piece = {"seq": self.next_block() if seq is None else seq, "t": t, "level": level, "row": row, "col": col, "runs": []}
        self.found.append(piece)
        return piece

    def picture(self, data: bytes | None, mime: str | None, alt: str = "") -> dict:
        piece = self.open("img")
        piece.update(data=data, mime=mime, alt=alt)
        return piece

    def done(self, trim: bool) -> list[dict]:
        """What has text, is a cell or a picture."""
        out = []
        for p in self.found:
            p["runs"] = (trimmed(p["runs"]) if trim else p["runs"]) or [{"text": "", "b": False, "i": False}]
            if p["t"] in ("img", "table") or any(r["text"].strip(WHITE) for r in p["runs"]):
                out.append(p)
        return out


def add(piece: dict, text: str, b: bool, i: bool) -> None:
    """Put a text into a piece; neighbours of one style are one run."""
    runs = piece["runs"]
    if runs and (runs[-1]["b"], runs[-1]["i"]) == (b, i):
        runs[-1]["text"] += text
    else:
        runs.append({"text": text, "b": b, "i": i})


def trimmed(runs: list[dict]) -> list[dict]:
    """Runs without the white space before the first and after the last sign."""
    if len(runs) == 1:
        kept = runs[0]["text"].strip(WHITE)
        return [{**runs[0], "text": kept}] if kept else []
    text = "".join(r["text"] for r in runs)
    low, high, at, out = len(text) - len(text.lstrip(WHITE)), len(text.rstrip(WHITE)), 0, []
    for r in runs:
        kept = r["text"][max(0, low - at) : max(0, high - at)]
        at += len(r["text"])
        if kept:
            out.append({**r, "text": kept})
    return out


_PARTS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "body", "blockquote", "pre", "figure", "figcaption", "hr", "dl", "dt", "dd", "address", "aside", "form", "caption"}
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_UNSEEN = {"script", "style", "head", "title", "template", "noscript"}


class Html(HTMLParser):
    """Blocks of a page. Lists within lists go on in the outer one, tables within cells in the cell; pictures keep their source in ``mime``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks = Blocks()
        self.piece: dict | None = None  # the open paragraph or heading
        self.cell: dict | None = None
        self.unseen: list[str] = []
        self.lists: list[str] = []
        self.list_at, self.item, self.entry = 0, -1, None
        self.tables, self.table_at, self.row, self.col = 0, 0, -1, -1
        self.head_cell = False
        self.bold = self.slanted = 0
        self.new_row = False

    def _end_part(self) -> None:
        """A block boundary within a cell or an item is a space."""
        inner = self.cell if self.cell is not None else self.entry
        if inner is not None and inner["runs"] and not inner["runs"][-1]["text"].endswith((" ", "\n")):
            add(inner, " ", inner["runs"][-1]["b"], inner["runs"][-1]["i"])
        self.piece = None

    def handle_starttag(self, tag: str, attrs: list | dict) -> None:
        if tag in _UNSEEN:
            self.unseen.append(tag)
        elif tag == "body":
            self.unseen.clear()
        if self.unseen:
            return
        if tag in ("b", "strong"):
            self.bold += 1
        elif tag in ("i", "em"):
            self.slanted += 1
        elif tag == "table":
            self._end_part()
            self.tables += 1
            if self.tables == 1:
                self.table_at, self.row, self.cell, self.new_row = self.blocks.next_block(), -1, None, True
        elif self.tables == 1 and tag == "tr":
            self.cell, self.new_row = None, True
        elif self.tables == 1 and tag in ("td", "th"):
            if self.new_row:
                self.row, self.col, self.new_row = self.row + 1, -1, False
            self.col, self.head_cell = self.col + 1, tag == "th"
            self.cell = self.blocks.open("table", self.table_at, row=self.row, col=self.col)
        elif self.cell is None and tag in ("ul", "ol"):
            self._end_part()
            if not self.lists:
                self.list_at, self.item = self.blocks.next_block(), -1
            self.lists.append(tag)
            self.entry = None
        elif self.cell is None and tag == "li" and self.lists:
            self._new_item()
        elif tag == "img":
            given = dict(attrs)
            self.blocks.picture(None, given.get("src") or "", given.get("alt") or "")
            self.piece = None
        elif tag == "br":
            self._text("\n")
        elif tag in _HEADINGS and self.cell is None and self.entry is None:
            self.piece = self.blocks.open("h", level=_HEADINGS[tag])
        elif tag in _PARTS or tag in _HEADINGS or tag in ("li", "ul", "ol", "tr", "td", "th"):
            self._end_part()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in ("br", "img", "hr", "meta", "link", "input"):
            self.handle_endtag(tag)

    def _new_item(self) -> None:
        self.item += 1
        self.entry = self.blocks.open(self.lists[0], self.list_at, row=self.item)

    def handle_endtag(self, tag: str) -> None:
        if self.unseen:
            if tag in self.unseen:
                del self.unseen[self.unseen.index(tag) :]
            return
        if tag in ("b", "strong"):
            self.bold = max(0, self.bold - 1)
        elif tag in ("i", "em"):
            self.slanted = max(0, self.slanted - 1)
        elif tag == "table" and self.tables:
            self.tables -= 1
            if not self.tables:
                self.cell = None
            self._end_part()
        elif tag in ("td", "th") and self.tables == 1:
            self.cell = None
        elif tag in ("ul", "ol") and self.lists and self.cell is None:
            self.lists.pop()
            if not self.lists:
                self.entry = None
            self.piece = None
        elif tag in _PARTS or tag in _HEADINGS or tag == "li":
            self._end_part()

    def handle_data(self, data: str) -> None:
        if not self.unseen:
            self._text(_SPACES.sub(" ", data))

    def _text(self, text: str) -> None:
        bold = self.bold > 0
        if self.cell is not None:
            into, bold = self.cell, bold or self.head_cell
        elif self.lists:
            if self.entry is None:
                if not text.strip(WHITE):
                    return
                self._new_item()
            into = self.entry
        else:
            if self.piece is None:
                if not text.strip(WHITE):
                    return
                self.piece = self.blocks.open("p")
            into = self.piece
        if into["runs"] and into["runs"][-1]["text"].endswith((" ", "\n")):
            text = text.lstrip(" ")
        if text:
            add(into, text, bold, self.slanted > 0)


def html_blocks(text: str) -> list[dict]:
    page = Html()
    page.feed(text)
    page.close()
    return page.blocks.done(trim=True)


#: References that mean the same in XML and in HTML, and any other.
_OTHER_REFERENCE = re.compile("&(?!(?:amp|lt|gt|quot|apos);)")


def _parser(encoding: str | None, size: int):
    """An XML parser that gives a text in one part. Entities of its own are refused, as a few bytes of them can stand for very many."""
    parser = expat.ParserCreate(encoding)

    def refused(*_: object) -> None:
        raise CodecError("xml-corrupt")

    parser.EntityDeclHandler = refused
    parser.buffer_text = True
    parser.buffer_size = max(1, min(size, 1 << 24))
    return parser


#: A text between two tags.
_BETWEEN = re.compile(">([^<>]+)<")
#: Stretches of markup remembered by a walker and the signs of one at most; new ones in a part after which the parser walks all of it.
_MOST_KNOWN, _LONGEST, _MOST_NEW = 4096, 2048, 32
#: Bytes that no XML has, and line ends that the parser changes.
_CONTROLS = bytes(k for k in range(32) if k not in (9, 10))


class _Place:
    """Elements that are open, and what stretches of markup are after them: events, and the place that follows."""

    __slots__ = ("known", "last", "open")

    def __init__(self, names: tuple[str, ...]) -> None:
        self.open, self.known, self.last = names, {}, {}


class Walker:
    """The XML parser's events, with names as ``named`` has them and tags as far as they are in ``starts`` and ``ends`` (all, if these are none).

    Parts that a program wrote have the same few stretches of markup between their texts. What the parser makes of a stretch depends on the elements that are open before it and on nothing
    else, as long as there are no own declarations; so that is remembered, and a part of known stretches costs its texts. All other parts, the broken ones too, are walked by the parser."""

    def __init__(self, encoding: str | None, named: Callable[[str], str], starts: frozenset[str] | None = None, ends: frozenset[str] | None = None) -> None:
        self.encoding, self.named, self.starts, self.ends = encoding, named, starts, ends
        self.forget()

    def forget(self) -> None:
        self.root, self.places, self.held = _Place(()), {}, 0

    def walk(self, data: bytes, start: dict[str, Callable[[dict], None]], end: dict[str, Callable[[], None]], text: Callable[[str], None]) -> None:
        found = self._remembered(data)
        if found is None:
            parser = _parser(self.encoding, len(data))
            self._handled(parser, lambda name, attrs: start[name](attrs), lambda name: end[name](), text)
            try:
                parser.Parse(data, True)
            except (expat.ExpatError, ValueError, LookupError):
                raise CodecError("xml-corrupt") from None
            return
        stretches, texts = found
        for events, between in zip_longest(stretches, texts):
            for name, attrs in events:
                if attrs is None:
                    end[name]()
                elif name is None:
                    text(attrs)
                else:
                    start[name](attrs)
            if between is not None:
                text(between)

    def _handled(self, parser, begun: Callable, ended: Callable, text: Callable | None) -> None:
        named, starts, ends = self.named, self.starts, self.ends

        def start(raw: str, attrs: dict) -> None:
            name = named(raw)
            if starts is None or name in starts:
                begun(name, {named(k): v for k, v in attrs.items()} if attrs else attrs)

        def end(raw: str) -> None:
            name = named(raw)
            if ends is None or name in ends:
                ended(name)

        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text

    def _remembered(self, data: bytes) -> tuple[list[list], list[str]] | None:
        """Events of each stretch of markup and the texts between them; none if the parser has to see the whole."""
        try:
            whole = data.decode()
        except UnicodeDecodeError:
            return None
        parts = _BETWEEN.split(whole)
        if len(parts) == 1 or len(data.translate(None, _CONTROLS)) < len(data) or (not data.isascii() and ("\ufffe" in whole or "\uffff" in whole)):
            return None
        texts = parts[1::2]
        if "&" in whole:
            if _OTHER_REFERENCE.search(whole):
                return None
            texts = [_plain(t) if "&" in t else t for t in texts]
        if self.held >= _MOST_KNOWN:
            self.forget()
        place, new, out, last = self.root, 0, [], len(parts) - 1
        for k in range(0, last + 1, 2):
            stretch = parts[k]
            step = (place.known if k < last else place.last).get(stretch)
            if step is None:
                new += 1
                step = self._learned(place, stretch, k == last) if new <= _MOST_NEW else None
                if step is None:
                    return None
            events, place = step
            out.append(events)
        return out, texts

    def _learned(self, place: _Place, stretch: str, last: bool) -> tuple[list, _Place] | None:
        first = place is self.root
        if not first and ("<!" in stretch or "<?" in stretch or stretch[:1] in "!?"):
            return None
        full = ("" if first else "<") + stretch + ("" if last else ">")
        parser = _parser(self.encoding, len(full) + 1)
        if place.open:
            parser.Parse("".join(f"<{name}>" for name in place.open), False)
        events: list[tuple] = []
        names, after = list(place.open), []

        def own(*told: object) -> None:
            raise CodecError("xml-corrupt")

        parser.XmlDeclHandler = lambda version, encoding, alone: own() if self.encoding is None and (encoding or "utf-8").lower() != "utf-8" else None
        parser.StartDoctypeDeclHandler = lambda name, system, public, declares: own() if declares or system or public else None
        self._handled(parser, lambda name, attrs: events.append((name, attrs)), lambda name: events.append((name, None)), lambda text: events.append((None, text)))
        start, end = parser.StartElementHandler, parser.EndElementHandler
        parser.StartElementHandler = lambda raw, attrs: (names.append(raw), start(raw, attrs))
        parser.EndElementHandler = lambda raw: (names.pop(), end(raw))
        try:
            parser.Parse(full.encode(), last)
            if not last:
                # a tag that follows at once shows that the stretch is over where it ends
                parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = (lambda raw, attrs: after.append(raw)), None, own
                parser.Parse(b"<end/>", False)
        except (CodecError, expat.ExpatError, ValueError, LookupError):
            return None
        if not last and (after != ["end"] or not names or len(names) > _LONGEST):
            return None
        if last:
            step = events, self.root
        else:
            key = tuple(names)
            step = events, self.places.setdefault(key, _Place(key))
        if len(stretch) <= _LONGEST:
            (place.last if last else place.known)[stretch] = step
            self.held += 1
        return step


def _plain(text: str) -> str:
    """A text without references."""
    return text.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&apos;", "'").replace("&amp;", "&")


class _Each(dict):
    """Handlers of one function for tags of every name."""

    def __init__(self, handle: Callable[..., None]) -> None:
        self.handle = handle

    def __missing__(self, name: str) -> Callable[..., None]:
        found = self[name] = partial(self.handle, name)
        return found


_XHTML = Walker("utf-8", str.lower)


def xhtml_blocks(data: bytes) -> list[dict]:
    """Blocks of a page that should be XML. If it is well formed the XML parser walks it, else, or if it has other signs by name or number, the parser of pages does."""
    if b"&" in data and _OTHER_REFERENCE.search(data.decode("utf-8", "replace")):
        return html_blocks(data.decode("utf-8", "replace"))
    page = Html()
    try:
        _XHTML.walk(data, _Each(page.handle_starttag), _Each(page.handle_endtag), page.handle_data)
    except CodecError:
        return html_blocks(data.decode("utf-8", "replace"))
    return page.blocks.done(trim=True)


@lru_cache(4096)
def _local(name: str) -> str:
    return name.rpartition(":")[2]


@lru_cache(64)
def _walker(starts: tuple[str, ...], ends: tuple[str, ...]) -> Walker:
    return Walker(None, _local, frozenset(starts), frozenset(ends))


def _unheard(text: str) -> None:
    pass


def xml_events(data: bytes, start: dict[str, Callable[[dict], None]], end: dict[str, Callable[[], None]] | None = None, text: Callable[[str], None] | None = None) -> None:
    """Walk an XML part with handlers by local name; what no handler is for is passed over."""
    end = end or {}
    _walker(tuple(start), tuple(end)).walk(data, start, end, text or _unheard)


class Word:
    """Blocks of the main part of a word-processing file; ``pictures`` has data and type by relationship."""

    def __init__(self, pictures: dict[str, tuple[bytes, str]]):
        self.blocks, self.pictures = Blocks(), pictures
        self.body = False
        self.tables = 0
        self.table_at, self.row, self.col = 0, -1, -1
        self.cell: dict | None = None
        self.list_kind, self.list_at, self.item = None, 0, -1
        self.runs: dict = {"runs": []}
        self.style, self.number, self.drawn = "", None, []
        self.bold = self.slanted = self.in_text = self.in_run_style = False

    def walk(self, data: bytes) -> None:
        start = {
            "body": self._body, "tbl": self._table, "tr": self._table_row, "tc": self._table_cell, "p": self._begin, "pStyle": self._styled, "numId": self._numbered, "r": self._run, "rPr": self._run_style,
            "b": self._bold, "i": self._slanted, "t": self._text_on, "tab": lambda attrs: self._space("\t", attrs), "br": lambda attrs: self._space("\n", attrs), "cr": lambda attrs: self._space("\n", attrs), "blip": self._picture,
        }
        xml_events(data, start, {"t": self._text_off, "rPr": self._run_style_off, "tbl": self._table_off, "tc": self._cell_off, "p": self._paragraph}, self.text)

    def _body(self, attrs: dict) -> None:
        self.body = True

    def _table(self, attrs: dict) -> None:
        self.tables += 1
        if self.tables == 1:
            self.list_kind, self.table_at, self.row = None, self.blocks.next_block(), -1

    def _table_row(self, attrs: dict) -> None:
        if self.tables == 1:
            self.row, self.col = self.row + 1, -1

    def _table_cell(self, attrs: dict) -> None:
        if self.tables == 1:
            self.col += 1
            self.cell = self.blocks.open("table", self.table_at, row=max(self.row, 0), col=self.col)

    def _begin(self, attrs: dict) -> None:
        self.runs, self.style, self.number, self.drawn = {"runs": []}, "", None, []

    def _styled(self, attrs: dict) -> None:
        self.style = attrs.get("val", "")

    def _numbered(self, attrs: dict) -> None:
        self.number = attrs.get("val", "")

    def _run(self, attrs: dict) -> None:
        self.bold = self.slanted = False

    def _run_style(self, attrs: dict) -> None:
        self.in_run_style = True

    def _on(self, attrs: dict) -> bool:
        return attrs.get("val", "1").lower() not in ("0", "false", "none", "off")

    def _bold(self, attrs: dict) -> None:
        if self.in_run_style:
            self.bold = self._on(attrs)

    def _slanted(self, attrs: dict) -> None:
        if self.in_run_style:
            self.slanted = self._on(attrs)

    def _text_on(self, attrs: dict) -> None:
        self.in_text = True

    def _space(self, sign: str, attrs: dict) -> None:
        if self.body and not self.in_run_style and "pos" not in attrs:
            add(self.runs, sign, self.bold, self.slanted)

    def _picture(self, attrs: dict) -> None:
        if attrs.get("embed") in self.pictures:
            self.drawn.append(attrs["embed"])

    def text(self, data: str) -> None:
        if self.in_text:
            add(self.runs, data, self.bold, self.slanted)

    def _text_off(self) -> None:
        self.in_text = False

    def _run_style_off(self) -> None:
        self.in_run_style = False

    def _table_off(self) -> None:
        self.tables -= 1
        if not self.tables:
            self.cell = None

    def _cell_off(self) -> None:
        if self.tables == 1:
            self.cell = None

    def _paragraph(self) -> None:
        runs = self.runs["runs"]
        full = any(r["text"].strip(WHITE) for r in runs)
        if self.cell is not None:
            if self.cell["runs"] and full:
                add(self.cell, " ", False, False)
            for r in runs:
                add(self.cell, r["text"], r["b"], r["i"])
        elif full:
            heading = self.style and re.fullmatch(r"(?i)heading\s*([1-6])", self.style)
            named = self.style and re.fullmatch(r"List(Bullet|Number)\d*", self.style, re.I)
            kind = None if heading else ("ol" if self.number == "2" else "ul") if self.number is not None else ("ol" if named[1].lower() == "number" else "ul") if named else None
            if kind is None:
                piece = self.blocks.open("h" if heading else "p", level=int(heading[1]) if heading else None)
            else:
                if kind != self.list_kind:
                    self.list_at, self.item = self.blocks.next_block(), -1
                self.item += 1
                piece = self.blocks.open(kind, self.list_at, row=self.item)
            piece["runs"], self.list_kind = runs, kind
        for name in self.drawn:
            self.list_kind = None
            self.blocks.picture(*self.pictures[name])
        self.runs, self.drawn = {"runs": []}, []


def word_blocks(data: bytes, pictures: dict[str, tuple[bytes, str]]) -> list[dict]:
    word = Word(pictures)
    word.walk(data)
    if not word.body:
        raise CodecError("docx-corrupt")
    return word.blocks.done(trim=False)
