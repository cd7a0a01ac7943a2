"""PDF writer: the pieces of a file are gathered by one shuffle; in the task that holds them runs are measured and wrapped into lines, lines become boxes, boxes are dealt to pages, and objects put into the file.

A box is what stays on one page: a line of text, a row of a table with its rules, or a picture. Runs keep their faces (regular, bold, slanted, both) within a line. Texts are in the
standard faces and their code page. JPEG bytes are passed through, PNG rows as they are compressed; a PNG with alpha is flattened on white.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glyphs import HIGH, WIDTHS
from ..functions.text import WHITE
from .media import jpeg_size, png_parts, png_rows, png_size
from .pieces import picture_label

# An A4 page in points, its margin, and sizes of text.
PAGE_WIDTH, PAGE_HEIGHT, MARGIN = 595, 842, 72
TEXT_SIZE, HEADING_SIZES, LEADING = 11, {1: 20, 2: 16}, 1.35
#: Lines of one paragraph are at most this far apart, paragraphs at least BEFORE more (see ``layout.PARAGRAPH_GAP``).
MOST_LEADING, BEFORE, CELL_PAD = 20, 12, 4
FACES = ["Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"]
#: Bold letters are wider; lines are wrapped as if by this much.
_BOLD = 1.1
_ROOM_X, _ROOM_Y = PAGE_WIDTH - 2 * MARGIN, PAGE_HEIGHT - 2 * MARGIN


_WORDS = re.compile(f"[^{re.escape(WHITE)}]+")


class _CodePage(dict):
    """What ``str.translate`` makes of a character: the one of its byte in the code page, or a question mark."""

    def __missing__(self, code: int) -> int:
        self[code] = code if code < 256 else ord("?")
        return self[code]


_PAGE = _CodePage({ord(sign): byte for byte, sign in HIGH.items()})


def _coded(text: str) -> str:
    return text if text.isascii() else text.translate(_PAGE)


@lru_cache(1 << 16)
def _wide(word: str) -> int:
    """Width of a word in thousandths of its size."""
    return sum(map(WIDTHS.__getitem__, _coded(word).encode("latin-1")))


def _tokens(runs: list[dict], bold: bool) -> Iterator[tuple[str, int, bool, float]]:
    """Words of runs: text, face, whether the word goes on in the one before, and its width."""
    before = " "
    for r in runs:
        text = r["text"] or ""
        joined = bool(before) and before[-1] not in WHITE and bool(text) and text[0] not in WHITE
        face = int(bool(r["b"]) or bold) + 2 * int(bool(r["i"]))
        scale = _BOLD if face % 2 else 1.0
        for word in _WORDS.findall(text):
            yield word, face, joined, _wide(word) * scale
            joined = False
        before = text


def _wrapped(tokens: Iterable[tuple[str, int, bool, float]], room: float) -> list[list[tuple[int, str]]]:
    """Lines (face and text of their segments) of tokens, in thousandths of their size; at least one line."""
    done: list[list[tuple[int, list[str]]]] = [[]]
    wide = 0.0
    for word, face, glued, size in tokens:
        line = done[-1]
        gap = 0.0 if glued or not line else 278.0
        if line and wide + gap + size > room:
            done.append([(face, [word])])
            wide = size
            continue
        if gap:
            word = " " + word
        if line and line[-1][0] == face:
            line[-1][1].append(word)
        else:
            line.append((face, [word]))
        wide = wide + gap + size
    return [[(face, "".join(words)) for face, words in line] for line in done]


def _shown(segments: list[tuple[int, str]], size: int) -> str:
    """Operators that show the segments of a line, face after face."""
    escaped = ((face, _coded(text).replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")) for face, text in segments)
    return "".join(f"/F{face + 1} {size} Tf ({text}) Tj " for face, text in escaped)


class _Piece(NamedTuple):
    """What a page needs of a piece."""

    t: str
    row: int
    col: int
    lead: float
    lines: list[str]
    columns: int
    data: bytes | None
    w: float | None
    h: float | None


def _measured(p: dict, columns: int) -> _Piece:
    """A piece with the distance of its lines, and its lines as operators."""
    size = {1: HEADING_SIZES[1], 2: HEADING_SIZES[2]}.get(p["level"], 13) if p["t"] == "h" else TEXT_SIZE
    room = (_ROOM_X / columns - 2 * CELL_PAD if p["t"] == "table" else _ROOM_X) * 1000.0 / size
    lines = [_shown(line, size) for line in _wrapped(_tokens(p["runs"] or [], p["t"] == "h"), room)]
    return _Piece(p["t"], p["row"], p["col"], float(min(math.ceil(size * LEADING), MOST_LEADING)), lines, columns, p["data"], p["w"], p["h"])


def gathered(pieces: DataFrame) -> DataFrame:
    """(file_id, pieces): those of a file in order, with the signs of items and the width and height of pictures."""
    marked = F.when(F.col("t") == "ol", F.concat((F.col("row") + 1).cast("string"), F.lit(". "))).when(F.col("t") == "ul", "• ").when(F.col("t") == "img", picture_label(F.coalesce("alt", F.lit(""))))
    runs = F.when(marked.isNotNull(), F.concat(F.array(F.struct(marked.alias("text"), F.lit(False).alias("b"), F.lit(False).alias("i"))), F.col("runs"))).otherwise(F.col("runs"))
    own = F.when(F.col("t") == "img", F.coalesce(png_size(F.col("data")), jpeg_size(F.col("data"))))
    w, h = own["width"] * 0.75, own["height"] * 0.75
    scale = F.least(F.lit(1.0), _ROOM_X / F.greatest(w, F.lit(1.0)), (_ROOM_Y / 2.0) / F.greatest(h, F.lit(1.0)))
    told = pieces.select("file_id", "seq", "row", "col", "t", "level", runs.alias("runs"), "data", (w * scale).alias("w"), (h * scale).alias("h"))
    return told.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in told.columns if c != "file_id")))).alias("pieces"))


class _Box(NamedTuple):
    """What stays on one page."""

    before: float
    high: float
    texts: list  # x, baseline from the top, operators
    columns: int = 0
    picture: tuple | None = None  # data, width, height


def _boxes(pieces: list[dict]) -> Iterator[_Box]:
    """The boxes of a file in order: lines of text, rows of tables, pictures."""
    columns: dict[int, int] = {}
    for p in pieces:
        columns[p["seq"]] = max(columns.get(p["seq"], 0), (p["col"] or 0) + 1)
    for (seq, row), same in groupby(pieces, key=lambda p: (p["seq"], p["row"])):
        cells = [_measured(p, columns[seq]) for p in same]
        c = cells[0]
        if c.t == "table":
            texts = [(MARGIN + x.col * _ROOM_X / c.columns + CELL_PAD, 0.8 * c.lead + k * c.lead + CELL_PAD, line) for x in cells for k, line in enumerate(x.lines)]
            yield _Box(BEFORE if row == 0 else 0, max(len(x.lines) for x in cells) * c.lead + 3 * CELL_PAD, texts, c.columns)
        elif c.t == "img" and c.w is not None:
            yield _Box(BEFORE, c.h, [(MARGIN, 12, c.lines[0])], 0, (c.data, c.w, c.h))
        else:
            yield from (_Box(BEFORE if k == 0 else 0, c.lead, [(MARGIN, 0.8 * c.lead, line)]) for k, line in enumerate(c.lines))


def _image(data: bytes) -> tuple[str, bytes] | None:
    """Head and stream of a picture object; None if the bytes cannot be shown as they are."""
    if data[:2] == b"\xff\xd8":
        found = jpeg_frame(data)
        if not found:
            return None
        height, wide, n = found
        return f"/Width {wide}/Height {height}/BitsPerComponent 8/ColorSpace/{ {1: 'DeviceGray', 3: 'DeviceRGB', 4: 'DeviceCMYK'}[n] }/Filter/DCTDecode", data
    png = png_parts(data)
    if png is None:
        return None
    wide, height, bits, kind, laced, palette, body = png
    if laced or kind in (4, 6):
        rows = png_rows(data)
        if rows is None:
            return None
        flat = rows[..., :3].astype("u2") * rows[..., 3:] + 255 * (255 - rows[..., 3:].astype("u2")) + 127
        return f"/Width {wide}/Height {height}/BitsPerComponent 8/ColorSpace/DeviceRGB/Filter/FlateDecode", zlib.compress((flat // 255).astype("u1").tobytes(), 6)
    colours = 3 if kind == 2 else 1
    space = f"[/Indexed/DeviceRGB {len(palette) // 3 - 1}<{palette.hex()}>]" if kind == 3 else "/DeviceRGB" if kind == 2 else "/DeviceGray"
    return f"/Width {wide}/Height {height}/BitsPerComponent {bits}/ColorSpace{space}/Filter/FlateDecode/DecodeParms<</Predictor 15/Colors {colours}/BitsPerComponent {bits}/Columns {wide}>>", body


def jpeg_frame(data: bytes) -> tuple[int, int, int] | None:
    """Height, width and number of colours of the frame of a JPEG."""
    at = 2
    while at + 9 < len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 7 : at + 9], "big"), data[at + 9]
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _file(pieces: list[dict]) -> bytes:
    """The boxes of a file, in order, as pages and objects."""
    pages: list[list[str]] = [[]]
    images: list[tuple[str, bytes]] = []
    used: list[set[int]] = [set()]
    down = 0.0
    for b in _boxes(pieces):
        if pages[-1] and down + b.before + b.high > _ROOM_Y:
            pages.append([])
            used.append(set())
            down = 0.0
        top = PAGE_HEIGHT - MARGIN - down - (b.before if pages[-1] else 0)
        down = PAGE_HEIGHT - MARGIN - top + b.high
        made = _image(b.picture[0]) if b.picture else None
        if made:
            images.append(made)
            used[-1].add(len(images))
            pages[-1].append(f"q {b.picture[1]:.2f} 0 0 {b.picture[2]:.2f} {MARGIN} {top - b.picture[2]:.2f} cm /P{len(images)} Do Q\n")
            continue
        step = _ROOM_X / b.columns if b.columns else 0
        pages[-1] += [f"{MARGIN + k * step:.2f} {top - b.high:.2f} {step:.2f} {b.high:.2f} re S\n" for k in range(b.columns)]
        pages[-1] += [f"BT {x:.2f} {top - y:.2f} Td {shown}ET\n" for x, y, shown in b.texts if shown]
    first = 3 + len(FACES)
    kids = [first + len(images) + 2 * k for k in range(len(pages))]
    fonts = "".join(f"/F{k + 1} {3 + k} 0 R" for k in range(len(FACES)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Count {len(pages)}/Kids[{' '.join(f'{k} 0 R' for k in kids)}]>>".encode()]
    objects += [f"<</Type/Font/Subtype/Type1/BaseFont/{face}/Encoding/WinAnsiEncoding>>".encode() for face in FACES]

    def stream(head: str, body: bytes) -> bytes:
        return f"<<{head}/Length {len(body)}>>stream\n".encode() + body + b"\nendstream"

    objects += [stream(f"/Type/XObject/Subtype/Image{head}", body) for head, body in images]
    for k, (page, names) in enumerate(zip(pages, used, strict=True)):
        shown = "".join(f"/P{n} {first + n - 1} 0 R" for n in sorted(names))
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {PAGE_WIDTH} {PAGE_HEIGHT}]/Resources<</Font<<{fonts}>>{f'/XObject<<{shown}>>' if shown else ''}>>/Contents {kids[k] + 1} 0 R>>".encode())
        objects.append(stream("", "".join(page).encode("latin-1", "replace")))
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for k, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    at = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, at))


def write_pdf(pieces: DataFrame) -> DataFrame:
    """(file_id, content) of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, found, at = b.column("file_id"), b.column("pieces"), 0
            while at < b.num_rows:
                first, made, size = at, [], 0
                while at < b.num_rows and size < 1 << 24:
                    made.append(_file(found[at].as_py()))
                    size += len(made[-1])
                    at += 1
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), pa.array(made, pa.binary())], names=["file_id", "content"])

    return gathered(pieces).mapInArrow(run, "file_id string, content binary")
