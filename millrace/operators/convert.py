"""Conversion of a table of files: each extension by its reader, each target by its writer, and a code for each file that fails.

The bytes of the files are read once. A mapper deals each row to the reader of its extension and catches what goes wrong with that
row, so that a broken file becomes a row with its code and fails no other; a limit of time holds for each row. What readers find is tagged (pieces, texts that
expressions go on with, glyphs that are laid out by windows) and written once, a folder a tag; all that follows reads
that table, and a file's row in it holds its name, size and code.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions.files import ext_of, out_name
from ..functions.vocab import DEFAULT_QUALITY
from ..sources import formats, packages, pdf, pdfread, raster, readers, rtf, sound, video
from ..sources.model import CodecError
from ..sources.pieces import ARROW, PIECES, as_pieces, assemble, piece_batch, plain_run
from ..sources.shared import saved
from . import layout

#: Seconds that one file may take to be read.
MOST_SECONDS = 600.0


def _text(kind: str) -> Callable[[bytes], list[dict]]:
    """Text in UTF-8 without its mark; bytes that are none become U+FFFD."""
    return lambda content: [{"kind": kind, "body": content.decode("utf-8", "replace").removeprefix("﻿")}]


#: What reads the bytes of a file with an extension: rows with a ``kind`` ("piece" if they have none).
READERS: dict[str, Callable[[bytes], list[dict]]] = {
    ".txt": _text("txt"),
    ".md": _text("md"),
    ".markdown": _text("md"),
    ".rtf": rtf.rich_text,
    ".docx": packages.docx,
    ".epub": packages.epub,
    ".pdf": pdfread.glyphs,
    ".png": raster.probe,
    ".jpg": raster.probe,
    ".jpeg": raster.probe,
    ".wav": sound.probe,
    **dict.fromkeys((".mp4", ".m4v", ".mov", ".webm", ".mkv", ".avi"), video.probe),
}
#: The family of a file by its extension, as far as it can be read.
FAMILIES = {e: "image" if read is raster.probe else "audio" if read is sound.probe else "video" if read is video.probe else "document" for e, read in READERS.items()}

_MORE = {"kind": "string", "page": "int", "x": "double", "y": "double", "body": "string", "name": "string", "size": "long", "code": "string"}
_KINDS = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "long": pa.int64()}
_PARTS = f"{PIECES}, " + ", ".join(f"{n} {t}" for n, t in _MORE.items())
_ARROW_PARTS = pa.schema([*ARROW, *((n, _KINDS[t]) for n, t in _MORE.items())])


def _over(*_: object) -> None:
    raise CodecError("encode-timeout")


_watched = False


@contextmanager
def _watch() -> Iterator[None]:
    """Alarms raise where they find the main thread. Set once around many files, as it costs more than small files do."""
    global _watched
    if _watched or threading.current_thread() is not threading.main_thread():
        yield
        return
    before, _watched = signal.signal(signal.SIGALRM, _over), True
    try:
        yield
    finally:
        signal.signal(signal.SIGALRM, before)
        _watched = False


@contextmanager
def _limited(seconds: float) -> Iterator[None]:
    """Raise in what runs within when the time is over; a reader that never ends costs its limit."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return
    with nullcontext() if _watched else _watch():
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            yield
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)


#: What recognises the text of a scanned file: its bytes to the text of each page.
Engine = Callable[[bytes], list[str]]


def read_one(ext: str, content: bytes | None, seconds: float = MOST_SECONDS, recognise: Engine | None = None) -> tuple[list[dict], str | None]:
    """What a reader finds in a file, and the code if it cannot be read."""
    read = READERS.get(ext)
    if read is pdfread.glyphs:
        read = partial(read, recognise=recognise)
    if read is None or content is None:
        return [], "decode-failed"
    try:
        with _limited(seconds):
            return read(content), None
    except CodecError as e:
        return [], e.code
    except Exception:  # noqa: BLE001 - whatever is wrong with a file is that file's code
        return [], "decode-failed"


#: Rows of a batch, and bytes of the files that they come from, after which it is handed on.
BATCH_ROWS, BATCH_BYTES = 5000, 1 << 22


def _batches(told: Iterator[tuple[list[dict], int]], schema: pa.Schema = _ARROW_PARTS) -> Iterator[pa.RecordBatch]:
    """Rows of one file after the other, and the bytes of each file, in batches; small files share one, as a batch costs as much as many rows."""
    held, weight = [], 0
    for rows, size in told:
        held += rows
        weight += size
        if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
            for at in range(0, len(held), BATCH_ROWS):
                yield piece_batch(held[at : at + BATCH_ROWS], schema)
            held, weight = [], 0
    if held:
        yield piece_batch(held, schema)


#: A file that was read: its identity, name and size, what was found in it, its code, and the bytes it has.
Read = tuple[str, str, int, list[dict], str | None, int]


def _read_all(batches: Iterator[pa.RecordBatch], seconds: float, recognise: Engine | None) -> Iterator[Read]:
    with _watch():
        for b in batches:
            for hid, name, size, ext, content in zip(*(b.column(c).to_pylist() for c in ("hid", "name", "size", "ext", "content")), strict=True):
                rows, code = read_one(ext, content, seconds, recognise)
                for r in rows:
                    r["file_id"] = hid
                yield hid, name, size, rows, code, len(content or b"")


def _to_read(files: DataFrame) -> DataFrame:
    return files.select(F.col("hid").cast("string").alias("hid"), "name", F.col("size").cast("long").alias("size"), ext_of(F.col("name")).alias("ext"), "content")


def parts(files: DataFrame, seconds: float = MOST_SECONDS, recognise: Engine | None = None) -> DataFrame:
    """(hid, name, size, content) -> the rows of all readers, and one of kind "file" for each file, written once."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], int]]:
        for hid, name, size, rows, code, weight in _read_all(batches, seconds, recognise):
            yield [{"kind": "file", "file_id": hid, "name": name, "size": size, "code": code}, *({"kind": "piece", **r} for r in rows)], weight

    return saved(_to_read(files).mapInArrow(lambda batches: _batches(told(batches)), _PARTS), "kind")


def read_pieces(files: DataFrame, seconds: float = MOST_SECONDS) -> DataFrame:
    """(hid, name, size, content) -> the pieces of DOCX, EPUB and rich text files, whose readers give no other rows. One reader follows, so nothing is written in between."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], int]]:
        for _, name, _, rows, _, weight in _read_all(batches, seconds, None):
            if any("kind" in r for r in rows):
                raise ValueError(f"{name} is read as more than pieces")
            yield rows, weight

    return _to_read(files).mapInArrow(lambda batches: _batches(told(batches), ARROW), PIECES)


def _laid_out(glyphs: DataFrame) -> DataFrame:
    """Paragraphs of glyphs, page after page."""
    found = layout.page_paragraphs(glyphs.select("file_id", "page", "seq", "x", "y", F.col("body").alias("str")))
    return as_pieces(found, file_id=F.col("file_id"), seq=F.col("page") * 1_000_000 + F.col("place"), t=F.lit("p"), row=F.lit(0), col=F.lit(0), runs=F.array(plain_run(readers.trim(F.col("text")))))


def pieces_of(found: DataFrame) -> DataFrame:
    """Pieces of all files of ``parts``."""

    def of(kind: str) -> DataFrame:
        return found.where(F.col("kind") == kind)

    texts = {kind: of(kind).select("file_id", F.col("body").alias("text")) for kind in ("txt", "md")}
    return of("piece").select(*ARROW.names).unionByName(readers.read_txt(texts["txt"])).unionByName(readers.read_markdown(texts["md"])).unionByName(_laid_out(of("glyph"))).unionByName(readers.read_ocr(of("ocr").select("file_id", "page", F.col("body").alias("text"))))


def _as_bytes(f) -> Callable[[DataFrame], DataFrame]:
    return lambda pieces: assemble(pieces, f).select("file_id", F.col("body").cast("binary").alias("content"))


WRITERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "TXT": _as_bytes(formats.TXT),
    "MD": _as_bytes(formats.MD),
    "RTF": _as_bytes(formats.RTF),
    "PDF": pdf.write_pdf,
    "DOCX": packages.write_docx,
    "EPUB": packages.write_epub,
}


#: Targets of pictures and of sound, and how a row of theirs becomes a file.
MEDIA: dict[str, tuple[str, Callable[[dict, str, int], bytes]]] = {
    **dict.fromkeys(("PNG", "JPG", "SVG"), ("image", lambda r, target, quality: raster.encoded(r["data"], r["mime"], int(r["x"]), int(r["y"]), r["name"] or "", target, quality))),
    "WAV": ("audio", lambda r, target, quality: sound.encoded(r["data"])),
}
#: Targets that nothing here makes, their family, and the code that says so.
FAILING: dict[str, tuple[str, str]] = {
    "WEBP": ("image", "webp-unsupported"),
    "HEIC": ("image", "heic-output-unsupported"),
    **{t: ("audio", f"{t.lower()}-unsupported") for t in ("MP3", "OGG", "AAC", "M4A")},
    **{t: ("video", f"{t.lower()}-unsupported") for t in ("MP4", "WEBM", "MOV", "MKV", "AVI")},
}
TARGETS = {**dict.fromkeys(WRITERS, "document"), **{t: family for t, (family, _) in MEDIA.items()}}


def encode(pieces: DataFrame, target: str) -> DataFrame:
    """(file_id, content) of pieces in a target format."""
    return WRITERS[target](pieces)


def encode_media(found: DataFrame, target: str, quality: int, seconds: float) -> DataFrame:
    """(file_id, content, code) of pictures or sounds of ``parts``."""
    write = MEDIA[target][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row, content, code = b.slice(k, 1).to_pylist()[0], None, None
                try:
                    with _limited(seconds):
                        content = write(row, target, quality)
                except CodecError as e:
                    code = e.code
                except Exception:  # noqa: BLE001 - as in read_one
                    code = "encode-failed"
                yield pa.RecordBatch.from_arrays([pa.array([row["file_id"]], pa.string()), pa.array([content], pa.binary()), pa.array([code], pa.string())], names=["file_id", "content", "made_code"])

    kind = "image" if MEDIA[target][0] == "image" else "sound"
    return found.where(F.col("kind") == kind).select("file_id", "data", "mime", "x", "y", "name").mapInArrow(run, "file_id string, content binary, made_code string")


def _outcome(files: DataFrame, target: str, family: str, content: Column, code: Column) -> DataFrame:
    failed = F.when(content.isNull(), F.coalesce(code, F.lit("encode-failed")))
    name = out_name(F.col("entry_name"), F.lit(family or "document"), F.lit(target))
    return files.select("hid", "entry_name", name.alias("name"), F.lit(target).alias("target"), "src_size", F.octet_length(content).cast("long").alias("size"), content.alias("content"), failed.alias("code"))


def convert(files: DataFrame, target: str, quality: int = DEFAULT_QUALITY, seconds: float = MOST_SECONDS, recognise: Engine | None = None) -> DataFrame:
    """Files (hid, name, size, content) as files of one target: hid, entry_name, name, target, src_size, size, content, code. A file of another
    family than the target's has the code of an unsupported target. ``recognise`` reads scanned files; without it they have the code of an engine that is not there."""
    found = parts(files, seconds, recognise)
    told = found.where("kind = 'file'").select(F.col("file_id").alias("hid"), F.col("name").alias("entry_name"), F.col("size").alias("src_size"), F.col("code").alias("__code"))
    family, code = FAILING.get(target, (TARGETS.get(target, ""), None))
    other = [e for e, own in FAMILIES.items() if own != family]
    strange = F.when(ext_of(F.col("entry_name")).isin(*other), "unsupported-target")
    if target not in TARGETS:
        return _outcome(told, target, family, F.lit(None).cast("binary"), F.coalesce(strange, F.col("__code"), F.lit(code or "unsupported-target")))
    if target in MEDIA:
        made = encode_media(found, target, quality, seconds).select(F.col("file_id").alias("hid"), "content", "made_code")
    else:
        made = encode(pieces_of(found), target).select(F.col("file_id").alias("hid"), "content", F.lit(None).cast("string").alias("made_code"))
    return _outcome(told.join(made, "hid", "left"), target, family, F.col("content"), F.coalesce(F.col("__code"), F.col("made_code"), strange))


def probe_videos(files: DataFrame, seconds: float = MOST_SECONDS) -> DataFrame:
    """(hid, name, size, content) of videos -> hid, width, height, seconds, code; read by ``parts`` like all others."""
    found = parts(files, seconds)
    told = found.where("kind = 'file'").select(F.col("file_id").alias("hid"), "code")
    heads = found.where("kind = 'video'").select(F.col("file_id").alias("hid"), F.col("x").cast("long").alias("width"), F.col("y").cast("long").alias("height"), F.col("body").cast("double").alias("seconds"))
    return told.join(heads, "hid", "left").select("hid", "width", "height", "seconds", "code")


@udtf(returnType="kind string, seq long, t string, level int, row int, col int, text string, code string")
class FileParts:
    """What ``read_one`` finds, as a table function: ``SELECT f.hid, p.* FROM files f, LATERAL file_parts(f.name, f.content) p``. A file that cannot be read gives a row
    with its code."""

    def eval(self, name: str, content: bytes):
        end = (name or "").lower().rpartition(".")
        rows, code = read_one(f".{end[2]}" if end[1] else "", content)
        if code:
            yield "file", None, None, None, None, None, None, code
        for r in rows:
            text = r.get("body") if "runs" not in r else "".join(x["text"] for x in r["runs"])
            yield r.get("kind", "piece"), r.get("seq"), r.get("t"), r.get("level"), r.get("row"), r.get("col"), text, None


def register_functions(spark: SparkSession) -> None:
    """Table functions for SQL: file_parts, zip_members."""
    spark.udtf.register("file_parts", FileParts)
    packages.register_functions(spark)
