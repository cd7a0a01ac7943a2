"""Packages: archives as tables of members, and the two document formats that are archives of marked-up parts.

Members of an archive come and go as rows; a document is opened in the task that holds its bytes, part by part, and its parts become blocks by ``markup``.
Writers put all parts of a file side by side in one projection, and an Arrow mapper closes the archive.
"""

from __future__ import annotations

import base64
import binascii
import posixpath
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from . import archive
from .formats import WORD, XHTML, picture_name, picture_relationship, xml_text
from .markup import word_blocks, xhtml_blocks, xml_events
from .model import CodecError
from .pieces import assemble


def members(files: DataFrame) -> DataFrame:
    """(file_id, content) -> (file_id, seq, name, data, code): a row a member, or one row with the code of what is wrong."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, content in zip(batch["file_id"], batch["content"], strict=True):
                try:
                    rows += [(file_id, k, name, data, None) for k, (name, data) in enumerate(archive.read(bytes(content or b"")).items())]
                except CodecError as e:
                    rows.append((file_id, 0, None, None, e.code))
            yield pd.DataFrame(rows, columns=["file_id", "seq", "name", "data", "code"])

    return files.select("file_id", "content").mapInPandas(run, "file_id string, seq long, name string, data binary, code string")


@udtf(returnType="seq int, name string, data binary, code string")
class ZipMembers:
    """The same as a table function for SQL: ``SELECT f.hid, m.* FROM files f, LATERAL zip_members(f.content) m``."""

    def eval(self, content: bytes):
        try:
            for k, (name, data) in enumerate(archive.read(bytes(content or b"")).items()):
                yield k, name, data, None
        except CodecError as e:
            yield 0, None, None, e.code


def register_functions(spark: SparkSession) -> None:
    spark.udtf.register("zip_members", ZipMembers)


def archives(parts: DataFrame) -> DataFrame:
    """(file_id, seq, name, data, packed) -> (file_id, content): the members of each file in the order of ``seq``."""

    def close(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["seq", "name"])
        entries = zip(group["name"], map(bytes, group["data"]), group["packed"], strict=True)
        return pd.DataFrame({"file_id": [group["file_id"].iloc[0]], "content": [archive.write(entries)]})

    return parts.select("file_id", "seq", "name", "data", "packed").groupBy("file_id").applyInPandas(close, "file_id string, content binary")


# Types of pictures by the ends of their names.
_MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml"}


def _media_type(path: str) -> str:
    return _MEDIA_TYPES.get(path.rpartition(".")[2].lower(), "image/png")


@lru_cache(4096)
def _within(folder: str, path: str) -> str:
    """A path as the archive names it: relative to a folder, or from the root."""
    return posixpath.normpath(posixpath.join("/", folder, path.replace("\\", "/"))).lstrip("/")


def docx(content: bytes) -> list[dict]:
    """Blocks of a word-processing file."""
    parts = archive.read(content)
    if "word/document.xml" not in parts:
        raise CodecError("docx-corrupt")
    pictures: dict[str, tuple[bytes, str]] = {}

    def related(attrs: dict) -> None:
        path = _within("word", attrs.get("Target", ""))
        if path.startswith("word/media/") and path in parts:
            pictures[attrs.get("Id", "")] = parts[path], _media_type(path)

    try:
        if any(name.startswith("word/media/") for name in parts):
            xml_events(parts.get("word/_rels/document.xml.rels", b"<none/>"), {"Relationship": related})
    except CodecError:
        pass  # the text can still be read
    try:
        found = word_blocks(parts["word/document.xml"], pictures)
    except CodecError:
        raise CodecError("docx-corrupt") from None
    if not found:
        raise CodecError("docx-no-text")
    return found


def _inline_data(source: str) -> tuple[bytes, str] | None:
    m = re.match(r"(?s)data:([^;,]+)?(?:;[^,]*)?,(.*)", source.strip())
    if not m:
        return None
    try:
        return base64.b64decode(m[2], validate=False), m[1] or "image/png"
    except (binascii.Error, ValueError):
        return None


#: Bytes of a container that is remembered.
_LARGEST_CONTAINER = 4096


@lru_cache(64)
def _roots(container: bytes) -> list[str]:
    """Paths of the packages that a container names; books of one maker have the same container."""
    found: list[str] = []

    def root(attrs: dict) -> None:
        if attrs.get("full-path"):
            found.append(attrs["full-path"])

    xml_events(container, {"rootfile": root})
    return found


def epub(content: bytes) -> list[dict]:
    """Blocks of the chapters of a book in the order of its spine."""
    parts = archive.read(content)
    manifest: dict[str, tuple[str, str]] = {}
    order: list[str] = []

    def item(attrs: dict) -> None:
        manifest[attrs.get("id", "")] = _within(folder, attrs.get("href", "").partition("#")[0]), attrs.get("media-type", "")

    def itemref(attrs: dict) -> None:
        order.append(attrs.get("idref", ""))

    try:
        container = parts.get("META-INF/container.xml", b"")
        roots = (_roots if len(container) <= _LARGEST_CONTAINER else _roots.__wrapped__)(container)
        if not roots or roots[0] not in parts:
            raise CodecError("epub-corrupt")
        folder = posixpath.dirname(roots[0])
        xml_events(parts[roots[0]], {"item": item, "itemref": itemref})
    except CodecError:
        raise CodecError("epub-corrupt") from None
    out: list[dict] = []
    for name in order:
        path, kind = manifest.get(name, ("", ""))
        if path in parts and ("html" in kind or "xml" in kind):
            first, own = out[-1]["seq"] + 1 if out else 0, posixpath.dirname(path)
            for block in xhtml_blocks(parts[path]):
                block["seq"] += first
                out += [block] if block["t"] != "img" else _drawn(block, own, parts)
    if not out:
        raise CodecError("epub-no-text")
    return out


def _drawn(block: dict, folder: str, parts: dict[str, bytes]) -> list[dict]:
    """A picture with its bytes, or what it is called if there are none."""
    source = block["mime"]
    path = _within(folder, source.partition("#")[0])
    found = _inline_data(source) if source.startswith("data:") else (parts[path], _media_type(path)) if path in parts else None
    if found:
        return [{**block, "data": found[0], "mime": found[1]}]
    if block["alt"]:
        return [{**block, "t": "p", "mime": None, "alt": None, "runs": [{"text": f"[image: {block['alt']}]", "b": False, "i": True}]}]
    return []


_XML = '<?xml version="1.0" encoding="UTF-8"?>'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_WORD_SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _list_styles() -> str:
    """The two kinds of lists: 1 has bullets, 2 counts."""
    kinds = {1: ("bullet", "\u2022"), 2: ("decimal", "%1.")}
    levels = [f'<w:abstractNum w:abstractNumId="{k}"><w:multiLevelType w:val="singleLevel"/><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{sign}"/><w:pPr><w:ind w:left="500" w:hanging="250"/></w:pPr></w:lvl></w:abstractNum>' for k, (kind, sign) in kinds.items()]
    used = [f'<w:num w:numId="{k}"><w:abstractNumId w:val="{k}"/></w:num>' for k in kinds]
    return f"{_XML}<w:numbering {_WORD_SPACE}>{''.join(levels + used)}</w:numbering>"


def _heading_styles() -> str:
    styles = [f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{38 - 6 * k}"/></w:rPr></w:style>' for k in (1, 2, 3)]
    return f"{_XML}<w:styles {_WORD_SPACE}>{''.join(styles)}</w:styles>"


def _member(name: str | Column, data: Column) -> Column:
    return F.struct((name if isinstance(name, Column) else F.lit(name)).alias("name"), data.cast("binary").alias("data"))


def _each(line) -> Column:
    """A line for each picture, joined."""
    return F.array_join(F.transform("pictures", line), "")


def _closed(files: DataFrame, first: list[Column | tuple[str, str, bool]], folder: str) -> DataFrame:
    """(file_id, content): archives of the members given and of the pictures, in order. Members that are the same in all files (name, data, packed?) are known to the tasks and not sent
    there with each row."""
    media = F.transform("pictures", lambda p: _member(F.concat(F.lit(folder), picture_name(p["number"], p["mime"])), p["data"]))
    fixed = [None if isinstance(m, Column) else (m[0], m[1].encode(), m[2]) for m in first]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, members, made = b.column("file_id"), b.column("members"), []
            names, data = (members.values.field(n).to_pylist() for n in ("name", "data"))
            places = members.offsets.to_pylist()
            for start, end in zip(places, places[1:], strict=False):
                rest = iter([(names[k], data[k] or b"", True) for k in range(start, end)])
                made.append(archive.write([*(m or next(rest) for m in fixed), *rest]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary())], names=["file_id", "content"])

    varied = F.array(*(m for m in first if isinstance(m, Column)))
    return files.select("file_id", F.concat(varied, media).alias("members")).mapInArrow(close, "file_id string, content binary")


def write_docx(pieces: DataFrame) -> DataFrame:
    """(file_id, content) of pieces."""
    kinds = {"document": "document.main", "numbering": "numbering", "styles": "styles"}
    parts = "".join(f'<Override PartName="/word/{part}.xml" ContentType="{_WORD_TYPE}.{kind}+xml"/>' for part, kind in kinds.items())
    types = _each(lambda p: F.concat(F.lit('<Override PartName="/word/media/'), picture_name(p["number"], p["mime"]), F.lit('" ContentType="'), p["mime"], F.lit('"/>')))
    drawn = _each(lambda p: F.concat(F.lit('<Relationship Id="'), picture_relationship(p["number"]), F.lit(f'" Type="{_OFFICE}/image" Target="media/'), picture_name(p["number"], p["mime"]), F.lit('"/>')))
    own = "".join(f'<Relationship Id="{part}" Type="{_OFFICE}/{part}" Target="{part}.xml"/>' for part in ("numbering", "styles"))
    members = [
        _member("[Content_Types].xml", F.concat(F.lit(f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{parts}'), types, F.lit("</Types>"))),
        ("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="main" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>', True),
        _member("word/document.xml", F.col("body")),
        ("word/numbering.xml", _list_styles(), True),
        ("word/styles.xml", _heading_styles(), True),
        _member("word/_rels/document.xml.rels", F.concat(F.lit(f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">{own}'), drawn, F.lit("</Relationships>"))),
    ]
    return _closed(assemble(pieces, WORD), members, "word/media/")


def write_epub(pieces: DataFrame) -> DataFrame:
    """(file_id, content) of pieces: a book of one text with a table of contents, entitled by its first heading; the type first and not packed."""
    title = xml_text(F.when(F.length("title") > 0, F.col("title")).otherwise("Untitled"))
    art = _each(lambda p: F.concat(F.lit('<item id="a'), p["number"].cast("string"), F.lit('" href="art/'), picture_name(p["number"], p["mime"]), F.lit('" media-type="'), p["mime"], F.lit('"/>')))
    page = f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>Contents</title></head><body><nav epub:type="toc"><ol><li><a href="text.xhtml">'
    book = F.concat(
        F.lit(f'{_XML}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="book"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="book">urn:sha256:'),
        F.sha2("body", 256), F.lit("</dc:identifier><dc:title>"), title, F.lit('</dc:title><dc:language>und</dc:language><meta property="dcterms:modified">2000-01-01T00:00:00Z</meta></metadata><manifest>'),
        F.lit('<item id="contents" href="contents.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="text" href="text.xhtml" media-type="application/xhtml+xml"/>'), art, F.lit('</manifest><spine><itemref idref="text"/></spine></package>'),
    )
    members = [
        ("mimetype", "application/epub+zip", False),
        ("META-INF/container.xml", f'{_XML}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book/book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>', True),
        _member("book/book.opf", book),
        _member("book/contents.xhtml", F.concat(F.lit(page), title, F.lit("</a></li></ol></nav></body></html>"))),
        _member("book/text.xhtml", F.col("body")),
    ]
    return _closed(assemble(pieces, XHTML), members, "book/art/")
