"""What each format writes for runs, rows, blocks and the whole, as expressions (see ``pieces``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.glyphs import base64_line, md_escape, rtf_escape
from ..functions.text import xml_escape
from .media import jpeg_size, png_size
from .pieces import Format, bound, picture_label


def _text(r: Column) -> Column:
    return F.coalesce(r["text"], F.lit(""))


def _is(t: Column, *kinds: str) -> Column:
    return t.isin(*kinds)


def _mark(t: Column, row: Column, bullet: str = "- ") -> Column:
    return F.when(t == "ol", F.concat((row + 1).cast("string"), F.lit(". "))).otherwise(bullet)


def _item_or(t: Column, row: Column, cells: Column, table: Column) -> Column:
    joined = F.array_join(cells, "")
    return F.when(_is(t, "ul", "ol"), F.concat(_mark(t, row), joined)).when(t == "table", table).otherwise(joined)


def _ended(blocks: Column) -> Column:
    """Blocks with a blank line between, and one line feed at the end."""
    return F.concat(F.rtrim(F.array_join(blocks, "\n\n"), F.lit("\n")), F.lit("\n"))


TXT = Format(
    run=_text,
    row=lambda t, row, cells: _item_or(t, row, cells, F.array_join(cells, " | ")),
    block=lambda t, level, lines, most: F.array_join(lines, "\n"),
    picture=lambda number, data, mime, alt: picture_label(alt),
    whole=lambda blocks: _ended(F.filter(blocks, lambda b: F.length(b) > 0)),
)


def _starred(r: Column) -> Column:
    stars = F.concat(F.when(r["b"], "**").otherwise(""), F.when(r["i"], "*").otherwise(""))
    return F.concat(stars, md_escape(_text(r)), stars)


def _md_block(t: Column, level: Column, lines: Column, most: Column) -> Column:
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(1), most), lambda _: F.lit("---")), " | "), F.lit(" |"))
    table = F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    heading = F.concat(F.repeat(F.lit("#"), F.least(F.coalesce(level, F.lit(1)), F.lit(6))), F.lit(" "), F.array_join(lines, ""))
    return F.when(t == "table", F.array_join(table, "\n")).when(t == "h", heading).otherwise(F.array_join(lines, "\n"))


MD = Format(
    run=_starred,
    row=lambda t, row, cells: _item_or(t, row, cells, F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))),
    block=_md_block,
    picture=lambda number, data, mime, alt: F.concat(F.lit("!["), F.when(F.length(alt) > 0, alt).otherwise("image"), F.lit("](data:"), F.coalesce(mime, F.lit("image/png")), F.lit(";base64,"), base64_line(data), F.lit(")")),
    whole=_ended,
)


#: Width of a line and least width of a column, in twentieths of a point: A4 less an inch on each side, and half an inch.
_LINE_WIDTH, _LEAST_WIDTH = 11906 - 2 * 1440, 720


# Rich text: every style is a group of its own, so that nothing has to be switched off again.
def _grouped(r: Column) -> Column:
    words = F.concat(F.when(r["b"], "\\b").otherwise(""), F.when(r["i"], "\\i").otherwise(""))
    text = rtf_escape(_text(r))
    return F.when(F.length(words) > 0, F.concat(F.lit("{"), words, F.lit(" "), text, F.lit("}"))).otherwise(text)


def _rtf_row(t: Column, row: Column, cells: Column) -> Column:
    mark = F.when(t == "ul", "\\'95").otherwise(F.concat((row + 1).cast("string"), F.lit(".")))
    item = F.concat(F.lit("{\\pard\\fs21 "), mark, F.lit("\\tab "), F.array_join(cells, ""), F.lit("\\par}"))
    cell = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("{\\pard\\intbl\\fs19 "), c, F.lit("\\cell}"))), "")
    return F.when(_is(t, "ul", "ol"), item).when(t == "table", cell).otherwise(F.array_join(cells, ""))


def _rtf_block(t: Column, level: Column, lines: Column, most: Column) -> Column:
    step = F.greatest(F.lit(_LEAST_WIDTH), F.floor(F.lit(_LINE_WIDTH) / most))
    edges = F.array_join(F.transform(F.sequence(F.lit(1), most), lambda k: F.concat(F.lit("\\cellx"), (k * step).cast("string"))), "")
    table = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("{\\trowd"), edges, x, F.lit("\\row}"))), "\n")
    size = F.when(level == 1, "34").when(level == 2, "27").otherwise("23")
    heading = F.concat(F.lit("{\\pard\\b\\fs"), size, F.lit(" "), F.array_join(lines, ""), F.lit("\\par}"))
    plain = F.concat(F.lit("{\\pard\\fs21 "), F.array_join(lines, ""), F.lit("\\par}"))
    return F.when(t == "table", table).when(_is(t, "ul", "ol"), F.array_join(lines, "\n")).when(t == "h", heading).otherwise(plain)


def _rtf_picture(number: Column, data: Column, mime: Column, alt: Column) -> Column:
    """The bytes as hex digits, after the size in pixels where it can be told."""
    size = F.coalesce(png_size(data), jpeg_size(data))
    told = F.coalesce(F.concat(F.lit("\\picw"), size["width"].cast("string"), F.lit("\\pich"), size["height"].cast("string")), F.lit(""))
    kind = F.when(mime.contains("jp"), "jpeg").otherwise("png")
    return F.concat(F.lit("{\\pard {\\pict\\"), kind, F.lit("blip"), told, F.lit("\n"), F.lower(F.hex(data)), F.lit("\n}\\par}"))


RTF = Format(
    padded=True,
    run=_grouped,
    row=_rtf_row,
    block=_rtf_block,
    picture=_rtf_picture,
    whole=lambda blocks: F.concat(F.lit("{\\rtf1\\ansi\\ansicpg1252\\deff0\n{\\fonttbl{\\f0\\fswiss Arial;}}\n"), F.array_join(blocks, "\n"), F.lit("\n}")),
)


def picture_name(number: Column, mime: Column) -> Column:
    return F.concat(F.lit("image"), number.cast("string"), F.when(mime.contains("jp"), ".jpg").otherwise(".png"))


def _wrapped(tag: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))


def xml_text(text: Column) -> Column:
    """Text without the signs that XML has no way to write."""
    return xml_escape(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", ""))


def _html_run(r: Column) -> Column:
    text = xml_text(_text(r))
    text = F.when(r["i"], _wrapped("em", text)).otherwise(text)
    return F.when(r["b"], _wrapped("strong", text)).otherwise(text)


def _html_row(t: Column, row: Column, cells: Column) -> Column:
    joined = F.array_join(cells, "")
    return F.when(_is(t, "ul", "ol"), _wrapped("li", joined)).when(t == "table", _wrapped("tr", F.array_join(F.transform(cells, lambda c: _wrapped("td", c)), ""))).otherwise(joined)


def _html_block(t: Column, level: Column, lines: Column, most: Column) -> Column:
    tag = F.when(t == "h", F.concat(F.lit("h"), F.greatest(F.lit(1), F.least(F.coalesce(level, F.lit(1)), F.lit(3))).cast("string"))).otherwise(t)
    return F.concat(F.lit("<"), tag, F.lit(">"), F.array_join(lines, ""), F.lit("</"), tag, F.lit(">"))


XHTML = Format(
    run=_html_run,
    row=_html_row,
    block=_html_block,
    picture=lambda number, data, mime, alt: F.concat(F.lit('<p><img src="art/'), picture_name(number, mime), F.lit('" alt="'), xml_escape(alt), F.lit('"/></p>')),
    whole=lambda blocks: F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><!DOCTYPE html><html xmlns="http://www.w3.org/1999/xhtml"><head><title>Text</title></head><body>'), F.array_join(blocks, "\n"), F.lit("</body></html>")),
)


def _word_run(r: Column) -> Column:
    style = F.when(r["b"] | r["i"], F.concat(F.lit("<w:rPr>"), F.when(r["b"], "<w:b/>").otherwise(""), F.when(r["i"], "<w:i/>").otherwise(""), F.lit("</w:rPr>"))).otherwise("")
    # tabs and line feeds are elements of their own
    text = F.replace(F.replace(xml_text(_text(r)), F.lit("\t"), F.lit('</w:t><w:tab/><w:t xml:space="preserve">')), F.lit("\n"), F.lit('</w:t><w:br/><w:t xml:space="preserve">'))
    return F.concat(F.lit("<w:r>"), style, F.lit('<w:t xml:space="preserve">'), text, F.lit("</w:t></w:r>"))


def _word_row(t: Column, row: Column, cells: Column) -> Column:
    joined = F.array_join(cells, "")
    listed = F.concat(F.lit('<w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="'), F.when(t == "ol", "2").otherwise("1"), F.lit('"/></w:numPr></w:pPr>'), joined, F.lit("</w:p>"))
    begun = F.concat(F.lit('<w:tc><w:tcPr><w:tcW w:type="dxa" w:w="'), _column_width(F.size(cells)).cast("string"), F.lit('"/></w:tcPr><w:p>'))
    cell = bound(begun, lambda start: F.array_join(F.transform(cells, lambda c: F.concat(start, c, F.lit("</w:p></w:tc>"))), ""))
    return F.when(_is(t, "ul", "ol"), listed).when(t == "table", _wrapped("w:tr", cell)).otherwise(joined)


def _column_width(n: Column) -> Column:
    """A share of the line in twentieths of a point."""
    return F.greatest(F.lit(_LEAST_WIDTH), F.floor(F.lit(_LINE_WIDTH) / F.greatest(n, F.lit(1))))


_EDGES = "".join(f'<w:{side} w:val="single" w:sz="4" w:space="0" w:color="auto"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))


def _word_block(t: Column, level: Column, lines: Column, most: Column) -> Column:
    joined = F.array_join(lines, "")
    grid = F.repeat(F.concat(F.lit('<w:gridCol w:w="'), _column_width(most).cast("string"), F.lit('"/>')), most)
    table = F.concat(F.lit(f"<w:tbl><w:tblPr><w:tblBorders>{_EDGES}</w:tblBorders></w:tblPr><w:tblGrid>"), grid, F.lit("</w:tblGrid>"), joined, F.lit("</w:tbl>"))
    heading = F.concat(F.lit('<w:p><w:pPr><w:pStyle w:val="Heading'), F.greatest(F.lit(1), F.least(F.coalesce(level, F.lit(1)), F.lit(3))).cast("string"), F.lit('"/></w:pPr>'), joined, F.lit("</w:p>"))
    return F.when(t == "table", table).when(_is(t, "ul", "ol"), joined).when(t == "h", heading).otherwise(_wrapped("w:p", joined))


#: Name spaces of a word-processing part.
_DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
WORD_SPACES = f'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="{_DRAWING}/main" xmlns:wp="{_DRAWING}/wordprocessingDrawing" xmlns:pic="{_DRAWING}/picture"'
# The widest picture in pixels, the size of one that does not tell its own, and the units of a pixel.
_WIDEST, _UNTOLD, _UNITS = 600, (600, 450), 9525


def picture_relationship(number: Column) -> Column:
    return F.concat(F.lit("art"), number.cast("string"))


def _word_picture(number: Column, data: Column, mime: Column, alt: Column) -> Column:
    """An inline frame that a word processor shows: its extent, and the fill by its relationship."""

    def framed(d: Column) -> Column:
        size = F.coalesce(png_size(d), jpeg_size(d), F.struct(F.lit(_UNTOLD[0]).cast("long").alias("width"), F.lit(_UNTOLD[1]).cast("long").alias("height")))

        def drawn(s: Column) -> Column:
            w, h = F.greatest(s["width"], F.lit(1)), F.greatest(s["height"], F.lit(1))
            scale = F.least(F.lit(1.0), F.lit(float(_WIDEST)) / w)
            x, y = ((F.floor(side * scale + 0.5) * _UNITS).cast("string") for side in (w, h))
            n, name = number.cast("string"), xml_escape(F.when(F.length(alt) > 0, alt).otherwise(picture_name(number, mime)))
            parts = [
                '<w:p><w:r><w:drawing><wp:inline><wp:extent cx="', x, '" cy="', y, '"/><wp:docPr id="', n, '" name="', name, '" descr="', name, f'"/><a:graphic><a:graphicData uri="{_DRAWING}/picture"><pic:pic><pic:nvPicPr><pic:cNvPr id="', n, '" name="', name,
                '"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="', picture_relationship(number), '"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="', x, '" cy="', y,
                '"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing></w:r></w:p>',
            ]
            return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))

        return F.transform(F.array(size), drawn)[0]

    return F.transform(F.array(data), framed)[0]


WORD = Format(
    padded=True,
    run=_word_run,
    row=_word_row,
    block=_word_block,
    picture=_word_picture,
    whole=lambda blocks: F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><w:document {WORD_SPACES}><w:body>'), F.array_join(blocks, ""), F.lit('<w:sectPr><w:pgSz w:w="11906" w:h="16838"/></w:sectPr></w:body></w:document>')),
)
