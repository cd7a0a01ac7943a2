"""Widths and byte codes of the PDF text writer, and text escapes of the target formats, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Width in thousandths of each byte of the writer's code page, from 32 to 255 in order.
PRINTED_WIDTHS = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    233, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584, 556,
    556, 556, 333, 333, 556, 1000, 278, 556, 333, 1000, 667, 556, 1000, 556, 667, 556,
    556, 191, 191, 556, 556, 350, 556, 1000, 333, 1000, 500, 556, 611, 556, 500, 667,
    556, 278, 556, 556, 556, 556, 260, 556, 333, 737, 400, 556, 584, 333, 737, 333,
    400, 584, 400, 400, 333, 556, 556, 278, 333, 400, 400, 556, 834, 834, 834, 556,
    667, 667, 667, 667, 667, 667, 1000, 722, 667, 667, 667, 667, 278, 278, 278, 278,
    722, 722, 778, 778, 778, 778, 778, 584, 778, 722, 722, 722, 722, 667, 667, 611,
    556, 556, 556, 556, 556, 556, 611, 500, 556, 556, 556, 556, 222, 222, 222, 222,
    556, 556, 556, 556, 556, 556, 556, 584, 556, 556, 556, 556, 556, 500, 556, 500,
]
DEFAULT_WIDTH = 556
WIDTHS = [DEFAULT_WIDTH] * 32 + PRINTED_WIDTHS
#: Characters beyond Latin-1 that the code page has, and the characters of their bytes.
HIGH = {b: bytes([b]).decode("cp1252") for b in range(128, 160) if b not in (129, 141, 143, 144, 157)}


def code_page(text: Column) -> Column:
    """Text in which every character is one of 256: its byte in the code page, or a question mark."""
    known = F.translate(F.coalesce(text, F.lit("")), "".join(HIGH.values()), "".join(map(chr, HIGH)))
    return F.regexp_replace(known, r"[^\x00-\xFF]", "?")


def code_bytes(text: Column) -> Column:
    return F.encode(code_page(text), "ISO-8859-1")


#: A letter for each width, and what every character of the code page becomes by it (a mark for the default width).
_CLASSES = {w: chr(ord("A") + k) for k, w in enumerate(sorted(set(WIDTHS) - {DEFAULT_WIDTH}))}
_CHARACTERS = "".join(map(chr, range(1, 256)))
_LETTERS = "".join(_CLASSES.get(w, "@") for w in WIDTHS[1:])


def width(text: Column) -> Column:
    """Width of a text in thousandths of its size: characters become the letters of their widths in one pass, and are counted by letter."""
    classes = F.translate(code_page(text), _CHARACTERS, _LETTERS)

    def total(x: Column) -> Column:
        out = F.length(x) * DEFAULT_WIDTH
        for w, letter in _CLASSES.items():
            out = out + (F.length(x) - F.length(F.replace(x, F.lit(letter), F.lit("")))) * (w - DEFAULT_WIDTH)
        return out.cast("int")

    return F.transform(F.array(classes), total)[0]


def pdf_escape(text: Column) -> Column:
    return F.regexp_replace(code_page(text), r"([()\\])", r"\\$1")


def rtf_escape(text: Column) -> Column:
    """RTF text: marks escaped, line feeds as breaks, Latin-1 as hex, the rest of the BMP as signed numbers, others as ?"""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\{}])", r"\\$1")
    plain = F.replace(plain, F.lit("\n"), F.lit("\\line "))

    def one(c: Column) -> Column:
        code = F.ascii(c)
        hexed = F.concat(F.lit("\\'"), F.lower(F.lpad(F.hex(code), 2, "0")))
        signed = F.when(code > 32767, code - 65536).otherwise(code)
        return F.when(code < 128, c).when(code <= 255, hexed).when(code <= 65535, F.concat(F.lit("\\u"), signed.cast("string"), F.lit("?"))).otherwise("?")

    return F.when(plain.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(plain, ""), one), "")).otherwise(plain)


def md_escape(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def base64_line(data: Column) -> Column:
    """Base64 without the line breaks that Spark puts in."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")
