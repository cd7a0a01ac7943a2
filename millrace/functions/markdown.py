"""Kinds of Markdown lines, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trim

IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"


def cells(line: Column) -> Column:
    """Cells of a table row: what lies between its first and its last bar, trimmed."""
    parts = F.split(line, r"\|")
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), trim)


def line_kind(raw: Column) -> Column:
    """blank, h1 to h6, separator, row, ul, ol, image or text."""
    x = trim(raw)
    level = F.length(F.regexp_extract(x, r"^(#{1,6})\s+", 1))
    row = F.startswith(x, F.lit("|"))
    separator = (F.size(cells(x)) > 0) & F.forall(cells(x), lambda c: c.rlike("^:?-+:?$"))
    return (
        F.when(F.length(x) == 0, "blank")
        .when(level > 0, F.concat(F.lit("h"), level.cast("string")))
        .when(row & separator, "separator")
        .when(row, "row")
        .when(x.rlike(r"^[-*+]\s+"), "ul")
        .when(x.rlike(r"^\d+[.)]\s+"), "ol")
        .when(F.regexp_extract(x, IMAGE, 0) == x, "image")
        .otherwise("text")
    )
