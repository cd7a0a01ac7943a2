"""Readers of text formats: from the text of files to pieces, by expressions and windows within a file; pages by ``markup``."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import IMAGE, cells, line_kind
from ..functions.text import collapse, trim
from ..operators.layout import lines, paragraphs
from .markup import html_blocks
from .pieces import PIECES, as_pieces, piece_batch, plain_run


def read_txt(files: DataFrame) -> DataFrame:
    """Pieces of (file_id, text)."""
    rows = files.select("file_id", F.posexplode(paragraphs(F.col("text"))).alias("seq", "par"))
    return as_pieces(rows, file_id=F.col("file_id"), seq=F.col("seq"), t=F.lit("p"), row=F.lit(0), col=F.lit(0), runs=F.array(plain_run(F.col("par"))))


#: Marks of styles, the strongest first, and then what no mark begins.
_TOKENS = r"(\*\*\*.+?\*\*\*|\*\*.+?\*\*|__[^_]+?__|\*[^*]+?\*|_[^_]+?_|`[^`]+?`|[^*_`]+|[*_`])"


def inline(text: Column) -> Column:
    """Runs of a line: bold, italic and code marks, the rest plain; neighbouring plain parts are one run."""

    def one(x: Column) -> Column:
        out = None
        for mark, b, i in (("***", True, True), ("**", True, False), ("__", True, False), ("*", False, True), ("_", False, True), ("`", False, False)):
            n = len(mark)
            hit = F.startswith(x, F.lit(mark)) & F.endswith(x, F.lit(mark)) & (F.length(x) > 2 * n)
            r = F.struct(x.substr(F.lit(n + 1), F.length(x) - 2 * n).alias("text"), F.lit(b).alias("b"), F.lit(i).alias("i"), F.lit(False).alias("plain"))
            out = F.when(hit, r) if out is None else out.when(hit, r)
        return out.otherwise(F.struct(x.alias("text"), F.lit(False).alias("b"), F.lit(False).alias("i"), F.lit(True).alias("plain")))

    kind = "array<struct<text: string, b: boolean, i: boolean, plain: boolean>>"
    tokens = F.transform(F.regexp_extract_all(text, F.lit(_TOKENS), 1), one)

    def join(done: Column, r: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(F.concat(last["text"], r["text"]).alias("text"), r["b"].alias("b"), r["i"].alias("i"), r["plain"].alias("plain"))
        both = (F.size(done) > 0) & r["plain"] & F.coalesce(F.get(done, F.size(done) - 1)["plain"], F.lit(False))
        return F.when(both, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    joined = F.aggregate(tokens, F.array().cast(kind), join)
    shown = F.transform(joined, lambda r: plain_run(F.replace(r["text"], F.lit("\\|"), F.lit("|")), r["b"], r["i"]))
    return F.when(F.size(shown) > 0, shown).otherwise(F.array(plain_run(F.lit(""))))


def read_markdown(files: DataFrame) -> DataFrame:
    """Pieces of (file_id, text). A table goes on over blank lines; lists and paragraphs end at them."""
    rows = files.select("file_id", F.posexplode(lines(F.coalesce(F.col("text"), F.lit("")))).alias("n", "raw")).withColumn("line", trim(F.col("raw"))).withColumn("kind", line_kind(F.col("raw")))
    item = F.regexp_replace("line", r"^(?:[-*+]|\d+[.)])\s+", "")
    listed = F.col("kind").isin("ul", "ol") & item.rlike(IMAGE)
    rows = rows.withColumn("kind", F.when(F.col("kind").isin("row", "separator"), "table").when(listed, "image").otherwise(F.col("kind"))).withColumn("rule", (line_kind(F.col("raw")) == "separator"))
    by = Window.partitionBy("file_id").orderBy("n")
    shown = rows.withColumn("blank", F.lag(F.col("kind") == "blank").over(by)).where("kind <> 'blank'").withColumn("before", F.lag("kind").over(by))
    alone = F.col("kind").isin("image") | F.startswith("kind", F.lit("h"))
    ends = F.coalesce(F.col("blank"), F.lit(False)) & (F.col("kind") != "table")
    new = alone | ends | ~F.col("kind").eqNullSafe(F.col("before"))
    numbered = shown.withColumn("seq", F.sum(F.when(new, 1).otherwise(0)).over(by)).where("NOT rule")
    nth = F.when(F.col("kind") == "text", 0).otherwise(F.row_number().over(Window.partitionBy("file_id", "seq").orderBy("n")) - 1)
    placed = numbered.withColumn("nth", nth).groupBy("file_id", "seq", "kind", "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), " ").alias("line"))
    alt, source = F.regexp_extract("line", IMAGE, 1), F.regexp_extract("line", IMAGE, 2)
    pictured = F.col("kind") == "image"
    encoded = F.regexp_replace(F.regexp_extract(source, r"(?s)^data:([^;,]+)?(;base64)?,(.*)$", 3), r"\s+", "")
    mime = F.regexp_extract(source, r"^data:([^;,]+)", 1)
    drawn = placed.withColumn("data", F.try_to_binary(F.when(pictured & (F.length(encoded) > 0), encoded), F.lit("base64")))
    has = F.col("data").isNotNull()
    heading = F.startswith("kind", F.lit("h"))
    text = F.when(heading, F.regexp_replace("line", r"^#{1,6}\s+", "")).when(F.col("kind").isin("ul", "ol"), item).otherwise(F.col("line"))
    shown = drawn.select(
        "file_id", "seq", "nth", "kind", "data", F.when(has, F.when(F.length(mime) > 0, mime).otherwise("image/png")).alias("mime"), F.when(has, alt).alias("alt"),
        F.when(pictured & ~has, F.concat(F.lit("[image: "), F.when(F.length(alt) > 0, alt).otherwise(source), F.lit("]"))).alias("stand_in"),
        F.posexplode(F.when(F.col("kind") == "table", cells(F.col("line"))).otherwise(F.array(text))).alias("col", "text"),
    )
    t = F.when(heading, "h").when(pictured, F.when(has, "img").otherwise("p")).when(F.col("kind") == "text", "p").otherwise(F.col("kind"))
    runs = F.when(F.col("stand_in").isNotNull(), F.array(plain_run(F.col("stand_in"), i=F.lit(True)))).when(pictured, F.array(plain_run(F.lit("")))).otherwise(inline(F.col("text")))
    level = F.when(heading, F.substring("kind", 2, 1).cast("int"))
    found = as_pieces(shown, file_id=F.col("file_id"), seq=F.col("seq"), t=t, level=level, row=F.col("nth"), col=F.col("col"), runs=runs, data=F.col("data"), mime=F.col("mime"), alt=F.col("alt"))
    empty = files.where(trim(F.coalesce(F.col("text"), F.lit(""))) == "")
    return found.unionByName(as_pieces(empty, file_id=F.col("file_id"), seq=F.lit(0), t=F.lit("p"), row=F.lit(0), col=F.lit(0), runs=F.array(plain_run(F.lit("")))))


def read_html(files: DataFrame) -> DataFrame:
    """Pieces of (file_id, text): headings, paragraphs, list items, table cells, and pictures by name (alt; ``mime`` holds the source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file_id, text in zip(b.column("file_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                yield piece_batch([{"file_id": file_id, **block} for block in html_blocks(text or "")])

    return files.select("file_id", "text").mapInArrow(run, PIECES)


def read_ocr(pages: DataFrame) -> DataFrame:
    """Pieces of recognised text (file_id, page, text): paragraphs are parted by blank lines, white space is collapsed."""
    parts = pages.select("file_id", "page", F.posexplode(F.split("text", r"\n\s*\n")).alias("k", "par")).withColumn("par", trim(collapse(F.col("par")))).where("par <> ''")
    return as_pieces(parts, file_id=F.col("file_id"), seq=F.col("page") * 1_000_000 + F.col("k"), t=F.lit("p"), row=F.lit(0), col=F.lit(0), runs=F.array(plain_run(F.col("par"))))
