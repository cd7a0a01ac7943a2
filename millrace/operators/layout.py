"""Text out of lines and glyphs: islands and gaps.

Where the parts of one document are at hand as an array the work is done row by row, without a shuffle; the
window forms serve exploded tables, partitioned by document.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, trim

LINE_HEIGHT, PARAGRAPH_GAP = 4, 22


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def paragraphs(text: Column) -> Column:
    """Paragraphs of plain text: neighbouring lines that are not blank, trimmed and joined by a space. At least one, perhaps empty."""
    rows = F.transform(F.split(trim(F.coalesce(text, F.lit(""))), "\n"), trim)
    return F.transform(F.split(F.array_join(rows, "\n"), "\n\n+"), lambda x: F.replace(x, F.lit("\n"), F.lit(" ")))


def islands(df: DataFrame, of: Sequence[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a row where ``breaks`` holds begins a new one."""
    w = Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w))


def runs_by_change(df: DataFrame, of: Sequence[str], order: str, kind: Column, name: str = "island") -> DataFrame:
    """Number runs of neighbouring rows of one kind (nulls are a kind)."""
    w = Window.partitionBy(*of).orderBy(order)
    marked = df.withColumn("__kind", kind).withColumn("__new", ~F.col("__kind").eqNullSafe(F.lag("__kind").over(w)) | (F.row_number().over(w) == 1))
    return islands(marked, of, order, F.col("__new"), name).drop("__kind", "__new")


def page_lines(glyphs: DataFrame, of: Sequence[str] = ("file_id", "page")) -> DataFrame:
    """Glyphs (x, y, str) as visual lines: heights rounded to ``LINE_HEIGHT``, strings joined from left to right."""
    y = (F.floor(F.col("y") / LINE_HEIGHT + 0.5) * LINE_HEIGHT).cast("long")
    shown = glyphs.where(F.length(F.regexp_replace("str", f"^{WS}+|{WS}+$", "")) > 0).withColumn("y", y)
    line = F.array_sort(F.collect_list(F.struct("x", "seq", "str")))
    return shown.groupBy(*of, "y").agg(F.array_join(F.transform(line, lambda g: g["str"]), "").alias("line"))


def page_paragraphs(glyphs: DataFrame, of: Sequence[str] = ("file_id", "page")) -> DataFrame:
    """Lines from the top down; one that lies more than ``PARAGRAPH_GAP`` below the last begins a paragraph, as does a page."""
    w = Window.partitionBy(*of).orderBy(F.desc("y"))
    rows = page_lines(glyphs, of).withColumn("__gap", F.lag("y").over(w) - F.col("y"))
    numbered = rows.withColumn("place", F.sum(F.when(F.col("__gap") > PARAGRAPH_GAP, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "line")), asc=False), lambda r: r["line"]), " ")
    return numbered.groupBy(*of, "place").agg(F.count(F.lit(1)).alias("n_lines"), text.alias("text"))


def excerpt(parts: Column, most: int = 240) -> Column:
    """Beginning of a document: block texts joined, white space collapsed, cut with an ellipsis."""
    from ..functions.text import collapse, trim_end

    most = max(40, most)
    # blocks are joined until they are long enough for what shows, each cut to what could show of it
    state = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(acc: Column, part: Column) -> Column:
        shown = collapse(F.substring(F.regexp_replace(part, f"^{WS}+", ""), 1, 4 * most))
        # a block whose beginning is mostly white space is taken whole
        text = F.when(F.length(part) <= 4 * most, collapse(trim(part))).when(F.length(shown) > most, shown).otherwise(collapse(trim(part)))
        joined = F.when(F.length(text) == 0, acc["text"]).when(acc["n"] == 0, text).otherwise(F.concat(acc["text"], F.lit(" "), text))
        return F.when(acc["n"] > most, acc).otherwise(F.struct(joined.alias("text"), F.length(joined).alias("n")))

    whole = F.aggregate(parts, state, step, lambda acc: trim(acc["text"]))
    return F.transform(F.array(whole), lambda t: F.when(F.length(t) > most, F.concat(trim_end(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t))[0]


def wrap(words: Column, most: float, width_of: Callable[[Column], Column]) -> Column:
    """Greedy lines of an array of words: as many as fit, at least one. Each word is measured once."""
    line = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("width"))
    start = F.struct(F.array().cast("array<string>").alias("done"), line.alias("line"))
    gap = width_of(F.lit(" ")).cast("double")

    def step(state: Column, word: Column) -> Column:
        size = width_of(word).cast("double")
        now = state["line"]
        first = F.length(now["text"]) == 0
        wider = now["width"] + gap + size
        longer = F.when(first, F.struct(word.alias("text"), size.alias("width"))).otherwise(F.struct(F.concat(now["text"], F.lit(" "), word).alias("text"), wider.alias("width")))
        fits = first | (wider <= most)
        return F.struct(F.when(fits, state["done"]).otherwise(F.concat(state["done"], F.array(now["text"]))).alias("done"), F.when(fits, longer).otherwise(F.struct(word.alias("text"), size.alias("width"))).alias("line"))

    def finish(state: Column) -> Column:
        last = state["line"]["text"]
        return F.when((F.length(last) > 0) | (F.size(state["done"]) == 0), F.concat(state["done"], F.array(last))).otherwise(state["done"])

    return F.aggregate(words, start, step, finish)
