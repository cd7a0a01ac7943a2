"""Documents as tables of pieces, and how pieces become the text of a format.

A piece is a paragraph, a heading, a list item, a table cell or a picture: one row with

``file_id, seq`` (place of its block), ``t`` (h, p, ul, ol, table, img), ``level`` (of a heading), ``row, col`` (of an item or cell),
``runs`` (array of text with bold and italic flags), and for pictures ``data, mime, alt``.

Readers give such rows and writers take them; all a format needs is how a run, a row, a block and the whole are put (``Format``).
The pieces of a file are gathered by one shuffle on ``file_id``, which the steps from cells to rows to blocks to the file share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUNS = "array<struct<text: string, b: boolean, i: boolean>>"
PIECES = f"file_id string, seq long, t string, level int, row int, col int, runs {RUNS}, data binary, mime string, alt string"
_RUN = pa.struct([("text", pa.string()), ("b", pa.bool_()), ("i", pa.bool_())])
ARROW = pa.schema([("file_id", pa.string()), ("seq", pa.int64()), ("t", pa.string()), ("level", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("runs", pa.list_(_RUN)), ("data", pa.binary()), ("mime", pa.string()), ("alt", pa.string())])
NAMES = ["file_id", "seq", "t", "level", "row", "col", "runs", "data", "mime", "alt"]


def _runs(held: list[list[dict] | None]) -> pa.Array:
    """Runs by columns: their texts and flags, and where those of a row begin."""
    flat = [r for runs in held if runs for r in runs]
    starts, at = [], 0
    for runs in held:
        starts.append(None if runs is None else at)
        at += len(runs or ())
    columns = [pa.array([r[f.name] for r in flat], f.type) for f in _RUN]
    return pa.ListArray.from_arrays(pa.array([*starts, at], pa.int32()), pa.StructArray.from_arrays(columns, fields=list(_RUN)), type=pa.list_(_RUN))


def piece_batch(rows: list[dict], schema: pa.Schema = ARROW) -> pa.RecordBatch:
    """Pieces as Python rows, in the columns of a batch; what a row lacks is null."""
    columns = [[r.get(f.name) for r in rows] for f in schema]
    return pa.RecordBatch.from_arrays([_runs(c) if f.name == "runs" else pa.array(c, f.type) for f, c in zip(schema, columns, strict=True)], schema=schema)


def plain_run(text: Column, b: Column | None = None, i: Column | None = None) -> Column:
    return F.struct(text.alias("text"), (F.lit(False) if b is None else b).alias("b"), (F.lit(False) if i is None else i).alias("i"))


def as_pieces(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns of pieces; those that are not given are null."""
    kinds = dict(x.strip().split(" ", 1) for x in PIECES.replace(RUNS, "RUNS").split(","))
    return df.select(*((columns[n] if n in columns else F.lit(None)).cast(RUNS if kinds[n] == "RUNS" else kinds[n]).alias(n) for n in NAMES))


def text_of(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def picture_label(alt: Column) -> Column:
    return F.when(F.length(alt) > 0, F.concat(F.lit("[image: "), alt, F.lit("]"))).otherwise("[image]")


@dataclass(frozen=True)
class Format:
    """How a format puts runs, rows, blocks and the whole."""

    run: Callable[[Column], Column]  # a run
    row: Callable[[Column, Column, Column], Column]  # kind, number from 0 and cells (array of strings) of a row or item
    block: Callable[[Column, Column, Column, Column], Column]  # kind, level, rows (array), most cells of a row
    picture: Callable[[Column, Column, Column, Column], Column]  # number in the file from 1, data, mime, alt
    whole: Callable[[Column], Column]  # blocks (array)
    padded: bool = False  # rows of a table get as many cells as its longest


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _stretches(items: Column, *by: str) -> Column:
    """Neighbours in an array of structs that agree in ``by``, an array each. The array is sorted by that, so that all agree if the ends do."""

    def same(x: Column, y: Column) -> Column:
        agree = x[by[0]].eqNullSafe(y[by[0]])
        for n in by[1:]:
            agree = agree & x[n].eqNullSafe(y[n])
        return agree

    def cut(a: Column) -> Column:
        starts = F.filter(F.transform(a, lambda x, k: F.when((k == 0) | ~same(x, F.get(a, k - 1)), k)), lambda k: k.isNotNull())
        several = bound(starts, lambda found: F.transform(found, lambda s, k: F.slice(a, s + 1, F.coalesce(F.get(found, k + 1), F.size(a)) - s)))
        return F.when(same(a[0], F.get(a, F.size(a) - 1)), F.array(a)).otherwise(several)

    return bound(items, cut)


def _first_of(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: v.isNotNull()), F.lit(0))


def assemble(pieces: DataFrame, f: Format) -> DataFrame:
    """file_id, body, title (text of the first heading) and pictures (array of number, data, mime, alt) of every file. The pieces of a file are gathered and sorted once, without a
    shuffle where they lie by file already; blocks, rows and cells are stretches of them."""
    cell = F.array_join(F.transform(F.col("runs"), f.run), "")
    picture = F.when(F.col("t") == "img", F.struct("data", F.coalesce("mime", F.lit("image/png")).alias("mime"), F.coalesce("alt", F.lit("")).alias("alt")))
    head = F.when(F.col("t") == "h", text_of(F.col("runs")))
    placed = F.struct("seq", "t", "level", "row", "col", cell.alias("cell"), picture.alias("picture"), head.alias("head"))
    files = pieces.groupBy("file_id").agg(F.sort_array(F.collect_list(placed)).alias("placed"))
    block = lambda b: F.struct(b[0]["seq"].alias("seq"), b[0]["t"].alias("t"), b[0]["level"].alias("level"), b.alias("placed"), _first_of(b["picture"]).alias("picture"))
    blocks = files.select("file_id", F.transform(_stretches(F.col("placed"), "seq", "t", "level"), block).alias("blocks"), F.coalesce(_first_of(F.col("placed")["head"]), F.lit("")).alias("title"))
    drawn = F.filter("blocks", lambda b: b["t"] == "img")
    numbered = blocks.withColumn("places", F.transform(drawn, lambda b: b["seq"])).withColumn("pictures", F.transform(drawn, lambda b, k: F.struct((k + 1).alias("number"), b["picture"]["data"].alias("data"), b["picture"]["mime"].alias("mime"), b["picture"]["alt"].alias("alt"))))

    def written(b: Column) -> Column:
        def lines(rows: Column, most: Column) -> Column:
            def line(r: Column) -> Column:
                cells = r["cell"]
                empty = f.run(plain_run(F.lit("")))
                whole = F.concat(cells, F.array_repeat(empty, F.greatest(most - F.size(cells), F.lit(0)))) if f.padded else cells
                return bound(whole, lambda full: f.row(b["t"], r[0]["row"], full))

            return bound(F.transform(rows, line), lambda made: f.block(b["t"], b["level"], made, most))

        text = bound(_stretches(b["placed"], "row"), lambda rows: bound(F.array_max(F.transform(rows, F.size)), lambda most: lines(rows, most)))
        p = b["picture"]
        return F.when(b["t"] == "img", f.picture(F.array_position("places", b["seq"]), p["data"], p["mime"], p["alt"])).otherwise(text)

    return numbered.select("file_id", f.whole(F.transform("blocks", written)).alias("body"), "title", "pictures")
