"""Repeated markup is remembered: the events are those of the parser, whatever a part holds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.operators import convert
from millrace.plans import convert_queries
from millrace.sources import formats, markup, pieces
from millrace.sources.model import CodecError

PARTS = [
    "<a><b>x</b><b>y &amp; z</b></a>",
    "<a>x > y<b> > </b>>></a>",
    "<a><b>x</b><!-- > no < --><b>y</b></a>",
    "<a><b>x</b><![CDATA[> <c> <]]><b>y</b></a>",
    "<a><b>x</b><?p > <?><b>y</b></a>",
    "<a><b k='1>2'>x</b><b k='&#65;&lt;'>y</b></a>",
    "<a><b k='x>y<'>x</b></a>",
    "<a><b>x</b></a><a>y</a>",
    "<a><b>x</a></b>",
    "<a><b>x</b>",
    "<a>x</a>tail<b/>",
    "<a>&#65;<b>&nbsp;</b></a>",
    "<a>&amp;amp;<b>&lt;b&gt;</b></a>",
    "<a>x\r\ny<b>z</b></a>",
    "<a>x\0<b>z</b></a>",
    "<a>x￾<b>z</b></a>",
    "<a k='1' k='2'>x<b>y</b></a>",
    "﻿<a>é<b>ü</b></a>",
    "<?xml version='1.0' encoding='ISO-8859-1'?><a>é<b>y</b></a>",
    "<?xml version='1.0' encoding='utf-8'?><!DOCTYPE a><n:a><n:b m:k='1'>x</n:b></n:a>\n",
    "<!DOCTYPE a [<!ATTLIST b k CDATA 'own'>]><a>x<b>y</b></a>",
    "<!DOCTYPE a [<!ENTITY amp 'own'>]><a>x<b>&amp;</b></a>",
    "<!DOCTYPE a SYSTEM 'b.dtd'><a>x<b>&own;</b></a>",
    "<a><end/>x<end/>y</a>",
    "x<a>y</a>",
    "",
]


def seen(walk, part: bytes) -> list | str:
    """Events, with texts side by side as one."""
    out: list[tuple] = []

    def text(t: str) -> None:
        if out and out[-1][0] == "text":
            t = out.pop()[1] + t
        out.append(("text", t))

    names = ("a", "b", "end")
    try:
        walk(part, {n: lambda attrs, n=n: out.append((n, dict(attrs))) for n in names}, {n: lambda n=n: out.append(("/" + n, None)) for n in names}, text)
    except CodecError:
        return "corrupt"
    return out


def test_remembered_markup_has_the_events_of_the_parser(monkeypatch):
    parts = [p.encode() for p in PARTS] + [b"<a>\xff<b>x</b></a>", "<a>x<b>y</b></a>".encode("utf-16")]
    for encoding in (None, "utf-8"):
        walker = markup.Walker(encoding, markup._local, frozenset(("a", "b", "end")), frozenset(("a", "b", "end")))
        plain = markup.Walker(encoding, markup._local, frozenset(("a", "b", "end")), frozenset(("a", "b", "end")))
        monkeypatch.setattr(plain, "_remembered", lambda data: None)
        for part in parts * 3:
            assert seen(walker.walk, part) == seen(plain.walk, part), part
    assert walker.held > 0


@pytest.mark.parametrize("part", ["<w:document><w:body>%s</w:body></w:document>", "<html><body>%s</body></html>"])
def test_a_part_of_known_markup_needs_no_parser(monkeypatch, part):
    made = []
    real = markup.expat.ParserCreate
    monkeypatch.setattr(markup.expat, "ParserCreate", lambda *a: made.append(1) or real(*a))
    word = "document" in part
    cell = "<w:tc><w:p><w:r><w:t>%s</w:t></w:r></w:p></w:tc>" if word else "<td>%s</td>"
    whole = ("<w:tbl><w:tr>%s</w:tr></w:tbl>" if word else "<table><tr>%s</tr></table>").join(part.split("%s"))
    found = []
    for k in range(50):
        data = (whole % "".join(cell % f"{k} {n}" for n in range(9))).encode()
        found.append(markup.word_blocks(data, {}) if word else markup.xhtml_blocks(data))
    assert len(made) <= 3
    assert [["".join(r["text"] for r in b["runs"]) for b in f] for f in found] == [[f"{k} {n}" for n in range(9)] for k in range(50)]


def test_markup_that_does_not_repeat_is_bounded():
    walker = markup.Walker(None, markup._local)
    each = markup._Each(lambda *told: None)
    for k in range(400):
        walker.walk(("<a>" + "".join(f"<b k='{k}_{n}'>x</b>" for n in range(100)) + "</a>").encode(), each, each, lambda text: None)
    assert 0 < walker.held <= markup._MOST_KNOWN + markup._MOST_NEW
    deep = "".join(f"<e{k}>x" for k in range(3000)) + "".join(f"</e{k}>" for k in reversed(range(3000)))
    walker.walk(deep.encode(), each, each, lambda text: None)


def test_pieces_in_any_order_become_blocks_rows_and_cells(spark):
    cells = [("f", 1, "table", None, r, c, f"{r}{c}") for r, n in ((0, 2), (1, 3), (3, 1)) for c in range(n)]
    rows = [*cells, ("f", 2, "table", None, 0, 0, "next"), ("f", 0, "h", 2, 0, 0, "head"), ("f", 3, "ul", None, 0, 0, "i"), ("f", 3, "ul", None, 1, 0, "j"), ("g", 0, "p", None, 0, 0, "one"), (None, 0, "p", None, 0, 0, "no file")]
    made = spark.createDataFrame([(a, b, t, lv, r, c, [(x, False, False)], None, None, None) for a, b, t, lv, r, c, x in reversed(rows)], pieces.PIECES)
    got = {r.file_id: (r.body, r.title) for r in pieces.assemble(made, formats.TXT).collect()}
    assert got == {"f": ("head\n\n00 | 01\n10 | 11 | 12\n30\n\nnext\n\n- i\n- j\n", "head"), "g": ("one\n", ""), None: ("no file\n", "")}
    word = {r.file_id: r.body for r in pieces.assemble(made, formats.WORD).collect()}["f"]
    assert [row.count("<w:tc>") for row in word.split("<w:tr>")[1:]] == [3, 3, 3, 1]


@pytest.mark.parametrize("name", ["epub_tables", "docx_tables"])
def test_tables_are_dealt_once_and_not_written_between(spark, name):
    made = convert_queries.Q[name](spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Scan parquet") == 1


def test_files_read_as_more_than_pieces_are_refused(spark):
    files = spark.createDataFrame([("1", "a.txt", 1, bytearray(b"x"))], "hid string, name string, size long, content binary")
    with pytest.raises(Exception, match="more than pieces"):
        convert.read_pieces(files).collect()
    broken = files.withColumn("name", F.lit("a.docx"))
    assert convert.read_pieces(broken).collect() == []


def test_the_width_of_a_cell_is_computed_once_a_row(spark):
    """And not within what is done for each cell."""
    rows = spark.createDataFrame([("a", 0, "table", None, 0, c, [("x", False, False)], None, None, None) for c in range(4)], pieces.PIECES)
    made = pieces.assemble(rows, formats.WORD)
    assert made.first().body.count('<w:tcW w:type="dxa" w:w="2256"/>') == 4
    plan = made._jdf.queryExecution().analyzed().toString()
    per_cell = plan[plan.index("concat(<w:tr>") :].split("</w:p></w:tc>")[0]
    assert "FLOOR" not in per_cell[per_cell.index("array_join(transform(") :].split("lambdafunction(concat(")[-1]
