"""What keeps the work a file small: shared batches, parts that are packed once, ends that are trimmed without a pattern."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from millrace.functions.text import trim
from millrace.operators import convert, layout


def test_small_files_share_a_batch():
    made = list(convert._batches(([{"kind": "file", "file_id": str(k)}, {"kind": "txt", "file_id": str(k), "body": "x"}], 1) for k in range(1000)))
    assert [b.num_rows for b in made] == [2000]
    large = list(convert._batches(([{"kind": "file", "file_id": str(k)}], convert.BATCH_BYTES) for k in range(3)))
    assert [b.num_rows for b in large] == [1, 1, 1]
    assert [b.num_rows for b in convert._batches([([{"kind": "file"}] * 12000, 1)])] == [5000, 5000, 2000]


def test_ends_are_trimmed_up_to_the_end(spark):
    """A sign that ends a line for patterns, and is no white space, keeps what is before it."""
    row = spark.range(1).select(trim(F.lit(" a \u0085")).alias("t"), layout.paragraphs(F.lit("﻿ a\r\n b \u0085\n \t\n \nc  d \n")).alias("p"), layout.paragraphs(F.lit(" \n ")).alias("e")).first()
    assert (row.t, row.p, row.e) == ("a \u0085", ["a b \u0085", "c  d"], [""])


def test_fixed_members_are_packed_once(monkeypatch):
    from millrace.sources import archive

    packed = []
    real = zlib.compressobj
    monkeypatch.setattr(archive.zlib, "compressobj", lambda *a: packed.append(1) or real(*a))
    archive._deflate_small.cache_clear()
    made = [archive.write([("fixed", b"same " * 100, True), ("own", b"%d" % k, True)]) for k in range(50)]
    assert len(packed) == 51
    assert [archive.read(m)["own"] for m in made] == [b"%d" % k for k in range(50)]


def test_well_formed_pages_read_as_pages_do():
    from millrace.sources.markup import html_blocks, xhtml_blocks

    page = "<html><head><title>x</title></head><body><h1>A &amp; b</h1><p>one<br/>two <b>three</b></p><ul><li>x</li></ul><table><tr><td>1</td><td/><td>&lt;</td></tr></table><p>%s</p>%s</body></html>"
    for inner, rest in (("plain", ""), ("a&nbsp;b", ""), ("&#233;", ""), ("x", "<p>open")):
        text = page % (inner, rest)
        assert xhtml_blocks(text.encode()) == html_blocks(text)


def test_pages_of_a_pdf_share_their_fonts():
    from millrace.sources import pdf, pdfread

    piece = {"seq": 0, "row": 0, "col": 0, "t": "p", "level": None, "runs": [{"text": "some (words) \\ of it " * 1500, "b": False, "i": False}], "data": None, "w": None, "h": None}
    made = pdf._file([piece])
    objects = pdfread.Objects(made)
    pages = list(objects.pages())
    for page in pages:
        pdfread.Page(objects).run(objects.bytes_of(objects.get(page["Contents"])), objects.get(page["Resources"]))
    assert (len(pages) > 2, len(objects.fonts)) == (True, 1)
    assert " ".join(r["body"] for r in pdfread.glyphs(made)).split() == piece["runs"][0]["text"].split()


def test_words_wrap_where_they_no_longer_fit():
    from millrace.sources import pdf

    runs = [{"text": "ab cd", "b": False, "i": False}, {"text": "ef gh", "b": True, "i": False}]
    tokens = list(pdf._tokens(runs, False))
    assert [(t[0], t[1], t[2]) for t in tokens] == [("ab", 0, False), ("cd", 0, False), ("ef", 1, True), ("gh", 1, False)]
    assert pdf._wrapped(tokens, 1e9) == [[(0, "ab cd"), (1, "ef gh")]]
    assert pdf._wrapped(tokens, 1.0) == [[(0, "ab")], [(0, "cd")], [(1, "ef")], [(1, "gh")]]
    assert pdf._wrapped([], 1.0) == [[]]


def test_the_width_of_a_table_is_computed_once(spark):
    """Not anew for each of its rows, which grows with their square."""
    from millrace.sources import formats, pieces

    rows = spark.createDataFrame([("a", 0, "table", None, 0, 0, [("x", False, False)], None, None, None)], pieces.PIECES)
    plan = pieces.assemble(rows, formats.WORD)._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_max(") == 1


def test_parts_are_dealt_out_before_they_become_videos(spark, monkeypatch):
    from millrace.plans import convert_queries

    seen = []
    real = convert_queries.c.probe_videos
    monkeypatch.setattr(convert_queries.c, "probe_videos", lambda files: seen.append(files) or real(files))
    convert_queries.video_probe(spark, "/root/testdata/sf0.001")
    assert "RepartitionByExpression" in seen[0]._jdf.queryExecution().analyzed().toString()
