"""Readers, writers, scans and streams on small files."""

from __future__ import annotations

import html.parser
import io
import re
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from millrace.catalog import QUERIES
from millrace.functions import glyphs
from millrace.operators import convert as c
from millrace.operators import layout
from millrace.sources import archive, media, packages, readers, rtf, scan
from millrace.streaming import flows

SF_DIR = "/root/testdata/sf0.001"
MD = """# Title *x*

Para **bold** and *it*
goes on

- a
- b

1. one
2. two

| h | k |
|---|---|

| 1 | **2** |
![p](data:image/png;base64,aGVsbG8=)
![q](http://x/y.png)
last & <x>
"""
WRITTEN = """# Title *x*

Para **bold** and *it* goes on

- a
- b

1. one
2. two

| h | k |
| --- | --- |
| 1 | **2** |

![p](data:image/png;base64,aGVsbG8=)

*[image: q]*

last & <x>
"""


def files(spark, *rows):
    return spark.createDataFrame([(str(k), n, len(b), bytearray(b)) for k, (n, b) in enumerate(rows)], "hid string, name string, size long, content binary")


def converted(spark, target, *rows):
    return {r.hid: r for r in c.convert(files(spark, *rows), target).collect()}


def test_markdown(spark):
    assert bytes(converted(spark, "MD", ("a.md", MD.encode()))["0"].content).decode() == WRITTEN


@pytest.mark.parametrize("target", ["DOCX", "EPUB"])
def test_packages_there_and_back(spark, target):
    made = converted(spark, target, ("a.md", MD.encode()))["0"]
    with zipfile.ZipFile(io.BytesIO(bytes(made.content))) as z:
        assert z.testzip() is None
        if target == "EPUB":
            assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == 0
    back = converted(spark, "MD", (made.name, bytes(made.content)))["0"]
    assert bytes(back.content).decode().replace("![image]", "![p]") == WRITTEN


def test_rich_text(spark):
    source = r"{\rtf1\ansi{\fonttbl{\f0 X;}}{\b bold\b0  plain} \'95 " + "\\" + "u8212?" + r" \u-3913?x\par second}"
    assert [(b["t"], "".join(r["text"] for r in b["runs"])) for b in rtf.read(source)] == [("p", "bold plain • — x"), ("p", "second")]
    got = converted(spark, "TXT", ("a.rtf", source.encode()), ("b.rtf", b"no rich text"))
    assert (got["0"].code, got["1"].code) == (None, "rtf-corrupt") and got["1"].content is None


def test_codes(spark):
    def zipped(*entries):
        return archive.write((n, d, True) for n, d in entries)

    broken = bytearray(zipped(("word/document.xml", b"<w:p/>" * 20)))
    broken[50] ^= 0xFF
    locked = bytearray(zipped(("a", b"x")))
    locked[locked.rfind(b"PK\x01\x02") + 8] |= 1
    rows = [("a.docx", b"nothing"), ("b.docx", zipped(("x", b"y"))), ("c.docx", zipped(("word/document.xml", b"<w:body></w:body>"))), ("d.docx", bytes(broken)), ("e.docx", bytes(locked)), ("f.epub", zipped(("x", b"y"))), ("g.pdf", b"%PDF"), ("h.xyz", b""), ("i.txt", b"")]
    got = converted(spark, "TXT", *rows)
    assert [got[str(k)].code for k in range(9)] == ["zip-corrupt", "docx-corrupt", "docx-no-text", "zip-corrupt", "zip-encrypted", "epub-corrupt", "pdf-unsupported", "decode-failed", None]
    assert bytes(got["8"].content) == b"\n"
    assert {r.code for r in c.convert(files(spark, ("a.txt", b"x")), "MP3").collect()} == {"unsupported-target"}


def test_epub_with_paths_and_open_paragraphs(spark):
    chapter = b"<html><head><title>no</title></head><body><p>one<p>two &amp; &#8212; <b>b</b><div><ul><li>i<li>j</ul></div><img src='../pic.png' alt='x'><img src='gone.png' alt='y'></body></html>"
    opf = b'<package><manifest><item id="c" href="text/../text/c.html" media-type="text/html"/><item id="s" href="s.css" media-type="text/css"/></manifest><spine><itemref idref="s"/><itemref idref="c"/></spine></package>'
    data = archive.write([("META-INF/container.xml", b'<rootfile media-type="x" full-path="O/p.opf"/>', True), ("O/p.opf", opf, True), ("O/text/c.html", chapter, True), ("O/pic.png", b"PIC", False)])
    found = c.parts(files(spark, ("a.epub", data)))
    got = [(r.t, "".join(x.text for x in r.runs), bytes(r.data or b"")) for r in c.pieces_of(found).orderBy("seq", "row", "col").collect()]
    assert got == [("p", "one", b""), ("p", "two & — b", b""), ("ul", "i", b""), ("ul", "j", b""), ("img", "", b"PIC"), ("p", "[image: y]", b"")]
    assert found.where("code IS NOT NULL").count() == 0


class _Texts(html.parser.HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "head")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "head")

    def handle_data(self, data):
        if self.skip <= 0:
            self.out.append(data)


def test_pages_lose_no_text(spark):
    """The words of the blocks are those that the standard parser finds outside of heads, scripts and styles."""
    want = {}
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect():
        p = _Texts()
        p.feed(r.html or "")
        want[r.page_id] = re.sub(r"\s+", "", "".join(p.out))
    got: dict = dict.fromkeys(want, "")
    for r in QUERIES["html_blocks"](spark, SF_DIR).where("t <> 'img'").orderBy("page_id", "seq", "row", "col").collect():
        got[r.page_id] += re.sub(r"\s+", "", r.text)
    assert got == want


def test_pdf_objects_are_where_the_table_says(spark):
    made = bytes(converted(spark, "PDF", ("a.md", (MD + "\n\nword " * 900).encode()))["0"].content)
    at = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", made)[1])
    places = [int(x) for x in re.findall(rb"(\d{10}) 00000 n ", made[at:])]
    assert made[at : at + 4] == b"xref" and all(made[p:].startswith(f"{k} 0 obj\n".encode()) for k, p in enumerate(places, 1))
    assert len(re.findall(rb"/Type/Page/Parent", made)) > 1 and rb"<x>" in made
    for n, body in re.findall(rb"/Length (\d+)>>stream\n(.*?)\nendstream", made, re.S):
        assert int(n) == len(body)
    assert QUERIES["pdf_files"](spark, SF_DIR).where("NOT sound OR code IS NOT NULL").count() == 0


def test_wrap_against_a_plain_fold(spark):
    w, texts = glyphs.WIDTHS, [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    size = lambda s: sum(w[b] for b in s.encode("cp1252", "replace")) * 11 / 1000
    want = []
    for t in texts:
        lines: list[str] = []
        for word in t.split():
            if lines and size(f"{lines[-1]} {word}") <= 200:
                lines[-1] += f" {word}"
            else:
                lines.append(word)
        want += lines or [""]
    assert sorted(r.line for r in QUERIES["pdf_wrap"](spark, SF_DIR).collect()) == sorted(want)


def test_check_sums(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r.doc_id: r.crc for r in QUERIES["crc32_text"](spark, SF_DIR).collect()} == {d: None if t is None else zlib.crc32(t.encode()) for d, t in docs.items()}


def test_heads(spark):
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 480) + b"\x08\2\0\0\0" + b"\0" * 9
    frame = b"\xff\xc2\0\x11\x08" + struct.pack(">HH", 33, 44) + b"\3" + b"\0" * 30
    jpeg = b"\xff\xd8" + b"\xff\xe0\0\x04ab" + b"\xff\xc4\0\x05abc" + frame
    rows = files(spark, ("a", png), ("b", jpeg), ("c", b"short"), ("d", b"\xff\xd8" + b"\0" * 40))
    got = {r.hid: (r.p, r.j) for r in rows.select("hid", media.png_size(F.col("content")).alias("p"), media.jpeg_size(F.col("content")).alias("j")).collect()}
    assert (tuple(got["0"][0]), got["0"][1]) == ((640, 480), None)
    assert (got["1"][0], tuple(got["1"][1])) == (None, (44, 33))
    assert got["2"] == (None, None) and got["3"] == (None, None)


def test_wav(spark):
    import wave

    sounds = spark.createDataFrame([("s", 8000, [0.0, 1.0, -1.0, 2.0], [0.5, -0.5, 0.0, 0.25])], "file_id string, rate int, left array<float>, right array<float>")
    made = media.write_wav(sounds)
    with wave.open(io.BytesIO(bytes(made.first().content))) as w:
        assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (2, 8000, 2, 4)
        assert struct.unpack("<8h", w.readframes(4)) == (0, 16383, 32767, -16384, -32768, 0, 32767, 8191)
    assert media.read_wav(files(spark, ("x", b"no sound")).select(F.col("hid").alias("file_id"), "content")).first().code == "decode-failed"


def test_png_and_svg(spark, tmp_path):
    rows = spark.createDataFrame([("p", 2, 1, 3, bytearray([1, 2, 3, 4, 5, 6]))], "file_id string, width int, height int, channels int, data binary")
    content = bytes(media.write_png(rows).first().content)
    (tmp_path / "p.png").write_bytes(content)
    (tmp_path / "broken.png").write_bytes(b"x")
    seen = media.pictures(spark, str(tmp_path)).collect()
    assert [(r.width, r.height, bytes(r.data)) for r in seen] == [(2, 1, bytes([1, 2, 3, 4, 5, 6]))]
    svg = files(spark, ("p", content)).select(media.svg_wrapper(F.col("content"), F.lit("image/png"), F.lit(2), F.lit(1), F.lit("a<b")).alias("s")).first().s
    assert svg.startswith("<svg ") and "a&lt;b" in svg and "data:image/png;base64,iVBOR" in svg


def test_scan_and_save(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a b+c.txt").write_bytes(b"hello\n\nthere")
    (tmp_path / "in" / "deep" / "x.md").write_bytes(b"# h")
    found = scan.scan_files(spark, str(tmp_path / "in"))
    assert {(r.name, r.size, r.family) for r in found.collect()} == {("a b+c.txt", 12, "document"), ("x.md", 3, "document")}
    assert scan.sample_file(spark, str(tmp_path / "in"), "x.md").count() == 1
    assert [r.size for r in scan.save_files(c.convert(found, "TXT"), str(tmp_path / "out")).orderBy("name").collect()] == [13, 2]
    assert (tmp_path / "out" / "x.txt").read_bytes() == b"h\n"
    assert scan.job_parameters(spark, target="PDF") == {"staged": "", "target": "PDF"}


def test_members_as_a_table_function(spark):
    packages.register_functions(spark)
    files(spark, ("a.zip", archive.write([("x/", b"", False), ("x/y", b"1", True), ("z", b"2", False)])), ("b.zip", b"")).createOrReplaceTempView("zips")
    got = spark.sql("SELECT f.hid, m.name, m.data, m.code FROM zips f, LATERAL zip_members(f.content) m").collect()
    assert sorted((r.hid, r.name or "", bytes(r.data or b""), r.code or "") for r in got) == [("0", "x/y", b"1", ""), ("0", "z", b"2", ""), ("1", "", b"", "zip-corrupt")]


def test_arrivals(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: flows.keep_converting(scan.arrivals(spark, str(tmp_path / "in")), "TXT", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in" / "a.txt").write_bytes(b"one")
    run()
    (tmp_path / "in" / "b.md").write_bytes(b"# two")
    (tmp_path / "in" / "c.docx").write_bytes(b"broken")
    run()
    assert {(r.entry_name, r.code) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.txt", None), ("b.md", None), ("c.docx", "zip-corrupt")}


def test_history_stream_is_the_batch_result(spark, tmp_path):
    from millrace.operators.lists import dedup_history, top_history

    schema = "id string, name string, size long, format string, state string, ts long"
    rows = [(f"i{k}", f"n{k % 13}", k % 3, "PNG", "done", k * 7 % 101) for k in range(60)]
    for part in (rows[:25], rows[25:40], rows[40:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        flows.keep_history(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("state="))
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out" / f"state={last}")).collect()}
    assert got == {r.id for r in top_history(dedup_history(spark.createDataFrame(rows, schema), ["name", "size"])).collect()}


def test_late_replies_do_not_show(spark, tmp_path):
    spark.createDataFrame([("a", 2, "new"), ("a", 1, "late"), ("b", 5, "x")], "tile string, request int, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("tile string, request int, text string").parquet(str(tmp_path / "in"))
    query = flows.latest_replies(stream, ["tile"]).writeStream.format("memory").queryName("replies").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.tile, r.text) for r in spark.table("replies").collect()} == {("a", "new"), ("b", "x")}
    chunks = spark.createDataFrame([("f", 1, bytearray(b"lo")), ("f", 0, bytearray(b"hel"))], "file_id string, seq int, data binary")
    assert bytes(flows.joined_chunks(chunks).first().content) == b"hello"


def test_excerpt_and_recognised_text(spark):
    parts = ["  a  b ", "", "x" * 300, "y"]
    df = spark.createDataFrame([(parts,)], "parts array<string>")
    assert df.select(layout.excerpt(F.col("parts")).alias("e")).first().e == ("a b " + "x" * 300)[:239] + "…"
    pages = spark.createDataFrame([("f", 1, "two\nlines\n \n\nnext"), ("f", 0, " first ")], "file_id string, page int, text string")
    assert ["".join(x.text for x in r.runs) for r in readers.read_ocr(pages).orderBy("seq").collect()] == ["first", "two lines", "next"]
