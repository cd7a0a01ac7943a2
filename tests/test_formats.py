"""Broken and foreign files, marked-up parts, pictures, sound, PDF and the sink, each against the standard library or plain code."""

from __future__ import annotations

import base64
import io
import struct
import time
import wave
import zipfile
import zlib
from xml.dom import minidom

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import convert as c
from millrace.plans.capabilities import capabilities
from millrace.sources import archive, markup, media, pdf, pdfread, raster, scan, sound
from millrace.sources.model import CodecError


BACK = bytes([92])


def files(spark, *rows):
    return spark.createDataFrame([(str(k), n, len(b), bytearray(b)) for k, (n, b) in enumerate(rows)], "hid string, name string, size long, content binary")


def converted(spark, target, *rows, **more):
    return {r.hid: r for r in c.convert(files(spark, *rows), target, **more).collect()}


def shown(blocks):
    return [(b["t"], b["row"], b["col"], "".join(r["text"] for r in b["runs"])) for b in blocks]


def picture(height: int, width: int, channels: int = 3) -> np.ndarray:
    y, x = np.mgrid[:height, :width]
    full = np.stack([x * 255 // max(1, width - 1), y * 255 // max(1, height - 1), (x + y) % 256, np.where(x < width // 2, 255, 100)], axis=2).astype(np.uint8)
    return full[..., :channels]


def solid(pixels: np.ndarray) -> np.ndarray:
    return np.concatenate([pixels, np.full((*pixels.shape[:2], 1), 255, np.uint8)], axis=2)


def test_no_bytes_fail_the_batch(spark):
    rows = [("a.txt", b"caf\xe9"), ("b.txt", "﻿good".encode()), ("c.md", b"# \xff\xfe"), ("d.rtf", b"{" + BACK + b"rtf1 " + BACK + b"u99999999 x" + BACK + b"u21776?6" + BACK + b"'e9}"), ("e.rtf", b"{\\rtf1 " + b"{" * 5000), ("f.docx", b"PK\x05\x06" + b"\0" * 18), ("g.pdf", b"%PDF-1.7\n1 0 obj\n<</Type/Catalog"), ("h.wav", b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + b"\0" * 16 + b"data\0\0\0\0"), ("i.png", b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + b"\xff" * 17), ("j.epub", b""), ("k.jpg", b"\xff\xd8\xff\xe0\0\0")]
    got = converted(spark, "TXT", *rows)
    assert len(got) == len(rows)
    assert [bytes(got[str(k)].content).decode() for k in range(4)] == ["caf�\n", "good\n", "��\n", "\N{REPLACEMENT CHARACTER}唐6é\n"]
    assert [got[str(k)].code for k in range(5, 11)] == ["docx-corrupt", "pdf-unsupported", "decode-failed", "decode-failed", "zip-corrupt", "decode-failed"]
    for k, (name, _) in enumerate(rows):
        assert (got[str(k)].content is None) == (got[str(k)].code is not None), name


def test_random_bytes_get_a_code(spark):
    r = np.random.default_rng(3)
    heads = {".docx": b"PK\3\4", ".pdf": b"%PDF-1.4\n", ".rtf": b"{\\rtf1 ", ".wav": b"RIFF\0\0\0\0WAVE", ".png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR", ".txt": b"", ".md": b"", ".epub": b"PK\5\6", ".jpg": b"\xff\xd8"}
    rows = [(f"x{ext}", head + r.bytes(200)) for ext, head in heads.items() for _ in range(12)]
    assert len(converted(spark, "TXT", *rows)) == len(rows)


def test_content_is_read_once(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.md").write_bytes(b"# two")
    found = scan.scan_files(spark, str(tmp_path))
    plan = c.convert(found, "TXT")._jdf.queryExecution().toString()
    assert "binaryFile" not in plan  # what follows reads the written parts
    assert found._jdf.queryExecution().optimizedPlan().toString().count("binaryFile") == 1


def test_a_reader_that_never_ends_costs_its_limit(monkeypatch):
    monkeypatch.setitem(c.READERS, ".txt", lambda content: time.sleep(30))
    start = time.time()
    assert c.read_one(".txt", b"x", 0.2) == ([], "encode-timeout") and time.time() - start < 5
    assert c.read_one(".md", b"x", 5)[1] is None


def test_an_archive_that_grows_too_large():
    bomb = archive.write([("a", b"\0" * 3_000_000, True)])
    with pytest.raises(CodecError):
        archive.read(bomb, most=1_000_000)
    lying = bytearray(bomb)
    at = lying.rfind(b"PK\x01\x02")
    lying[at + 24 : at + 28] = struct.pack("<I", 10)
    with pytest.raises(CodecError):
        archive.read(bytes(lying))


def test_pages():
    page = """<title>no</title><p>if a < b then</p><img alt='x>y' src=p.png><table><tr><th>h</th><td></td><td>z <table><tr><td>in</td></tr></table></td></tr>
    <tr></tr><tr><td>1</td></tr></table><ul><li>a<ul><li>b <b>c</b></li></ul></li><li>d</li></ul><h2>x<br>y</h2>tail &amp; &#8212; &nosuch;"""
    assert shown(markup.html_blocks(page)) == [
        ("p", 0, 0, "if a < b then"), ("img", 0, 0, ""), ("table", 0, 0, "h"), ("table", 0, 1, ""), ("table", 0, 2, "z in"), ("table", 1, 0, "1"),
        ("ul", 0, 0, "a"), ("ul", 1, 0, "b c"), ("ul", 2, 0, "d"), ("h", 0, 0, "x\ny"), ("p", 0, 0, "tail & — &nosuch;"),
    ]
    drawn = [b for b in markup.html_blocks(page) if b["t"] == "img"]
    assert (drawn[0]["mime"], drawn[0]["alt"]) == ("p.png", "x>y")
    assert [r["b"] for b in markup.html_blocks(page) for r in b["runs"] if b["t"] == "table"][:2] == [True, False]


def test_word_parts():
    ns = 'xmlns:w="w" xmlns:r="r" xmlns:a="a"'
    run = lambda t, style="": f"<w:r><w:rPr>{style}</w:rPr> <w:t>{t}</w:t><w:t/></w:r>"
    item = lambda t, n: f'<w:p><w:pPr><w:numPr><w:numId w:val="{n}"/></w:numPr></w:pPr>{run(t)}</w:p>'
    cell = lambda *ps: "<w:tc>" + "".join(f"<w:p>{p}</w:p>" for p in ps) + "</w:tc>"
    body = (
        f'<w:p>{run("a")}{run("b", "<w:b/>")}{run("c", "<w:b/>")}{run("d", "<w:b w:val=\'0\'/><w:i/>")}</w:p>  <w:p/>'
        + item("x", 1) + "<w:p/>" + item("y", 1) + item("n", 2)
        + f"<w:tbl><w:tr>{cell()}{cell(run('z'), '', run('w'))}</w:tr><w:tr>{cell(run('q'))}</w:tr></w:tbl>"
        + '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>h</w:t><w:tab/><w:t>i</w:t></w:r><w:r><w:drawing><a:blip r:embed="p1"/></w:drawing></w:r></w:p>'
    )
    blocks = markup.word_blocks(f"<w:document {ns}><w:body>{body}</w:body></w:document>".encode(), {"p1": (b"PIC", "image/png")})
    assert shown(blocks) == [("p", 0, 0, "abcd"), ("ul", 0, 0, "x"), ("ul", 1, 0, "y"), ("ol", 0, 0, "n"), ("table", 0, 0, ""), ("table", 0, 1, "z w"), ("table", 1, 0, "q"), ("h", 0, 0, "h\ti"), ("img", 0, 0, "")]
    assert [(r["text"], r["b"], r["i"]) for r in blocks[0]["runs"]] == [("a", False, False), ("bc", True, False), ("d", False, True)]
    for bad in (b"<w:document>", b'<!DOCTYPE x [<!ENTITY e "x">]><x>&e;</x>', b"<none/>"):
        with pytest.raises(CodecError):
            markup.word_blocks(bad, {})


RICH = "# Title\n\nPara **bold** and *it* wo**rd**\n\n- a\n- b\n\n| h |  | k |\n|---|---|---|\n| 1 |\n\n![p](data:image/png;base64,%s)\n\nlast & (x)\n"


def rich() -> bytes:
    return (RICH % base64.b64encode(raster.png(solid(picture(30, 50)))).decode()).encode()


def test_packages_hold_sound_parts(spark):
    made = converted(spark, "DOCX", ("a.md", rich()))["0"]
    with zipfile.ZipFile(io.BytesIO(bytes(made.content))) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    for n in (n for n in parts if n.endswith((".xml", ".rels"))):
        minidom.parseString(parts[n])
    doc = minidom.parseString(parts["word/document.xml"])
    frame = doc.getElementsByTagName("wp:inline")[0]
    extent = frame.getElementsByTagName("wp:extent")[0]
    assert (extent.getAttribute("cx"), extent.getAttribute("cy")) == (str(50 * 9525), str(30 * 9525))
    embed = frame.getElementsByTagName("a:blip")[0].getAttribute("r:embed")
    rel = next(r for r in minidom.parseString(parts["word/_rels/document.xml.rels"]).getElementsByTagName("Relationship") if r.getAttribute("Id") == embed)
    assert "word/" + rel.getAttribute("Target") in parts
    assert [len(r.getElementsByTagName("w:tc")) for r in doc.getElementsByTagName("w:tr")] == [3, 3]
    assert doc.getElementsByTagName("w:tblBorders") and len(doc.getElementsByTagName("w:gridCol")) == 3
    book = converted(spark, "EPUB", ("a.md", rich()))["0"]
    with zipfile.ZipFile(io.BytesIO(bytes(book.content))) as z:
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        for n in z.namelist()[1:]:
            if not n.endswith(".png"):
                minidom.parseString(z.read(n))
        assert b"<dc:title>Title</dc:title>" in z.read("book/book.opf")


def foreign(table: bool = False) -> bytes:
    """A file with a compressed table of objects, an object stream and a font with a map of two-byte codes."""
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Type/Pages/Kids[3 0 R]/Count 1/Resources<</Font<</A 4 0 R>>>>>>", 3: b"<</Type/Page/Parent 2 0 R/Contents[5 0 R]>>", 4: b"<</Type/Font/Subtype/Type0/Encoding/Identity-H/DescendantFonts[6 0 R]/ToUnicode 7 0 R>>", 6: b"<</DW 500/W[1[600 600 300]]>>"}
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0001> <0002> <00E9> endbfrange 2 beginbfchar <0003> <0020> <0004> <D83DDE00> endbfchar"
    content = b"q 1 0 0 1 0 0 cm BT /A 12 Tf 72 700 Td [<0001> -300 <0002>] TJ <00030004> Tj 0 -30 Td <00020001> Tj ET Q"
    out, place = bytearray(b"%PDF-1.5\n"), {}
    for n, data in ((5, content), (7, cmap)):
        place[n] = len(out)
        packed = zlib.compress(data)
        out += b"%d 0 obj\n<</Length %d/Filter/FlateDecode>>\nstream\n" % (n, len(packed)) + packed + b"\nendstream\nendobj\n"
    heads = body = b""
    for n, o in objects.items():
        heads += b"%d %d " % (n, len(body))
        body += o + b" "
    place[8] = len(out)
    out += b"8 0 obj\n<</Type/ObjStm/N %d/First %d/Length %d>>\nstream\n" % (len(objects), len(heads), len(heads + body)) + heads + body + b"\nendstream\nendobj\n"
    place[9] = at = len(out)
    rows = [struct.pack(">BHB", 2, 8, list(objects).index(n)) if n in objects else struct.pack(">BHB", 1, place[n], 0) if n in place else bytes(4) for n in range(10)]
    filtered = b"".join(b"\2" + bytes((a - b) & 255 for a, b in zip(row, before, strict=True)) for row, before in zip(rows, [bytes(4), *rows], strict=False))
    packed = zlib.compress(filtered)
    out += b"9 0 obj\n<</Type/XRef/Size 10/W[1 2 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>/Length %d>>\nstream\n" % len(packed) + packed + b"\nendstream\nendobj\n"
    return bytes(out + b"startxref\n%d\n%%%%EOF" % at)


def plain_pdf(content: bytes, extra: bytes = b"") -> bytes:
    """A file without a table of objects, with an encoding by differences."""
    font = b"<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[65/eacute/uni4E2D/fi 97/space]>>>>"
    return b"%PDF-1.3\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Type/Pages/Kids[3 0 R]>>endobj 3 0 obj<</Type/Page/Resources<</Font<</F 4 0 R>>>>/Contents 5 0 R>>endobj 4 0 obj" + font + b"endobj 5 0 obj<</Length 1>>stream\n" + content + b"\nendstream endobj" + extra


def test_foreign_pdfs(spark):
    ways = [foreign(), foreign().replace(b"startxref", b"startxxxx"), plain_pdf(b"BT /F 10 Tf 14 TL 1 0 0 1 50 700 Tm (AB) Tj 20 0 Td (C\\141z) ' ET"), plain_pdf(b"0 0 m 5 5 l S"), plain_pdf(b"BT ET", b" trailer<</Encrypt 9 0 R/Root 1 0 R>>")]
    got = converted(spark, "TXT", *((f"{k}.pdf", w) for k, w in enumerate(ways)))
    text = "é ê 😀\n\nêé\n"
    assert [bytes(got[str(k)].content or b"").decode() for k in range(3)] == [text, text, "é中 ﬁ z\n"] or bytes(got["2"].content).decode().split() == ["é中", "ﬁ", "z"]
    assert [got[str(k)].code for k in (3, 4)] == ["pdf-no-text", "pdf-unsupported"]


def test_own_pdfs_give_their_paragraphs_back(spark):
    text = "First paragraph of many words. " * 20 + "\n\nSecond (with \\ marks) – and “quotes”.\n\n" + "Third one runs on. " * 30
    made = converted(spark, "PDF", ("a.txt", text.encode()), ("b.md", rich()))
    back = converted(spark, "TXT", ("a.pdf", bytes(made["0"].content)), ("b.pdf", bytes(made["1"].content)))
    assert bytes(back["0"].content).decode() == "\n\n".join(" ".join(p.split()) for p in text.split("\n\n")) + "\n"
    assert bytes(back["1"].content).decode().split("\n\n") == ["Title", "Para bold and it word", "• a", "• b", "h k", "1", "last & (x)\n"]


def test_pdf_has_pictures_faces_and_rules(spark):
    rows = "\n".join(f"| {k} | {'cell ' * 30} |" for k in range(60))
    data = bytes(converted(spark, "PDF", ("a.md", rich() + b"\n\n| a | b |\n|---|---|\n" + rows.encode()))["0"].content)
    objects = pdfread.Objects(data)
    pages = list(objects.pages())
    contents = [objects.bytes_of(objects.get(p["Contents"])) for p in pages]
    assert len(pages) > 2 and all(b" re S" in x for x in contents)
    assert b"/F2 20 Tf (Title)" in contents[0] and b"/F3 11 Tf ( it)" in contents[0] and b"/F2 11 Tf (rd)" in contents[0] and b"/P1 Do" in contents[0]
    image = objects.get(objects.get(pages[0]["Resources"]["XObject"])["P1"])
    assert (image.head["Width"], image.head["Height"]) == (50, 30)
    assert objects.bytes_of(image) == picture(30, 50).tobytes()
    for x in contents:  # nothing lies below the margin
        assert all(float(line.split()[1]) > 70 for line in x.split(b"\n") if line.endswith(b"re S"))
    jpeg = raster.jpeg(picture(16, 24))
    assert pdf._image(jpeg)[1] == jpeg and "/DCTDecode" in pdf._image(jpeg)[0]


@pytest.mark.parametrize("size", [(1, 1), (9, 5), (40, 33)])
def test_png_there_and_back(size):
    for channels in (3, 4):
        pixels = picture(*size, channels)
        full = solid(pixels) if channels == 3 else pixels
        assert (media.png_rows(raster.png(full)) == full).all()


def filtered_png(pixels: np.ndarray, kind: int, bits: int, rows: list[bytes], palette: bytes = b"") -> bytes:
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], bits, kind, 0, 0, 0)) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_filters():
    pixels = picture(5, 7)
    flat = pixels.reshape(5, 21).astype(int)
    rows = []
    for how in range(5):
        line = []
        for j in range(21):
            a, b, cc = flat[how][j - 3] if j >= 3 else 0, flat[how - 1][j] if how else 0, flat[how - 1][j - 3] if how and j >= 3 else 0
            p = a + b - cc
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - cc), 2, cc))[2]
            line.append((flat[how][j] - [0, a, b, (a + b) // 2, best][how]) % 256)
        rows.append(bytes([how, *line]))
    assert (media.png_rows(filtered_png(pixels, 2, 8, rows))[..., :3] == pixels).all()
    two = np.array([[0, 1, 1, 0, 1, 0, 0, 1, 1, 1]])
    got = media.png_rows(filtered_png(two, 3, 1, [bytes([0, 0b01101001, 0b11000000])], b"\1\2\3\4\5\6"))
    assert (got[0, :, 0] == np.where(two[0], 4, 1)).all()


def test_jpeg_is_what_another_reader_sees(spark, tmp_path):
    """Spark's own image reader gives the pixels back, within what the steps allow."""
    for k, (h, w) in enumerate([(64, 48), (33, 50), (8, 8), (1, 3)]):
        (tmp_path / f"{k}.jpg").write_bytes(raster.jpeg(picture(h, w) // 2, 95))
    (tmp_path / "9.jpg").write_bytes(raster.jpeg(np.random.default_rng(1).integers(0, 255, (40, 40, 3), np.uint8), 90))
    seen = {r.origin[-5]: r for r in media.pictures(spark, str(tmp_path)).collect()}
    assert len(seen) == 5
    for k, (h, w) in enumerate([(64, 48), (33, 50), (8, 8), (1, 3)]):
        r = seen[str(k)]
        got = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, 3)[..., ::-1].astype(int)
        assert got.shape == (h, w, 3) and np.abs(got - picture(h, w) // 2).mean() < 4


def test_fitting_and_flattening():
    wide = raster.fitted(picture(10, 200, 4), 50)
    assert wide.shape == (3, 50, 4) and abs(int(wide[..., 0].mean()) - int(picture(10, 200)[..., 0].mean())) <= 2
    even = raster.fitted(np.repeat(np.repeat(picture(6, 8), 4, 0), 4, 1), 8)
    assert (even == picture(6, 8)).all()
    clear = np.zeros((1, 1, 4), np.uint8)
    assert (raster.flattened(clear) == 255).all()


def test_pictures_and_sound_convert(spark):
    png = raster.png(picture(20, 30, 4))
    rows = [("a.png", png), ("b.txt", b"text"), ("c.jpg", raster.jpeg(picture(9, 9))), ("d.png", png[:60])]
    got = converted(spark, "JPG", *rows)
    assert bytes(got["0"].content)[:2] == b"\xff\xd8" and got["0"].name == "a.jpg"
    assert [got[k].code for k in "0123"] == [None, "unsupported-target", "decode-failed", "decode-failed"]
    svg = converted(spark, "SVG", *rows)
    assert b'width="30" height="20"' in bytes(svg["0"].content) and b"image/jpeg" in bytes(svg["2"].content)
    assert converted(spark, "TXT", *rows)["0"].code == "unsupported-target"


def chunked_wav(bits: int, channels: int, frames: list[list[float]], extended: bool = False) -> bytes:
    one = {8: lambda s: bytes([int(s * 127) + 128]), 16: lambda s: struct.pack("<h", int(s * 32767)), 24: lambda s: struct.pack("<i", int(s * 8388607))[:3], 32: lambda s: struct.pack("<i", int(s * 2147483647))}[bits]
    body = b"".join(one(s) for f in frames for s in f)
    told = struct.pack("<HHIIHH", 0xFFFE if extended else 1, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
    told += struct.pack("<HHIH", 22, bits, 0, 1) + b"\0" * 14 if extended else b""
    chunks = b"LIST" + struct.pack("<I", 5) + b"INFOx\0" + b"fmt " + struct.pack("<I", len(told)) + told + b"data" + struct.pack("<I", len(body)) + body
    return b"RIFF" + struct.pack("<I", len(chunks) + 4) + b"WAVE" + chunks


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("extended", [False, True])
def test_sound_with_chunks_before_its_data(bits, extended):
    frames = [[0.0, 0.5, 0.25], [1.0, -1.0, 0.0], [-0.25, 0.75, 0.5]]
    rate, samples = sound.riff(chunked_wav(bits, 3, frames, extended))
    assert rate == 8000 and np.abs(samples - np.array(frames)).max() < 0.02
    with wave.open(io.BytesIO(sound.encoded(chunked_wav(bits, 3, frames, extended)))) as w:
        assert (w.getnchannels(), w.getframerate(), w.getsampwidth(), w.getnframes()) == (2, 8000, 2, 3)


def test_capabilities_are_what_convert_accepts(spark):
    told = {r.target: r.supported for r in capabilities(spark).collect()}
    assert {t for t, yes in told.items() if yes} == set(c.TARGETS)
    for target in told:
        codes = {r.code for r in c.convert(files(spark, ("a.txt", b"x"), ("a.png", raster.png(solid(picture(2, 2)))), ("a.wav", chunked_wav(16, 1, [[0.5]]))), target).collect()}
        assert (None in codes) == told[target], target


def test_names_as_they_are_and_no_file_lost(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("100%.txt", "a%20b.txt", "x.txt"):
        (tmp_path / "in" / n).write_bytes(n.encode())
    found = scan.scan_files(spark, str(tmp_path / "in"))
    assert {r.name for r in found.collect()} == {"100%.txt", "a%20b.txt", "x.txt"} and {len(r.hid) for r in found.collect()} == {64}
    rows = spark.createDataFrame([("1", "x.txt", bytearray(b"1")), ("2", "x.txt", bytearray(b"2")), ("3", "x (2).txt", bytearray(b"3")), ("4", "../up", bytearray(b"4")), ("5", "none", None)], "hid string, name string, content binary")
    out = tmp_path / "out"
    saved = scan.save_files(rows, str(out)).collect()
    assert len({r.path for r in saved}) == 4 and sorted(p.read_bytes() for p in out.iterdir()) == [b"1", b"2", b"3", b"4"]
    bad = rows.withColumn("content", F.when(F.col("hid") == "2", F.raise_error(F.lit("no"))).otherwise(F.col("content")))
    with pytest.raises(Exception):  # noqa: B017
        scan.save_files(bad, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists() or list((tmp_path / "other").iterdir()) == []


def scanned() -> bytes:
    image = b"6 0 obj<</Type/XObject/Subtype/Image/Width 1/Height 1/BitsPerComponent 8/ColorSpace/DeviceGray/Length 1>>stream\n\0\nendstream endobj"
    return plain_pdf(b"q 500 0 0 700 0 0 cm /I Do Q", image).replace(b"/Font<</F 4 0 R>>", b"/Font<</F 4 0 R>>/XObject<</I 6 0 R>>")


def test_scanned_files_need_an_engine(spark):
    def broken(content):
        raise OSError("no model")

    assert converted(spark, "TXT", ("a.pdf", scanned()))["0"].code == "ocr-unsupported"
    read = converted(spark, "TXT", ("a.pdf", scanned()), recognise=lambda content: ["one\nline\n\n two ", "", "three"])["0"]
    assert bytes(read.content).decode() == "one line\n\ntwo\n\nthree\n"
    assert converted(spark, "TXT", ("a.pdf", scanned()), recognise=broken)["0"].code == "ocr-failed"
    assert converted(spark, "TXT", ("a.pdf", scanned()), recognise=lambda content: [" "])["0"].code == "pdf-no-text"


def test_files_in_sql(spark):
    c.register_functions(spark)
    files(spark, ("a.docx", b"x"), ("b.rtf", b"{" + BACK + b"rtf1 hello}"), ("c.txt", b"one"), ("d", b"")).createOrReplaceTempView("some_files")
    got = spark.sql("SELECT f.name, p.kind, p.text, p.code FROM some_files f, LATERAL file_parts(f.name, f.content) p ORDER BY f.name").collect()
    assert [tuple(r) for r in got] == [("a.docx", "file", None, "zip-corrupt"), ("b.rtf", "piece", "hello", None), ("c.txt", "txt", "one", None), ("d", "file", None, "decode-failed")]


def test_video_heads(spark):
    from millrace.sources import video

    box = lambda kind, body: struct.pack(">I", len(body) + 8) + kind + body
    wide = lambda kind, body: struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    mvhd = box(b"mvhd", b"\1" + b"\0" * 19 + struct.pack(">IQ", 600, 900) + b"\0" * 80)
    track = lambda kind, w, h: box(b"trak", box(b"tkhd", b"\0" * 76 + struct.pack(">II", w << 16, h << 16)) + box(b"mdia", box(b"hdlr", b"\0" * 8 + kind + b"\0" * 12)))
    movie = wide(b"moov", mvhd + track(b"soun", 0, 0) + track(b"vide", 320, 180))
    assert video.head(box(b"ftyp", b"qt  ") + wide(b"mdat", b"x" * 50) + movie) == (320, 180, 1.5)
    assert video.head(movie + struct.pack(">I4s", 0, b"mdat") + b"x" * 9) == (320, 180, 1.5)
    for bad in (b"", movie[:40], box(b"moov", mvhd), b"\x1aE\xdf\xa3" + b"\xff" * 40, b"RIFF\0\0\0\0AVI avih", box(b"moov", b"\0\0\0\x01trak" + b"\0" * 30)):
        with pytest.raises(CodecError):
            video.head(bad)
    r = np.random.default_rng(5)
    for _ in range(300):
        cut = bytearray(movie)
        for _ in range(6):
            cut[r.integers(len(cut))] = r.integers(256)
        try:
            video.head(bytes(cut))
        except CodecError:
            pass
