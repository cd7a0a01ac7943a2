"""Queries that convert: whole documents there and back, heads of files, and what becomes of a mixed batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import audio
from ..functions import files as fx
from ..functions import vocab as v
from ..functions.text import WS, trim
from ..operators import convert as c
from ..sources import archive, media, packages, readers
from ..sources.pieces import as_pieces, plain_run, text_of
from . import inputs as i
from .text_queries import _PAR, _PCM, _trim

Q: dict = {}
O: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def take(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return take


def _documents(spark, sf_dir, end=".txt"):
    """Documents as text files."""
    d = i.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return d.select(F.col("doc_id").cast("string").alias("hid"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(end)).alias("name"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))


def _there_and_back(spark, sf_dir, target, end):
    """Text files to a format and back to text."""
    made = c.convert(_documents(spark, sf_dir), target).select("hid", "name", "size", "content")
    back = c.convert(made, "TXT")
    return back.where("code IS NULL").select(F.col("hid").cast("long").alias("doc_id"), F.col("content").cast("string").alias("txt"))


_TEXTS = "texts AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _back_sql(text: str, having: str = "") -> str:
    """What a text file is after it was read into paragraphs, ``text`` happened to these, and it was written again."""
    return f"WITH {_TEXTS}, {_PAR} SELECT doc_id, string_agg({text}, chr(10) || chr(10) ORDER BY place) || chr(10) AS txt FROM paragraphs GROUP BY doc_id {having}"


@_query("txt_roundtrip", _back_sql("text"))
def txt_roundtrip(spark, sf_dir):
    return _there_and_back(spark, sf_dir, "TXT", ".txt")


@_query("docx_roundtrip", _back_sql("text", "HAVING max(length(text)) > 0"))
def docx_roundtrip(spark, sf_dir):
    """A package without any text is reported as such, and gives no row."""
    return _there_and_back(spark, sf_dir, "DOCX", ".docx")


@_query("epub_roundtrip", _back_sql(r"regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')", "HAVING max(length(text)) > 0"))
def epub_roundtrip(spark, sf_dir):
    """Chapters collapse white space."""
    return _there_and_back(spark, sf_dir, "EPUB", ".epub")


@_query("rtf_roundtrip", _back_sql(r"regexp_replace(text, '[\x{10000}-\x{10FFFF}]', '?', 'g')"))
def rtf_roundtrip(spark, sf_dir):
    """Signs beyond the basic plane become question marks."""
    return _there_and_back(spark, sf_dir, "RTF", ".rtf")


@_query("zip_roundtrip", "SELECT conv_id, 'turn' || turn || '.txt' AS name, text FROM conversations WHERE text IS NOT NULL")
def zip_roundtrip(spark, sf_dir):
    """Conversations as archives, every other turn packed, opened again."""
    talks = i.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    parts = talks.select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").alias("seq"), F.concat(F.lit("turn"), F.col("turn").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("data"), (F.col("turn") % 2 == 0).alias("packed"))
    return packages.members(packages.archives(parts)).where("code IS NULL").select(F.col("file_id").cast("long").alias("conv_id"), "name", F.col("data").cast("string").alias("text"))


_XYZ = "CASE doc_id % 6 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.docx' WHEN 3 THEN '.rtf' WHEN 4 THEN '.pdf' ELSE '.xyz' END"
_BATCH_CODE = "CASE doc_id % 6 WHEN 2 THEN 'zip-corrupt' WHEN 3 THEN CASE WHEN starts_with(text, '{\\rtf') THEN NULL ELSE 'rtf-corrupt' END WHEN 4 THEN 'pdf-unsupported' WHEN 5 THEN 'decode-failed' END"


@_query("convert_batch", f"SELECT doc_id, 'd' || doc_id || '.txt' AS name, {_BATCH_CODE} AS code, {_BATCH_CODE} IS NULL AS done FROM documents WHERE text IS NOT NULL")
def convert_batch(spark, sf_dir):
    """Documents under names of all kinds: what cannot be read as what its name says gives a code, and no other row fails."""
    d = i.table(spark, sf_dir, "documents").where("text IS NOT NULL")
    files = d.select(F.col("doc_id").cast("string").alias("hid"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.expr(_XYZ)).alias("name"), F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("content"))
    return c.convert(files, "TXT").select(F.col("hid").cast("long").alias("doc_id"), "name", "code", F.col("content").isNotNull().alias("done"))


@_query("pdf_files")
def pdf_files(spark, sf_dir):
    """Documents as PDF: size and whether the last lines point to the table of objects; a test reads the objects."""
    made = c.convert(_documents(spark, sf_dir), "PDF")
    tail = F.regexp_extract(F.decode(F.col("content").substr(F.octet_length("content") - 40, F.lit(41)), "ISO-8859-1"), r"startxref\n(\d+)\n%%EOF", 1).cast("int")
    return made.select(F.col("hid").cast("long").alias("doc_id"), "size", (F.decode(F.substring("content", tail + 1, 4), "ISO-8859-1") == "xref").alias("sound"), "code")


@_query(
    "video_probe",
    "SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN CAST(16 + p_partkey % 4000 AS BIGINT) END AS width, CASE WHEN p_partkey % 5 < 4 THEN CAST(9 + p_size AS BIGINT) END AS height, CASE WHEN p_partkey % 5 < 4 THEN p_partkey / 1000.0::DOUBLE END AS seconds, CASE WHEN p_partkey % 5 = 4 THEN 'video-unsupported' END AS code FROM part",
)
def video_probe(spark, sf_dir):
    """Parts as heads of videos: MP4 with the index first or last, WEBM, AVI, and some cut off."""
    k, w, h = F.col("p_partkey").cast("long"), 16 + F.col("p_partkey") % 4000, 9 + F.col("p_size")
    big = lambda x, n: F.lpad(F.hex(x.cast("long")), 2 * n, "0")
    text = lambda s: F.lit(s.encode().hex())

    def box(kind, *parts):
        body = F.concat(*parts)
        return F.concat(big(F.length(body) / 2 + 8, 4), text(kind), body)

    zeros = lambda n: F.lit("00" * n)
    mvhd = box("mvhd", zeros(12), big(F.lit(1000), 4), big(k, 4), zeros(80))
    tkhd = box("tkhd", zeros(76), big(w * 65536, 4), big(h * 65536, 4))
    moov = box("moov", mvhd, box("trak", tkhd, box("mdia", box("hdlr", zeros(8), text("vide"), zeros(12)))))
    start, media_data = box("ftyp", text("isom"), zeros(4)), box("mdat", F.repeat(F.lit("ab"), 300))
    # a length of eight bytes begins with 01
    element = lambda name, *parts: F.concat(F.lit(name), F.lit("01"), big(F.length(F.concat(*parts)) / 2, 7), *parts)
    info = element("1549a966", element("2ad7b1", F.lit("0f4240")), element("4489", _double_hex(k)))
    tracks = element("1654ae6b", element("ae", element("e0", element("b0", big(w, 2)), element("ba", big(h, 2)))))
    webm = F.concat(element("1a45dfa3", F.lit("4282847765626d")), element("18538067", info, tracks))
    little = lambda x: F.concat(*(F.substring(big(x, 4), 7 - 2 * j, 2) for j in range(4)))
    avi = F.concat(text("RIFF"), zeros(4), text("AVI LIST"), zeros(4), text("hdrlavih"), little(F.lit(56)), little(F.lit(1000)), zeros(12), little(k), zeros(12), little(w), little(h), zeros(16))
    n = k % 5
    digits = F.when(n == 0, F.concat(start, moov, media_data)).when(n == 1, F.concat(start, media_data, moov)).when(n == 2, webm).when(n == 3, avi).otherwise(F.substring(moov, 1, 60))
    end = F.when(n == 2, ".webm").when(n == 3, ".avi").otherwise(".mp4")
    # a table of few bytes is read by few tasks, and its rows are dealt out before they become files
    parts = i.table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition("p_partkey")
    files = parts.select(k.cast("string").alias("hid"), F.concat(k.cast("string"), end).alias("name"), F.lit(0).cast("long").alias("size"), F.unhex(digits).alias("content"))
    found = c.probe_videos(files)
    return found.select(F.col("hid").cast("long").alias("p_partkey"), "width", "height", "seconds", "code")


def _double_hex(x):
    """Hex digits of a whole number below 2^53 as a double, the great end first."""
    bits = F.length(F.conv(x.cast("string"), 10, 2)) - 1  # place of the highest bit
    exponent = F.when(x == 0, 0).otherwise(bits + 1023)
    fraction = F.when(x == 0, 0).otherwise((x - F.pow(F.lit(2), bits).cast("long")) * F.pow(F.lit(2), 52 - bits).cast("long"))
    return F.lpad(F.hex(exponent.cast("long") * F.lit(1 << 52) + fraction.cast("long")), 16, "0")


_PAGE = bytes(range(128, 160)).decode("cp1252", "replace")
_HIGH = "".join(c for c in _PAGE if c != "\ufffd")


@_query(
    "pdf_roundtrip",
    f"WITH t AS (SELECT doc_id, {_trim(f"regexp_replace(text, '{WS}+', ' ', 'g')")} AS text FROM documents WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN text = '' THEN 'pdf-no-text' END AS code, CASE WHEN text <> '' THEN regexp_replace(text, '[^\\x{{20}}-\\x{{7E}}\\x{{A0}}-\\x{{FF}}{_HIGH}]', '?', 'g') END AS words FROM t",
)
def pdf_roundtrip(spark, sf_dir):
    """Text files as PDF, read again: every word in order, with question marks for signs that the faces lack."""
    made = c.convert(_documents(spark, sf_dir), "PDF").select("hid", "name", "size", "content")
    words = F.regexp_replace(F.col("content").cast("string"), f"{WS}+", " ")
    return c.convert(made, "TXT").select(F.col("hid").cast("long").alias("doc_id"), "code", trim(words).alias("words"))


_BROKEN = [".txt", ".txt", ".rtf", ".docx", ".pdf", ".md", ".epub", ".docx", ".xyz", ".wav", ".png", ".epub"]


@_query(
    "convert_broken",
    """SELECT doc_id, CASE doc_id % 12 WHEN 3 THEN 'zip-corrupt' WHEN 4 THEN 'pdf-unsupported' WHEN 6 THEN 'zip-corrupt' WHEN 7 THEN 'docx-corrupt' WHEN 8 THEN 'decode-failed' WHEN 9 THEN 'decode-failed' WHEN 10 THEN 'decode-failed' WHEN 11 THEN 'epub-corrupt' END AS code,
CASE doc_id % 12 WHEN 0 THEN 'good ' || doc_id || chr(10) WHEN 1 THEN 'caf' || chr(65533) || ' ' || doc_id || chr(10) WHEN 2 THEN chr(65533) || ' ' || doc_id || chr(10) WHEN 5 THEN 'h ' || doc_id || chr(10) END AS txt FROM documents""",
)
def convert_broken(spark, sf_dir):
    """For each document a file: sound ones, and one of every kind that is broken beside them, in one batch."""
    k, word = F.col("doc_id") % 12, F.col("doc_id").cast("string")
    empty = archive.write([("other.txt", b"nothing", True)])
    bodies = [
        F.concat(F.lit("good "), word).cast("binary"),
        F.concat(F.lit(b"caf\xe9 "), word.cast("binary")),
        F.concat(F.lit("{\\rtf1 \\u99999999 x "), word, F.lit("}")).cast("binary"),
        F.concat(F.lit("PK no archive "), word).cast("binary"),
        F.concat(F.lit("%PDF-1.4 "), word).cast("binary"),
        F.concat(F.lit("# h "), word).cast("binary"),
        F.concat(F.lit(empty[:40]), word.cast("binary")),
        F.lit(empty),
        F.coalesce("text", F.lit("")).cast("binary"),
        F.concat(F.lit(b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\1\0\0\0\0\0\0\0"), word.cast("binary")),
        F.concat(F.lit(b"\x89PNG\r\n\x1a\n"), word.cast("binary")),
        F.lit(empty),
    ]
    content = F.coalesce(*(F.when(k == n, body) for n, body in enumerate(bodies)))
    files = i.table(spark, sf_dir, "documents").select(word.alias("hid"), F.concat(word, i.pick(_BROKEN, k)).alias("name"), F.lit(0).cast("long").alias("size"), content.alias("content"))
    return c.convert(files, "TXT").select(F.col("hid").cast("long").alias("doc_id"), "code", F.col("content").cast("string").alias("txt"))


_CELLS = "cells AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS INTEGER) AS row, unnest([0, 1, 2]) AS col, unnest([CAST(l_suppkey AS VARCHAR), CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE l_returnflag || ' & <' || l_linestatus || '>' END, CASE WHEN l_quantity > 25 THEN CAST(l_partkey AS VARCHAR) END]) AS text FROM lineitem), wide AS (SELECT *, max(CASE WHEN text IS NOT NULL THEN col END) OVER (PARTITION BY l_orderkey) AS last FROM cells)"


def _tables(spark, sf_dir, target, end):
    """Orders as tables with empty cells and short rows, written in a format and read again."""
    # dealt by what tells the files apart, so that they are put together where their lines lie
    lines = i.table(spark, sf_dir, "lineitem").withColumn("file_id", F.col("l_orderkey").cast("string"))
    middle = F.when(F.col("l_linenumber") % 2 == 0, "").otherwise(F.concat("l_returnflag", F.lit(" & <"), "l_linestatus", F.lit(">")))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")) - 1
    placed = lines.withColumn("row", place)
    cells = placed.select("file_id", "row", F.posexplode(F.array(F.col("l_suppkey").cast("string"), middle, F.when(F.col("l_quantity") > 25, F.col("l_partkey").cast("string")))).alias("col", "text")).where("text IS NOT NULL")
    pieces = as_pieces(cells, file_id=F.col("file_id"), seq=F.lit(0), t=F.lit("table"), row=F.col("row"), col=F.col("col"), runs=F.array(plain_run(F.col("text"))))
    made = c.encode(pieces, target).select(F.col("file_id").alias("hid"), F.lit(f"t{end}").alias("name"), F.octet_length("content").alias("size"), "content")
    back = c.read_pieces(made).where("t = 'table'")
    return back.select(F.col("file_id").cast("long").alias("l_orderkey"), "row", "col", text_of(F.col("runs")).alias("text"))


@_query("docx_tables", f"WITH {_CELLS} SELECT l_orderkey, row, col, coalesce(text, '') AS text FROM wide WHERE col <= last")
def docx_tables(spark, sf_dir):
    return _tables(spark, sf_dir, "DOCX", ".docx")


@_query("epub_tables", f"WITH {_CELLS} SELECT l_orderkey, row, col, text FROM wide WHERE text IS NOT NULL")
def epub_tables(spark, sf_dir):
    return _tables(spark, sf_dir, "EPUB", ".epub")


@_query("image_convert", "SELECT vec_id, CASE WHEN vec_id % 5 = 4 THEN 'decode-failed' END AS code, CASE WHEN vec_id % 5 < 4 THEN CASE WHEN vec_id % 2 = 0 THEN CAST(len(embedding) AS BIGINT) ELSE 4096::BIGINT END END AS width, CASE WHEN vec_id % 5 < 4 THEN CASE WHEN vec_id % 2 = 0 THEN CAST(1 + vec_id % 7 AS BIGINT) ELSE 1::BIGINT END END AS height FROM embeddings")
def image_convert(spark, sf_dir):
    """Vectors as PNG pictures (every other one wider than the longest edge, some cut off in the head), converted to JPEG; sizes are probed from the bytes."""
    e = i.table(spark, sf_dir, "embeddings")
    grey = F.transform(audio.pcm16(F.col("embedding")), lambda s: F.lpad(F.hex(F.shiftright(s.cast("long") + 32768, 8)), 2, "0"))
    wide, k = F.col("vec_id") % 2 == 1, F.col("vec_id") % 7
    line = F.array_join(grey, "")
    images = e.select(
        F.col("vec_id").cast("string").alias("file_id"), F.when(wide, F.size("embedding") * 80).otherwise(F.size("embedding")).cast("int").alias("width"), F.when(wide, 1).otherwise(1 + k).cast("int").alias("height"), F.lit(1).alias("channels"),
        F.unhex(F.when(wide, F.repeat(line, F.lit(80))).otherwise(F.repeat(line, (1 + k).cast("int")))).alias("data"),
    )
    cut = F.when(F.col("file_id").cast("long") % 5 == 4, F.substring("content", 1, 20)).otherwise(F.col("content"))
    files = media.write_png(images).select(F.col("file_id").alias("hid"), F.concat("file_id", F.lit(".png")).alias("name"), F.octet_length("content").alias("size"), cut.alias("content"))
    size = media.jpeg_size(F.col("content"))
    return c.convert(files, "JPG").select(F.col("hid").cast("long").alias("vec_id"), "code", size["width"].alias("width"), size["height"].alias("height"))


@_query("html_blocks")
def html_blocks(spark, sf_dir):
    """Blocks of web pages; a test compares them with the standard parser's."""
    pages = i.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("file_id"), F.col("html").alias("text"))
    return readers.read_html(pages).select(F.col("file_id").cast("long").alias("page_id"), "seq", "t", "level", "row", "col", text_of(F.col("runs")).alias("text"), "alt")


_MD_TEXT = "repeat('#', CAST(conv_id % 6 + 1 AS INTEGER)) || ' Talk ' || conv_id || chr(10) || chr(10) || string_agg('- ' || word, chr(10) ORDER BY turn) || chr(10) || chr(10) || '| role | words |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| **' || role || '** | ' || word || ' |', chr(10) ORDER BY turn) || chr(10)"


@_query("md_roundtrip", f"WITH w AS (SELECT conv_id, turn, role, regexp_replace(text, '[^A-Za-z ]', '', 'g') || 'x' AS word FROM conversations WHERE text IS NOT NULL), k AS (SELECT conv_id, turn, role, {_trim('word')} AS word FROM w) SELECT conv_id, {_MD_TEXT} AS md FROM k GROUP BY conv_id")
def md_roundtrip(spark, sf_dir):
    """A heading, a list and a table of every conversation, read and written again."""
    k = i.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", F.trim(F.concat(F.regexp_replace("text", "[^A-Za-z ]", ""), F.lit("x"))).alias("word"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "word")))
    g = k.groupBy("conv_id").agg(rows.alias("rows"))
    items = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("- "), r["word"])), "\n")
    table = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| **"), r["role"], F.lit("** | "), r["word"], F.lit(" |"))), "\n")
    text = F.concat(F.expr("repeat('#', cast(conv_id % 6 + 1 as int))"), F.lit(" Talk "), F.col("conv_id").cast("string"), F.lit("\n\n"), items, F.lit("\n\n| role | words |\n| --- | --- |\n"), table, F.lit("\n"))
    files = g.select(F.col("conv_id").cast("string").alias("hid"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit(".md")).alias("name"), F.lit(0).cast("long").alias("size"), text.cast("binary").alias("content"))
    return c.convert(files, "MD").select(F.col("hid").cast("long").alias("conv_id"), F.col("content").cast("string").alias("md"))


def _le_sql(x: str, n: int) -> str:
    return " || ".join(f"printf('%02X', CAST((CAST({x} AS BIGINT) >> {8 * k}) & 255 AS INTEGER))" for k in range(n))


_CH = "least(l_linenumber, 2)"


@_query("wav_header", f"SELECT l_orderkey, l_linenumber, '52494646' || {_le_sql(f'l_orderkey * {_CH} * 2 + 36', 4)} || '57415645666D7420' || '10000000' || '0100' || {_le_sql(_CH, 2)} || {_le_sql('44100', 4)} || {_le_sql(f'44100 * {_CH} * 2', 4)} || {_le_sql(f'{_CH} * 2', 2)} || '1000' || '64617461' || {_le_sql(f'l_orderkey * {_CH} * 2', 4)} AS head FROM lineitem")
def wav_header(spark, sf_dir):
    return i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.hex(media.wav_head(F.col("l_orderkey"), F.lit(44100), F.col("l_linenumber"))).alias("head"))


@_query("wav_roundtrip", f"SELECT vec_id, CAST(8000 AS BIGINT) AS rate, CAST(1 AS BIGINT) AS channels, array_to_string({_PCM}, ',') AS samples, len(embedding) / 8000.0::DOUBLE AS seconds FROM embeddings")
def wav_roundtrip(spark, sf_dir):
    """Vectors as sound, written, probed and read again."""
    e = i.table(spark, sf_dir, "embeddings")
    sounds = e.select(F.col("vec_id").cast("string").alias("file_id"), F.lit(8000).alias("rate"), F.col("embedding").alias("left"), F.lit(None).cast("array<float>").alias("right"))
    files = media.write_wav(sounds)
    whole = F.transform("samples", lambda x: F.round(x * 32768).cast("long").cast("string"))
    probed = files.select("file_id", media.wav_info(F.col("content"))["seconds"].alias("seconds"))
    return media.read_wav(files).join(probed, "file_id").select(F.col("file_id").cast("long").alias("vec_id"), "rate", "channels", F.array_join(whole, ",").alias("samples"), "seconds")


@_query("png_sizes", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS width, CAST(1 AS BIGINT) AS height FROM embeddings")
def png_sizes(spark, sf_dir):
    """Vectors as pictures of one row, written and probed."""
    grey = F.transform(audio.pcm16(F.col("embedding")), lambda s: F.lpad(F.hex(F.shiftright(s.cast("long") + 32768, 8)), 2, "0"))
    images = i.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("file_id"), F.size("embedding").alias("width"), F.lit(1).alias("height"), F.lit(1).alias("channels"), F.unhex(F.array_join(grey, "")).alias("data"))
    size = media.png_size(F.col("content"))
    return media.write_png(images).select(F.col("file_id").cast("long").alias("vec_id"), size["width"].alias("width"), size["height"].alias("height"))


@_query("event_times", "SELECT event_id, strftime(ts, '%b %-d, %H:%M') AS shown FROM events")
def event_times(spark, sf_dir):
    return i.table(spark, sf_dir, "events").select("event_id", fx.format_time(F.col("ts")).alias("shown"))


_STATUS = " UNION ALL ".join(f"SELECT '{f}' AS family, '{t}' AS target" for f, ts in v.TARGETS.items() for t in [*ts, *(["HEIC"] if f == "image" else [])])


@_query(
    "tile_status",
    f"""WITH {i.FILES_SQL}, f AS (SELECT hid, {i.FAMILY_SQL} AS family FROM files), t AS ({_STATUS}), s AS (SELECT hid, t.*, target IN ('DOCX', 'EPUB', 'JPG', 'MD', 'PDF', 'PNG', 'RTF', 'SVG', 'TXT', 'WAV') AS able FROM f JOIN t ON f.family = t.family)
SELECT hid, family, target, CASE WHEN target IN ('HEIC', 'MOV', 'MKV', 'AVI') THEN 'INPUT ONLY' WHEN NOT able THEN 'NO SUPPORT' ELSE '' END AS status FROM s""",
)
def tile_status(spark, sf_dir):
    """What the tiles of each file's family say. There are some twenty targets."""
    from .capabilities import capabilities

    files = i.files(spark, sf_dir).select("hid", fx.family_of(F.col("name"), F.col("type")).alias("family"))
    return files.join(F.broadcast(capabilities(spark)), "family").select("hid", "family", "target", fx.tile_status(F.col("family"), F.col("target"), F.col("supported")).alias("status"))


@_query("active_targets", f"WITH {i.FILES_SQL} SELECT hid, CASE WHEN batch % 3 = 0 THEN 'TXT' ELSE wanted END AS target, CASE WHEN batch % 2 = 0 THEN 'mixed' WHEN batch % 5 = 0 THEN 'mixed' ELSE 'video' END AS tiles FROM files")
def active_targets(spark, sf_dir):
    """A file's own target or the queue's, and whose targets the tiles offer."""
    b = F.col("batch")
    own = F.when(b % 3 == 0, "TXT")
    return i.files(spark, sf_dir).select("hid", fx.active_target(own, F.col("wanted")).alias("target"), fx.tiles_family(F.when(b % 2 == 0, "bulk").otherwise("manual"), F.lit("mixed"), F.when(b % 5 != 0, "video")).alias("tiles"))
