"""Queries over texts, lines, glyphs and samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import audio, glyphs, markdown
from ..functions.text import WS, xml_escape
from ..operators import layout
from . import inputs as i

Q: dict = {}
O: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def take(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return take


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_PAR = f"""lines AS (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS line, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS n FROM texts),
tidy AS (SELECT doc_id, n, {_trim("line")} AS t FROM lines),
numbered AS (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS island FROM tidy),
found AS (SELECT doc_id, island, string_agg(t, ' ' ORDER BY n) AS text FROM numbered WHERE t <> '' GROUP BY doc_id, island),
paragraphs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) AS place, text FROM found
  UNION ALL SELECT doc_id, 1, '' FROM texts WHERE doc_id NOT IN (SELECT doc_id FROM found))"""
_TEXTS = "texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - conv_id, CASE WHEN conv_id % 2 = 0 THEN string_agg('  ' || text, chr(10) || ' ' || chr(10) ORDER BY turn) ELSE string_agg('  ' || text, chr(13) || chr(10) ORDER BY turn) END FROM conversations GROUP BY conv_id)"


def texts(spark, sf_dir):
    """Documents, and conversations as documents with blank lines or CRLF between their turns."""
    docs = i.table(spark, sf_dir, "documents").select("doc_id", "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("  "), F.col("text")).alias("text"))))
    talks = i.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: t["text"]).alias("t"))
    joined = F.when(F.col("conv_id") % 2 == 0, F.array_join("t", "\n \n")).otherwise(F.array_join("t", "\r\n"))
    return docs.unionByName(talks.select((-1 - F.col("conv_id")).alias("doc_id"), joined.alias("text")))


@_query("txt_paragraphs", f"WITH {_TEXTS}, {_PAR} SELECT doc_id, CAST(place AS INTEGER) AS place, text FROM paragraphs")
def txt_paragraphs(spark, sf_dir):
    rows = texts(spark, sf_dir).select("doc_id", F.posexplode(layout.paragraphs(F.col("text"))).alias("place", "text"))
    return rows.withColumn("place", F.col("place") + 1)


@_query("txt_reencode", f"WITH {_TEXTS}, {_PAR} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY place) || chr(10) AS txt FROM paragraphs GROUP BY doc_id")
def txt_reencode(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", F.concat(F.array_join(layout.paragraphs(F.col("text")), "\n\n"), F.lit("\n")).alias("txt"))


_WHOLE = f"WITH {_TEXTS}, {_PAR}, whole AS (SELECT doc_id, {_trim(f'''regexp_replace(string_agg(text, ' ' ORDER BY place), '{WS}+', ' ', 'g')''')} AS t FROM paragraphs GROUP BY doc_id)"


@_query("txt_excerpt", f"{_WHOLE} SELECT doc_id, CASE WHEN length(t) > 240 THEN regexp_replace(substr(t, 1, 239), '{WS}+$', '') || '…' ELSE t END AS excerpt FROM whole")
def txt_excerpt(spark, sf_dir):
    return texts(spark, sf_dir).select("doc_id", layout.excerpt(layout.paragraphs(F.col("text"))).alias("excerpt"))


_ESC = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '\"', '&quot;')"
_RTF = r"""array_to_string(list_transform(string_split(replace(replace(replace(replace(text, '\', '\\'), '{', '\{'), '}', '\}'), chr(10), '\line '), ''),
  lambda c: CASE WHEN unicode(c) < 128 THEN c WHEN unicode(c) <= 255 THEN '\''' || lower(printf('%02x', unicode(c))) WHEN unicode(c) <= 32767 THEN '\u' || unicode(c) || '?' WHEN unicode(c) <= 65535 THEN '\u' || (unicode(c) - 65536) || '?' ELSE '?' END), '')"""


@_query("escapes", f"SELECT doc_id, {_ESC} AS xml, {_RTF} AS rtf, replace(text, '|', '\\|') AS md FROM documents")
def escapes(spark, sf_dir):
    t = F.col("text")
    return i.table(spark, sf_dir, "documents").select("doc_id", xml_escape(t).alias("xml"), glyphs.rtf_escape(t).alias("rtf"), glyphs.md_escape(t).alias("md"))


_PAGED = "regexp_replace(translate(text, '{}', {}), '[^\\x{{00}}-\\x{{FF}}]', '?', 'g')".format("".join(glyphs.HIGH.values()), " || ".join(f"chr({b})" for b in glyphs.HIGH))
_WIDTH = f"CAST(list_sum(list_transform(string_split(t, ''), lambda c: {glyphs.WIDTHS}[unicode(c) + 1])) AS INTEGER)"


@_query(
    "pdf_text",
    rf"""WITH x AS (SELECT doc_id, {_PAGED} AS t FROM documents) SELECT doc_id, {_WIDTH} AS width, round({_WIDTH} * 11 / 1000.0::DOUBLE, 6) AS points,
  regexp_replace(t, '([()\\])', '\\\1', 'g') AS escaped, array_to_string(list_transform(string_split(t, ''), lambda c: printf('%02X', unicode(c))), '') AS bytes FROM x""",
)
def pdf_text(spark, sf_dir):
    t, w = F.col("text"), F.col("width")
    measured = i.table(spark, sf_dir, "documents").select("doc_id", "text", glyphs.width(F.col("text")).alias("width"))
    return measured.select("doc_id", "width", F.round(w * 11 / 1000.0, 6).alias("points"), glyphs.pdf_escape(t).alias("escaped"), F.hex(glyphs.code_bytes(t)).alias("bytes"))


@_query("pdf_wrap")
def pdf_wrap(spark, sf_dir):
    """Greedy lines of the benchmark's texts at 11 points in 200 points; a fold, so no SQL: a test folds in plain Python."""
    words = F.filter(F.split("text", f"{WS}+"), lambda w: F.length(w) > 0)
    return i.table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(layout.wrap(words, 200.0, lambda x: glyphs.width(x) * 11 / 1000.0)).alias("place", "line"))


_MD = """CASE turn % 8 WHEN 0 THEN repeat('#', CAST(conv_id % 7 + 1 AS INTEGER)) || ' ' || text WHEN 1 THEN '- ' || text WHEN 2 THEN '2) ' || text
 WHEN 3 THEN '| ' || text || ' | b |' WHEN 4 THEN ' | --- |:-:| ' WHEN 5 THEN '![a](data:,b)' WHEN 6 THEN '  ' ELSE text END"""


def md_lines(spark, sf_dir):
    t = F.col("text")
    k = F.col("turn") % 8
    line = (
        F.when(k == 0, F.concat(F.expr("repeat('#', cast(conv_id % 7 + 1 as int))"), F.lit(" "), t)).when(k == 1, F.concat(F.lit("- "), t)).when(k == 2, F.concat(F.lit("2) "), t))
        .when(k == 3, F.concat(F.lit("| "), t, F.lit(" | b |"))).when(k == 4, " | --- |:-:| ").when(k == 5, "![a](data:,b)").when(k == 6, "  ").otherwise(t)
    )
    return i.table(spark, sf_dir, "conversations").select("conv_id", "turn", line.alias("line"))


_KIND = rf"""CASE WHEN x = '' THEN 'blank' WHEN regexp_matches(x, '^#{{1,6}}\s+') THEN 'h' || length(regexp_extract(x, '^(#+)', 1))
  WHEN starts_with(x, '|') AND len(string_split(x, '|')) > 2 AND len(list_filter(list_slice(string_split(x, '|'), 2, len(string_split(x, '|')) - 1), lambda c: NOT regexp_matches({_trim("c")}, '^:?-+:?$'))) = 0 THEN 'separator'
  WHEN starts_with(x, '|') THEN 'row' WHEN regexp_matches(x, '^[-*+]\s+') THEN 'ul' WHEN regexp_matches(x, '^\d+[.)]\s+') THEN 'ol' WHEN regexp_full_match(x, '!\[([^\]]*)\]\(([^)]+)\)') THEN 'image' ELSE 'text' END"""
_MDK = f"m AS (SELECT conv_id, turn, {_MD} AS line FROM conversations), t AS (SELECT *, {_trim('line')} AS x FROM m), k AS (SELECT *, {_KIND} AS kind FROM t)"


@_query("md_line_kinds", f"WITH {_MDK} SELECT conv_id, turn, kind FROM k")
def md_line_kinds(spark, sf_dir):
    return md_lines(spark, sf_dir).select("conv_id", "turn", markdown.line_kind(F.col("line")).alias("kind"))


@_query("md_islands", f"WITH {_MDK}, n AS (SELECT *, CASE WHEN kind IS NOT DISTINCT FROM lag(kind) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM n) SELECT conv_id, CAST(island AS BIGINT) AS island, min(kind) AS kind, count(*) AS n_lines FROM s GROUP BY conv_id, island")
def md_islands(spark, sf_dir):
    """Neighbouring lines of one kind: what makes lists, tables and paragraphs."""
    k = md_lines(spark, sf_dir).withColumn("kind", markdown.line_kind(F.col("line")))
    return layout.runs_by_change(k, ["conv_id"], "turn", F.col("kind")).groupBy("conv_id", "island").agg(F.min("kind").alias("kind"), F.count(F.lit(1)).alias("n_lines"))


_GLYPHS = "g AS (SELECT l_orderkey AS file_id, l_linenumber % 2 AS page, l_linenumber AS seq, l_extendedprice AS x, l_quantity * 3 AS y, CASE WHEN l_linenumber = 5 THEN ' ' ELSE l_returnflag || l_linenumber END AS str FROM lineitem)"
_LINES = f"shown AS (SELECT *, CAST(floor(y / 4 + 0.5) * 4 AS BIGINT) AS yy FROM g WHERE {_trim('str')} <> ''), ls AS (SELECT file_id, page, yy, string_agg(str, '' ORDER BY x, seq) AS line FROM shown GROUP BY file_id, page, yy)"


def _glyphs(spark, sf_dir):
    l = i.table(spark, sf_dir, "lineitem")  # noqa: E741
    n = F.col("l_linenumber")
    return l.select(F.col("l_orderkey").alias("file_id"), (n % 2).alias("page"), n.alias("seq"), F.col("l_extendedprice").alias("x"), (F.col("l_quantity") * 3).alias("y"), F.when(n == 5, " ").otherwise(F.concat("l_returnflag", n.cast("string"))).alias("str"))


@_query("pdf_lines", f"WITH {_GLYPHS}, {_LINES} SELECT file_id, page, yy AS y, line FROM ls")
def pdf_lines(spark, sf_dir):
    return layout.page_lines(_glyphs(spark, sf_dir))


@_query(
    "pdf_paragraphs",
    f"""WITH {_GLYPHS}, {_LINES}, p AS (SELECT *, CASE WHEN lag(yy) OVER (PARTITION BY file_id, page ORDER BY yy DESC) - yy > 22 THEN 1 ELSE 0 END AS gap FROM ls),
n AS (SELECT *, sum(gap) OVER (PARTITION BY file_id, page ORDER BY yy DESC) AS place FROM p) SELECT file_id, page, CAST(place AS BIGINT) AS place, count(*) AS n_lines, string_agg(line, ' ' ORDER BY yy DESC) AS text FROM n GROUP BY file_id, page, place""",
)
def pdf_paragraphs(spark, sf_dir):
    return layout.page_paragraphs(_glyphs(spark, sf_dir))


_PCM = "list_transform(embedding, lambda x: CAST(trunc(CASE WHEN x < 0 THEN greatest(-1.0::DOUBLE, x::DOUBLE) * 32768 ELSE least(1.0::DOUBLE, x::DOUBLE) * 32767 END) AS SMALLINT))"


@_query("pcm16", f"SELECT vec_id, array_to_string({_PCM}, ',') AS samples FROM embeddings")
def pcm16(spark, sf_dir):
    return i.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(audio.pcm16(F.col("embedding")).cast("array<string>"), ",").alias("samples"))


@_query("pcm_blocks", f"WITH s AS (SELECT vec_id, unnest({_PCM}) AS s, generate_subscripts(embedding, 1) - 1 AS pos, len(embedding) AS n FROM embeddings) SELECT CAST((vec_id * n + pos) // 1152 AS BIGINT) AS block, count(*) AS n, CAST(sum(s) AS BIGINT) AS total, CAST(max(s) AS SMALLINT) AS peak FROM s GROUP BY 1")
def pcm_blocks(spark, sf_dir):
    """Blocks of 1152 samples of the sound that the rows make end to end."""
    e = i.table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("n"), F.posexplode(audio.pcm16(F.col("embedding"))).alias("pos", "s"))
    place = F.col("vec_id") * F.col("n") + F.col("pos")
    return e.groupBy(((place - F.pmod(place, F.lit(1152))) / 1152).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.sum("s").cast("long").alias("total"), F.max("s").alias("peak"))


@_query("interleave", f"WITH p AS (SELECT vec_id, {_PCM} AS s FROM embeddings) SELECT vec_id, array_to_string(flatten(list_transform(list_zip(list_slice(s, 1, len(s) // 2), list_slice(s, len(s) // 2 + 1, len(s) // 2 * 2)), lambda z: [z[1], z[2]])), ',') AS frames FROM p")
def interleave(spark, sf_dir):
    half = F.expr("cast(size(embedding) div 2 as int)")
    p = audio.pcm16(F.col("embedding"))
    frames = audio.interleave(F.slice(p, F.lit(1), half), F.slice(p, half + 1, half))
    return i.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(frames.cast("array<string>"), ",").alias("frames"))


_COLS = "greatest(1, l_linenumber * 3)"


@_query(
    "geometry",
    f"""SELECT l_orderkey, l_linenumber, CAST(greatest(600, floor(9000 / {_COLS})) AS BIGINT) AS rtf_step, CAST(greatest(800, floor(9000 / {_COLS})) AS BIGINT) AS docx_cell,
  CAST(least(8000, floor(l_quantity / greatest(1, l_linenumber * 7) * 3000 + 0.5)) AS BIGINT) AS rtf_goal, 400 + 12 * l_quantity AS pdf_width, round(0.4::DOUBLE + 0.6::DOUBLE * l_quantity / 100, 6) AS jpeg_quality,
  CAST(ceil(l_orderkey * 44100 / 48000::DOUBLE) AS BIGINT) AS resampled, l_orderkey * least(l_linenumber, 2) * 2 AS wav_data, l_orderkey * least(l_linenumber, 2) * 2 + 44 AS wav_file FROM lineitem""",
)
def geometry(spark, sf_dir):
    n, q, k = F.col("l_linenumber"), F.col("l_quantity"), F.col("l_orderkey")
    step = F.floor(F.lit(9000) / F.greatest(F.lit(1), n * 3))
    data, whole = audio.wav_sizes(k, n)
    return i.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.greatest(F.lit(600), step).cast("long").alias("rtf_step"), F.greatest(F.lit(800), step).cast("long").alias("docx_cell"),
        F.least(F.lit(8000), F.floor(q / F.greatest(F.lit(1), n * 7) * 3000 + 0.5)).cast("long").alias("rtf_goal"), (F.lit(400) + F.lit(12) * q).alias("pdf_width"), F.round(F.lit(0.4) + F.lit(0.6) * q / 100, 6).alias("jpeg_quality"),
        audio.resampled_length(k, F.lit(48000.0), F.lit(44100)).alias("resampled"), data.alias("wav_data"), whole.alias("wav_file"),
    )


@_query("encodings", "SELECT doc_id, to_base64(encode(text)) AS b64, hex(encode(text)) AS hexed, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_points FROM documents")
def encodings(spark, sf_dir):
    b = F.col("text").cast("binary")
    return i.table(spark, sf_dir, "documents").select("doc_id", glyphs.base64_line(b).alias("b64"), F.hex(b).alias("hexed"), F.octet_length("text").cast("long").alias("n_bytes"), F.length("text").cast("long").alias("n_points"))


@_query("crc32_text")
def crc32_text(spark, sf_dir):
    return i.table(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@_query("longest_hex", "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9a-fA-F]+')) AS run, generate_subscripts(regexp_extract_all(text, '[0-9a-fA-F]+'), 1) AS n FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(run) DESC, n) AS place FROM r) SELECT doc_id, run AS longest FROM k WHERE place = 1")
def longest_hex(spark, sf_dir):
    """The longest run of hex digits, the first of equally long ones."""
    runs = F.regexp_extract_all("text", F.lit("([0-9a-fA-F]+)"), 1)
    best = F.array_max(F.transform(runs, lambda r, n: F.struct(F.length(r).alias("size"), (-n).alias("back"), r.alias("run"))))
    return i.table(spark, sf_dir, "documents").select("doc_id", best["run"].alias("longest")).where("longest IS NOT NULL")


@_query("table_width", "SELECT doc_id, CAST(greatest(1, list_max(list_transform(string_split(text, chr(10)), lambda x: len(string_split(x, '|'))))) AS INTEGER) AS columns FROM documents")
def table_width(spark, sf_dir):
    rows = F.transform(F.split("text", "\n"), lambda x: F.size(F.split(x, r"\|")))
    return i.table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.array_max(rows)).alias("columns"))


@_query("merged_runs", "WITH r AS (SELECT user_id AS doc, event_id AS n, event_type AS style, substr(event_type, 1, 2) || event_id AS text FROM events), m AS (SELECT *, CASE WHEN lag(style) OVER w = style THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc ORDER BY n)), s AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY n) AS island FROM m) SELECT doc, CAST(island AS BIGINT) AS island, min(style) AS style, string_agg(text, '' ORDER BY n) AS text FROM s GROUP BY doc, island")
def merged_runs(spark, sf_dir):
    """Neighbouring runs of one style become one."""
    r = i.table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("n"), F.col("event_type").alias("style"), F.concat(F.substring("event_type", 1, 2), F.col("event_id").cast("string")).alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "")
    return layout.runs_by_change(r, ["doc"], "n", F.col("style")).groupBy("doc", "island").agg(F.min("style").alias("style"), text.alias("text"))


@_query("ordinals", "SELECT conv_id, turn, CAST(row_number() OVER w AS INTEGER) AS item, CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, CAST(floor(row_number() OVER w * 100 / count(*) OVER (PARTITION BY conv_id)) AS BIGINT) AS percent FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def ordinals(spark, sf_dir):
    """Numbers of list items, offsets of archive entries, and progress through a batch."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id"))
    return i.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("item"), F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).cast("long").alias("at"), F.floor(F.row_number().over(w) * 100 / n).cast("long").alias("percent"))
