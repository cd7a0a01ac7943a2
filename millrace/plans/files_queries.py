"""Queries over file rows: naming, classification, limits, targets, quality and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as fx
from ..functions import vocab as v
from ..operators import report
from ..operators.admission import admit
from ..operators.staging import load_files
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


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = i.files(spark, sf_dir)
    return f.withColumn("family", fx.family_of(F.col("name"), F.col("type")))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows that are supported and within their limit, with target and estimate."""
    f = classified(spark, sf_dir).where(fx.is_supported(F.col("name"), F.col("type")) & (F.col("size") <= fx.limit_bytes(F.col("family"))))
    f = f.withColumn("target", fx.default_target(F.col("family"), F.col("wanted")))
    return f.withColumn("est_kb", fx.estimate_kb(F.col("family"), F.col("target"), F.col("size"), F.col("quality")))


CLASSIFIED = f"{i.FILES_SQL}, classified AS (SELECT *, {i.FAMILY_SQL} AS family, {i.SUPPORTED_SQL} AS supported FROM files)"
PLANNED = f"""{CLASSIFIED}, targeted AS (SELECT *, {i.TARGET_SQL} AS target FROM classified WHERE supported AND size <= {i.LIMIT_SQL}),
planned AS (SELECT *, {i.estimate_sql("family", "target", "size", "quality")} AS est_kb FROM targeted)"""


@_query(
    "plan_batch",
    f"""WITH f AS (SELECT 'doc-' || doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS size FROM documents),
e AS (SELECT 'document' AS family, size, {i.estimate_sql("'document'", "'PDF'", "size", "82")} AS est FROM f WHERE size <= {v.MAX_BYTES})
SELECT family, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes, round(sum(est), 3) AS est_kb,
  CAST(floor((1 - sum(est) / (sum(size) / 1024.0::DOUBLE)) * 100 + 0.5) AS BIGINT) AS pct,
  CASE WHEN floor((1 - sum(est) / (sum(size) / 1024.0::DOUBLE)) * 100 + 0.5) >= 0 THEN 'smaller' ELSE 'larger' END AS trend FROM e GROUP BY family""",
)
def plan_batch(spark, sf_dir):
    docs = i.table(spark, sf_dir, "documents")
    f = docs.select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.octet_length("text").cast("long").alias("size"), F.lit(None).cast("string").alias("type"))
    f = f.withColumn("family", fx.family_of(F.col("name"), F.col("type"))).where(fx.is_supported(F.col("name"), F.col("type")) & (F.col("size") <= fx.limit_bytes(F.col("family"))))
    f = f.withColumn("target", fx.default_target(F.col("family"), F.lit("PNG")))
    f = f.withColumn("est_kb", fx.estimate_kb(F.col("family"), F.col("target"), F.col("size"), F.lit(v.DEFAULT_QUALITY)))
    return report.estimate_summary(f, ["family"]).select("family", "n_files", "bytes", F.round("est_kb", 3).alias("est_kb"), "pct", "trend")


_STEM = r"regexp_replace(name, '\.[a-zA-Z0-9]+$', '')"
_OUT = f"CASE WHEN length({_STEM}) > 0 THEN {_STEM} ELSE 'converted' END || '.' || "


def _ext_for_sql(family: str, other: str) -> str:
    return f"CASE WHEN wanted IN {i._in(v.TARGETS[family])} THEN lower(wanted) ELSE '{other}' END"


@_query(
    "names",
    f"""WITH {i.FILES_SQL} SELECT hid, name, {i.EXT_SQL} AS ext,
  CASE WHEN length({i.EXT_SQL}) > 1 THEN upper(substr({i.EXT_SQL}, 2)) ELSE 'PNG' END AS src_ext,
  {_OUT} lower(wanted) AS out_image, {_OUT} {_ext_for_sql("audio", "mp3")} AS out_audio,
  {_OUT} {_ext_for_sql("video", "mp4")} AS out_video, {_OUT} {_ext_for_sql("document", "txt")} AS out_document FROM files""",
)
def names(spark, sf_dir):
    n, t = F.col("name"), F.col("wanted")
    outs = [fx.out_name(n, F.lit(f), t).alias(f"out_{f}") for f in ("image", "audio", "video", "document")]
    return i.files(spark, sf_dir).select("hid", "name", fx.ext_of(n).alias("ext"), fx.src_ext(n).alias("src_ext"), *outs)


def _short_sql(name: str, most: int) -> str:
    ext = f"CASE WHEN contains({name}, '.') AND length({name}) - strpos(reverse({name}), '.') > 0 THEN substr({name}, length({name}) - strpos(reverse({name}), '.') + 1) ELSE '' END"
    return f"CASE WHEN length({name}) <= {most} THEN {name} ELSE substr({name}, 1, greatest(1, {most - 1} - length({ext}))) || '…' || {ext} END"


@_query("short_names", f"WITH {i.FILES_SQL} SELECT hid, {_short_sql('name', 24)} AS short24, {_short_sql('name', 12)} AS short12, {_short_sql('name', 8)} AS short8 FROM files")
def short_names(spark, sf_dir):
    return i.files(spark, sf_dir).select("hid", fx.short_name(F.col("name")).alias("short24"), fx.short_name(F.col("name"), 12).alias("short12"), fx.short_name(F.col("name"), 3).alias("short8"))


@_query("page_names", rf"""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, {i.EXT_SQL.replace("name", "regexp_extract(url, '[^/]*$')")} AS ext, {_short_sql("regexp_extract(url, '[^/]*$')", 10)} AS short FROM pages""")
def page_names(spark, sf_dir):
    name = F.regexp_extract("url", "[^/]*$", 0)
    return i.table(spark, sf_dir, "pages").select("page_id", name.alias("name"), fx.ext_of(name).alias("ext"), fx.short_name(name, 10).alias("short"))


@_query(
    "families",
    f"""WITH {CLASSIFIED} SELECT hid, family, supported, CASE WHEN {i.EXT_SQL} IN {i._in(v.STUB_EXTS)} THEN 'image' ELSE '' END AS stub, family <> '' AS known,
  family IN ('image', 'video') AS preview_home, family IN ('image', 'video', 'audio') AS preview_convert FROM classified""",
)
def families(spark, sf_dir):
    f = classified(spark, sf_dir)
    n, t, fam = F.col("name"), F.col("type"), F.col("family")
    return f.select("hid", "family", fx.is_supported(n, t).alias("supported"), fx.stub_kind(n).alias("stub"), fx.is_known(n, t).alias("known"), fx.previewable(fam).alias("preview_home"), fx.previewable(fam, audio=True).alias("preview_convert"))


@_query(
    "limits",
    f"""WITH {CLASSIFIED}, x AS (SELECT *, {i.LIMIT_SQL} AS most, CASE WHEN family = 'video' THEN {v.MAX_BYTES_VIDEO_MOBILE} ELSE {v.MAX_BYTES} END AS most_mobile,
    ' (saw ' || CASE WHEN length(type) > 0 THEN type ELSE 'unknown type' END || ')' AS seen FROM classified)
SELECT hid, CAST(most AS BIGINT) AS limit_bytes, CAST(most_mobile AS BIGINT) AS limit_mobile, {i.size_sql("most")} AS limit_label, {i.size_sql("size")} AS size_label, size <= most AS within,
  CASE WHEN size > most THEN name || ': over ' || {i.size_sql("most")} || ' — pick a smaller file.'
    WHEN NOT supported AND {i.EXT_SQL} IN {i._in(v.STUB_EXTS)} THEN name || ': that image type isn''t supported yet — PNG / JPG / SVG / WEBP / HEIC only.' || seen
    WHEN NOT supported THEN name || ': unsupported file — {fx.TAKEN}' || seen END AS rejection FROM x""",
)
def limits(spark, sf_dir):
    f = classified(spark, sf_dir)
    most = fx.limit_bytes(F.col("family"))
    return f.select("hid", most.alias("limit_bytes"), fx.limit_bytes(F.col("family"), mobile=True).alias("limit_mobile"), fx.fmt_size(most).alias("limit_label"), fx.fmt_size(F.col("size")).alias("size_label"), (F.col("size") <= most).alias("within"), fx.rejection(F.col("name"), F.col("type"), F.col("size")).alias("rejection"))


#: What this engine can write: the capability list behind the repaired targets.
ABLE = ["DOCX", "EPUB", "MD", "PDF", "PNG", "RTF", "SVG", "TXT", "WAV"]


@_query(
    "targets",
    f"""WITH {CLASSIFIED}, x AS (SELECT *, {i.TARGET_SQL} AS target FROM classified)
SELECT hid, family, wanted, target,
  CASE WHEN family = 'image' AND target = 'WEBP' THEN 'JPG' WHEN family = 'audio' AND target NOT IN {i._in(ABLE)} THEN 'WAV' ELSE target END AS repaired,
  CASE WHEN family = 'video' AND target <> 'WEBM' THEN 'WEBM' ELSE target END AS repaired_video,
  coalesce({" OR ".join(f"(family = '{f}' AND target IN {i._in(v.TARGETS[f])})" for f in v.TARGETS)}, false) AS convertible,
  family = 'document' AND target IN {i._in(v.IGNORES_QUALITY)} AS ignores_quality FROM x""",
)
def targets(spark, sf_dir):
    f = classified(spark, sf_dir).withColumn("target", fx.default_target(F.col("family"), F.col("wanted")))
    fam, t = F.col("family"), F.col("target")
    return f.select("hid", "family", "wanted", "target", fx.entry_target(fam, F.col("wanted"), ABLE).alias("repaired"), fx.entry_target(fam, F.col("wanted"), ["WEBM", *v.TARGETS["image"], *v.TARGETS["audio"], *v.TARGETS["document"]]).alias("repaired_video"), fx.convertible(fam, t).alias("convertible"), fx.ignores_quality(fam, t).alias("ignores_quality"))


@_query("formats", f"SELECT l_orderkey, l_linenumber, {i.size_sql('CAST(floor(l_extendedprice * l_extendedprice) AS BIGINT)')} AS size_label, {i.kb_sql('l_extendedprice')} AS kb_label FROM lineitem")
def formats(spark, sf_dir):
    p = F.col("l_extendedprice")
    return i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fx.fmt_size(F.floor(p * p)).alias("size_label"), fx.fmt_kb(p).alias("kb_label"))


_CLOCK = "({s} // 60) || ':' || lpad(CAST({s} % 60 AS VARCHAR), 2, '0')"
_SECONDS = "CAST(floor(l_extendedprice / 10.0::DOUBLE + 0.5) AS BIGINT)"
_WHOLE = "CAST(floor(l_extendedprice / 10.0::DOUBLE) AS BIGINT)"


@_query("durations", f"SELECT l_orderkey, l_linenumber, CASE WHEN {_SECONDS} > 0 THEN {_CLOCK.format(s=_SECONDS)} ELSE '' END AS duration, {_CLOCK.format(s=_WHOLE)} AS place FROM lineitem")
def durations(spark, sf_dir):
    s = F.col("l_extendedprice") / 10.0
    return i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fx.fmt_duration(s).alias("duration"), fx.fmt_position(s).alias("place"))


_QUALITY = "CASE WHEN l_quantity * 2 - 2 = 0 THEN 82 ELSE least(100, greatest(1, l_quantity * 2 - 2)) END"
_RAW = f"(64 + ({_QUALITY})::DOUBLE / 100 * 256)"
_RATE = f"list_sort(list_transform({v.BITRATES}, lambda b: {{'off': abs(b - {_RAW}), 'rate': b}}))[1].rate"


def _rung_sql(what: int) -> str:
    return "CASE " + " ".join(f"WHEN {_QUALITY} <= {r[0]} THEN {r[what]!r}" for r in v.RUNGS) + " END"


@_query("quality_scales", f"SELECT l_orderkey, l_linenumber, CAST({_RATE} AS INTEGER) AS mp3_rate, {_RATE} || 'kbps' AS mp3_label, 'lossless' AS wav_label, {_rung_sql(2)} AS rung, CAST({_rung_sql(1)} AS INTEGER) AS cap, CAST({_rung_sql(3)} AS INTEGER) AS bps FROM lineitem")
def quality_scales(spark, sf_dir):
    q = F.col("l_quantity") * 2 - 2
    return i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fx.bitrate(q, F.lit("MP3")).alias("mp3_rate"), fx.bitrate_label(q, F.lit("MP3")).alias("mp3_label"), fx.bitrate_label(q, F.lit("WAV")).alias("wav_label"), fx.rung(q, 2).alias("rung"), fx.rung(q, 1).alias("cap"), fx.rung(q, 3).alias("bps"))


_W, _H = "CAST(l_partkey % 5000 AS INTEGER)", "CAST(l_suppkey % 97 * 40 AS INTEGER)"
_SCALE = f"least(1.0::DOUBLE, 720 / ({_H})::DOUBLE)"
_FIT = f"least(1.0::DOUBLE, 4096.0::DOUBLE / greatest({_W}, {_H}, 1))"


@_query(
    "picture_sizes",
    f"""SELECT l_orderkey, l_linenumber,
  CASE WHEN {_W} > 0 AND {_H} > 0 THEN CAST(greatest(2, floor({_W} * {_SCALE} / 2 + 0.5) * 2) AS INTEGER) END AS rung_w,
  CASE WHEN {_W} > 0 AND {_H} > 0 THEN CAST(greatest(2, floor({_H} * {_SCALE} / 2 + 0.5) * 2) AS INTEGER) END AS rung_h,
  CAST(greatest(1, floor({_W} * {_FIT} + 0.5)) AS INTEGER) AS canvas_w, CAST(greatest(1, floor({_H} * {_FIT} + 0.5)) AS INTEGER) AS canvas_h,
  CASE WHEN {_W} = 0 OR {_H} = 0 THEN 'decode-failed' END AS code FROM lineitem""",
)
def picture_sizes(spark, sf_dir):
    x = i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 5000).cast("int").alias("w"), (F.col("l_suppkey") % 97 * 40).cast("int").alias("h"))
    w, h = F.col("w"), F.col("h")
    some = F.when(h > 0, h)  # no division by zero
    rw, rh = fx.rung_size(w, some, F.lit(720.0))
    cw, ch = fx.canvas_size(w, F.greatest(h, F.when(w == 0, 1).otherwise(0)))
    cw0, ch0 = fx.canvas_size(w, h)
    both = F.greatest(w, h) > 0
    return x.select("l_orderkey", "l_linenumber", rw.alias("rung_w"), rh.alias("rung_h"), F.when(both, cw0).otherwise(cw).alias("canvas_w"), F.when(both, ch0).otherwise(F.lit(1)).alias("canvas_h"), fx.frame_code(w, h).alias("code"))


@_query("estimate_rows", f"WITH {PLANNED} SELECT hid, family, target, CAST(floor(est_kb * 1000 + 0.5) AS BIGINT) AS est_milli, {i.kb_sql('est_kb')} AS est_label FROM planned")
def estimate_rows(spark, sf_dir):
    return planned(spark, sf_dir).select("hid", "family", "target", F.floor(F.col("est_kb") * 1000 + 0.5).cast("long").alias("est_milli"), fx.fmt_kb(F.col("est_kb")).alias("est_label"))


def summary_sql(source: str, keys: str, est: str = "sum(est_kb)", inp: str = "sum(size)") -> str:
    pct = f"floor((1 - {est} / ({inp} / 1024.0::DOUBLE)) * 100 + 0.5)"
    return f"""SELECT {keys}, count(*) AS n_files, CAST({inp} AS BIGINT) AS bytes, round({est}, 3) AS est_kb, CAST({pct} AS BIGINT) AS pct,
  CASE WHEN {pct} >= 0 THEN 'smaller' ELSE 'larger' END AS trend, round(least(100.0::DOUBLE, {est} / ({inp} / 1024.0::DOUBLE) * 100), 6) AS bar FROM {source} GROUP BY {keys}"""


@_query("estimate_summary", f"WITH {PLANNED} {summary_sql('planned', 'batch')}")
def estimate_summary(spark, sf_dir):
    out = report.estimate_summary(planned(spark, sf_dir), ["batch"])
    return out.select("batch", "n_files", "bytes", F.round("est_kb", 3).alias("est_kb"), "pct", "trend", F.round("bar", 6).alias("bar"))


@_query("family_rollup", f"WITH {PLANNED} SELECT family, target, count(*) AS n_files, CAST(sum(size) AS BIGINT) AS bytes FROM planned GROUP BY ROLLUP (family, target)")
def family_rollup(spark, sf_dir):
    """A convenience report of this library."""
    return planned(spark, sf_dir).rollup("family", "target").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("bytes"))


_DONE = "results AS (SELECT o_custkey % 50 AS batch, o_orderkey AS seq, CAST(floor(o_totalprice) AS BIGINT) AS src_size, CAST(floor(o_totalprice * 0.4) AS BIGINT) + o_custkey AS size, ['PNG','MP3','WAV','PDF','AAC'][o_orderkey % 5 + 1] AS target, o_orderstatus <> 'P' AS ok FROM orders)"


def _results(spark, sf_dir):
    o = i.table(spark, sf_dir, "orders")
    return o.select((F.col("o_custkey") % 50).alias("batch"), F.col("o_orderkey").alias("seq"), F.floor("o_totalprice").cast("long").alias("src_size"), (F.floor(F.col("o_totalprice") * 0.4).cast("long") + F.col("o_custkey")).alias("size"), i.pick(["PNG", "MP3", "WAV", "PDF", "AAC"], F.col("o_orderkey") % 5).alias("target"), (F.col("o_orderstatus") != "P").alias("ok"))


@_query(
    "measured_summary",
    f"""WITH {_DONE}, g AS (SELECT batch, count(*) AS n, CAST(sum(src_size) AS BIGINT) AS bytes_in, CAST(sum(size) AS BIGINT) AS bytes_out, CASE WHEN count(DISTINCT target) = 1 THEN min(target) ELSE 'Mixed' END AS label FROM results WHERE ok GROUP BY batch)
SELECT batch, n, bytes_in, bytes_out, label, {i.size_sql("bytes_out")} AS out_label, CAST(floor((1 - bytes_out / bytes_in::DOUBLE) * 100 + 0.5) AS BIGINT) AS pct FROM g""",
)
def measured_summary(spark, sf_dir):
    return report.measured_summary(_results(spark, sf_dir).where("ok"), ["batch"])


@_query(
    "result_header",
    f"""WITH {_DONE} SELECT batch, CAST(sum(src_size) AS BIGINT) AS bytes_in, CAST(sum(CASE WHEN ok THEN size ELSE 0 END) AS BIGINT) AS bytes_out, count(*) FILTER (WHERE ok) AS n_done,
  count(*) FILTER (WHERE NOT ok AND target <> 'PDF') AS n_failed, count(*) FILTER (WHERE NOT ok AND target = 'PDF') AS n_unsupported,
  CASE WHEN count(*) FILTER (WHERE ok AND target IN ('MP3', 'AAC')) > 0 THEN '256kbps' ELSE '' END AS rates FROM results GROUP BY batch""",
)
def result_header(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("state", F.when(F.col("ok"), "done").when(F.col("target") == "PDF", "unsupported").otherwise("failed"))
    return report.result_header(r, ["batch"], quality=82)


@_query(
    "admit_queue",
    f"""WITH {CLASSIFIED}, x AS (SELECT *, supported AND size <= {i.LIMIT_SQL} AS ok FROM classified), y AS (SELECT *, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY batch ORDER BY seq) AS rank FROM x),
z AS (SELECT *, coalesce(max(rank) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM y)
SELECT hid, batch, CASE WHEN before >= 20 THEN 'full' WHEN ok THEN 'accepted' ELSE 'rejected' END AS state, CASE WHEN before < 20 AND ok THEN CAST(rank AS BIGINT) END AS place FROM z""",
)
def admit_queue(spark, sf_dir):
    f = classified(spark, sf_dir)
    ok = fx.is_supported(F.col("name"), F.col("type")) & (F.col("size") <= fx.limit_bytes(F.col("family")))
    return admit(f, ok, ["batch"], "seq").select("hid", "batch", "state", "place")


@_query(
    "queue_family",
    f"""WITH {CLASSIFIED}, g AS (SELECT batch * 7 + seq % 7 AS queue, CASE WHEN min(family) = max(family) THEN CASE WHEN min(family) = '' THEN 'image' ELSE min(family) END ELSE 'mixed' END AS family, count(DISTINCT family) = 1 AND min(family) <> '' AS bulk, min(wanted) AS wanted FROM classified GROUP BY 1)
SELECT queue, family, bulk, CASE WHEN bulk THEN 'bulk' ELSE 'manual' END AS mode,
 CASE family {" ".join(f"WHEN '{f}' THEN CASE WHEN lower(wanted) IN {i._in(v.PICKER[f])} THEN lower(wanted) ELSE '{d}' END" for f, d in (("image", "png"), ("audio", "mp3"), ("document", "pdf"), ("video", "mp4")))} ELSE lower(wanted) END AS repaired FROM g""",
)
def queue_family(spark, sf_dir):
    f = classified(spark, sf_dir).withColumn("queue", F.col("batch") * 7 + F.col("seq") % 7)
    return report.queue_state(f, ["queue"])


@_query("bulk_update", f"WITH {CLASSIFIED}, x AS (SELECT *, {i.TARGET_SQL} AS target FROM classified) SELECT hid, CASE WHEN family = 'audio' THEN 'OGG' ELSE target END AS bulk_target, CASE WHEN seq % 10 = 3 THEN wanted ELSE target END AS manual_target FROM x")
def bulk_update(spark, sf_dir):
    """A click on a tile sets the target of all files of the tiles' family; a row's own choice sets one."""
    f = classified(spark, sf_dir).withColumn("target", fx.default_target(F.col("family"), F.col("wanted")))
    return f.select("hid", F.when(F.col("family") == "audio", "OGG").otherwise(F.col("target")).alias("bulk_target"), F.when(F.col("seq") % 10 == 3, F.col("wanted")).otherwise(F.col("target")).alias("manual_target"))


@_query(
    "staged_files",
    f"""WITH {CLASSIFIED}, u AS (SELECT *, supported AND size <= {i.LIMIT_SQL} AS ok, row_number() OVER (PARTITION BY supported AND size <= {i.LIMIT_SQL} ORDER BY seq) AS place FROM classified), x AS (SELECT *, (SELECT count(*) FROM u) - least((SELECT count(*) FROM u WHERE ok), 20) AS extra FROM u WHERE ok AND place <= 20)
SELECT hid, name, {i.TARGET_SQL} AS target, CAST(extra AS BIGINT) AS extra FROM x""",
)
def staged_files(spark, sf_dir):
    """What the queue takes of files that were staged: the first twenty usable ones, and how many stay out."""
    staged = i.files(spark, sf_dir).withColumn("target", F.col("wanted")).withColumn("ts", F.lit(None).cast("long"))
    return load_files(staged).select("hid", "name", "target", "extra")


_ABLE_SQL = "coalesce(" + " OR ".join(f"(family = '{f}' AND target IN {i._in(ts)})" for f, ts in v.TARGETS.items()) + ", false)"


@_query(
    "batch_counts",
    f"""WITH {CLASSIFIED}, x AS (SELECT *, {i.TARGET_SQL} AS target FROM classified), y AS (SELECT *, {_ABLE_SQL} AS able FROM x)
SELECT batch, count(*) AS n_files, count(*) FILTER (able) AS n_convertible, count(*) FILTER (NOT able) AS n_skipped, {", ".join(f"count(*) FILTER (family = '{f}') AS n_{f}" for f in v.TARGETS)},
  coalesce(bool_and(family = 'document' AND target IN {i._in(v.IGNORES_QUALITY)}) FILTER (able), false) AS quality_idle FROM y GROUP BY batch""",
)
def batch_counts(spark, sf_dir):
    f = classified(spark, sf_dir).withColumn("target", fx.default_target(F.col("family"), F.col("wanted")))
    return report.batch_counts(f, ["batch"])


_STEPS_SQL = "(VALUES " + ", ".join(f"('{s}', {p}::DOUBLE)" for s, p in report.STEPS.items()) + ") AS t(step, part)"


@_query(
    "progress_steps",
    f"WITH {i.FILES_SQL}, p AS (SELECT hid, batch, row_number() OVER (PARTITION BY batch ORDER BY seq) AS nth, count(*) OVER (PARTITION BY batch) AS n FROM files) SELECT hid, batch, step, (nth - 1 + part) * 100 / n AS percent, CASE WHEN n > 1 THEN ' (' || nth || ' of ' || n || ')' ELSE '' END AS label FROM p, {_STEPS_SQL}",
)
def progress_steps(spark, sf_dir):
    """What the progress line of each queue shows at every step of every file."""
    return report.progress(i.files(spark, sf_dir).select("hid", "batch", "seq"), ["batch"], "seq").select("hid", "batch", "step", "percent", "label")


_TYPES_SQL = "CASE wanted " + " ".join(f"WHEN '{t}' THEN {i._list(kinds)}" for t, kinds in v.RECORDER_TYPES.items()) + " END"
_SETS = [["audio/webm;codecs=opus", "video/webm"], ["audio/mp4", "video/mp4"], ["audio/mpeg", "audio/wav", "video/webm;codecs=vp8,opus"], []]
_SETS_SQL = "CASE seq % 4 " + " ".join(f"WHEN {k} THEN {i._list(s) if s else '[]'}" for k, s in enumerate(_SETS)) + " END"


@_query("recorder_types", f"WITH {i.FILES_SQL} SELECT hid, wanted, list_filter({_TYPES_SQL}, lambda t: list_contains({_SETS_SQL}, t))[1] AS kind FROM files")
def recorder_types(spark, sf_dir):
    """The container type that a recorder would be given for each file's target, of four sets that it may offer."""
    offered = F.element_at(F.array(*(F.array(*map(F.lit, s)).cast("array<string>") for s in _SETS)), (F.col("seq") % 4 + 1).cast("int"))
    return i.files(spark, sf_dir).select("hid", "wanted", fx.recorder_for(F.col("wanted"), offered).alias("kind"))


_OFFERS = "o AS (SELECT * FROM (VALUES " + ", ".join([f"('{f}', {k}, '{t}', true, NULL)" for f, ts in v.TARGETS.items() for k, t in enumerate(ts)] + ["('image', 4, 'HEIC', false, 'input only')"]) + ") AS t(family, position, target, available, label))"


@_query("target_vocabulary", f"WITH {i.FILES_SQL}, f AS (SELECT hid, {i.FAMILY_SQL} AS family FROM files), {_OFFERS} SELECT f.hid, o.* FROM f JOIN o ON f.family = o.family")
def target_vocabulary(spark, sf_dir):
    """What the picker of each file offers. The vocabulary has some twenty rows."""
    files = i.files(spark, sf_dir).select("hid", fx.family_of(F.col("name"), F.col("type")).alias("family"))
    return files.join(F.broadcast(v.targets_table(spark)), "family").select("hid", "family", "position", "target", "available", "label")
