"""Queries over lists and lookups: history, staging, search, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vocab as v
from ..operators import lists, relate, search
from . import inputs as i
from ..functions.files import family_of
from .files_queries import ABLE

Q: dict = {}
O: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def take(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return take


_HISTORY = "h AS (SELECT user_id AS owner, 'h' || event_id AS id, event_type AS name, CAST(floor(value) % 5 AS BIGINT) AS size, event_type AS format, 'queued' AS state, epoch_us(ts) // 1000 AS ts, event_id AS n FROM events)"


def _history(spark, sf_dir):
    e = i.table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("owner"), F.concat(F.lit("h"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), (F.floor("value") % 5).cast("long").alias("size"), F.col("event_type").alias("format"), F.lit("queued").alias("state"), ms.alias("ts"))


@_query("history_dedup", f"WITH {_HISTORY}, k AS (SELECT *, row_number() OVER (PARTITION BY owner, name, size ORDER BY ts DESC, id DESC) AS place FROM h) SELECT owner, name, size, id, format, state, ts FROM k WHERE place = 1")
def history_dedup(spark, sf_dir):
    return lists.dedup_history(_history(spark, sf_dir), ["name", "size"], ["owner"])


@_query("history_top10", f"WITH {_HISTORY}, k AS (SELECT *, row_number() OVER (PARTITION BY owner, name, size ORDER BY ts DESC, id DESC) AS d FROM h), t AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY ts DESC, id DESC) AS place FROM k WHERE d = 1) SELECT owner, id, name, size, ts, CAST(place AS INTEGER) AS place FROM t WHERE place <= 10")
def history_top10(spark, sf_dir):
    return lists.top_history(lists.dedup_history(_history(spark, sf_dir), ["name", "size"], ["owner"]), ["owner"]).select("owner", "id", "name", "size", "ts", "place")


@_query("history_latest", f"WITH {_HISTORY}, k AS (SELECT *, row_number() OVER (PARTITION BY name, size ORDER BY ts DESC, id DESC) AS d FROM h) SELECT id, name, size, ts FROM k WHERE d = 1 ORDER BY ts DESC, id DESC LIMIT 10")
def history_latest(spark, sf_dir):
    """The stored history of one owner: a top-k, in order."""
    h = lists.dedup_history(_history(spark, sf_dir).drop("owner"), ["name", "size"])
    return h.orderBy(F.desc("ts"), F.desc("id")).limit(lists.HISTORY_ROWS).select("id", "name", "size", "ts")


@_query("history_json", "SELECT event_id, 'n' || user_id AS name, CAST(event_id % 7 AS BIGINT) AS size FROM events WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'second', CAST(1 AS BIGINT) FROM events WHERE event_id % 3 = 0")
def history_json(spark, sf_dir):
    """Lists out of JSON; every third is broken, and every third no list: a number, an object, or a list with a size of a wrong type."""
    e = F.col("event_id")
    good = F.concat(F.lit('[{"name": "n'), F.col("user_id").cast("string"), F.lit('", "size": '), (e % 7).cast("string"), F.lit('}, {"name": "second", "size": 1}]'))
    raw = i.table(spark, sf_dir, "events").select("event_id", F.when(e % 3 == 0, good).when(e % 3 == 1, '[{"name": "x", ').when(e % 9 == 2, "7").when(e % 9 == 5, '{"name": "y", "size": 1}').otherwise('[{"name": "ok", "size": "bad"}]').alias("value"))
    return lists.read_history(raw).select("event_id", "name", "size")


_STAGED = "s AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN NULL ELSE epoch_us(ts) // 60000000 END AS ts, user_id, event_type, value FROM events)"


def _staged(spark, sf_dir):
    e = i.table(spark, sf_dir, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 != 0, ((ms - F.pmod(ms, F.lit(60000))) / 60000).cast("long")).alias("ts"), "user_id", "event_type", "value")


@_query("stage_order", f"WITH {_STAGED} SELECT user_id, seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(ts, 0), seq) AS INTEGER) AS place FROM s")
def stage_order(spark, sf_dir):
    """Each user's staging table in order."""
    return lists.stage_places(_staged(spark, sf_dir), ["user_id"]).select("user_id", "seq", "place")


@_query("staged_load", f"WITH {_STAGED}, u AS (SELECT *, value > 20 AS ok FROM s) SELECT seq, event_type, (SELECT CAST(count(*) - least(count(*) FILTER (WHERE ok), 20) AS BIGINT) FROM u) AS extra FROM u WHERE ok ORDER BY coalesce(ts, 0), seq LIMIT 20")
def staged_load(spark, sf_dir):
    return lists.load_staged(_staged(spark, sf_dir), F.col("value") > 20, v.MAX_FILES).select("seq", "event_type", "extra")


@_query("faq_search", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND contains(lower(text), 'th')")
def faq_search(spark, sf_dir):
    return search.search(i.table(spark, sf_dir, "conversations"), "user", "  TH ", category="role").select("conv_id", "turn", "role")


@_query("faq_groups", "SELECT role, count(*) FILTER (WHERE contains(lower(text), 'tion')) AS shown, bool_or(contains(lower(text), 'tion')) AS visible FROM conversations GROUP BY role")
def faq_groups(spark, sf_dir):
    return search.groups(i.table(spark, sf_dir, "conversations"), "all", "tion", category="role")


@_query(
    "spine_join",
    """WITH r AS (SELECT o_custkey AS file_id, o_orderkey AS seq, 'i' || (o_orderkey % 4) AS idref FROM orders),
m AS (SELECT c_custkey AS file_id, 'i' || x AS id, 'OEBPS/c' || x || '.xhtml' AS href, CASE WHEN x = 3 THEN 'image/png' WHEN x = 2 THEN 'text/html' ELSE 'application/xhtml+xml' END AS mime FROM customer, (VALUES (0), (1), (2), (3)) AS t(x))
SELECT r.file_id, r.seq, m.href FROM r JOIN m ON r.file_id = m.file_id AND r.idref = m.id WHERE regexp_matches(m.mime, 'x?html')""",
)
def spine_join(spark, sf_dir):
    refs = i.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("i"), (F.col("o_orderkey") % 4).cast("string")).alias("idref"))
    x = F.explode(F.array(*(F.lit(k) for k in range(4)))).alias("x")
    m = i.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"), x)
    mime = F.when(F.col("x") == 3, "image/png").when(F.col("x") == 2, "text/html").otherwise("application/xhtml+xml")
    manifest = m.select("file_id", F.concat(F.lit("i"), F.col("x").cast("string")).alias("id"), F.concat(F.lit("OEBPS/c"), F.col("x").cast("string"), F.lit(".xhtml")).alias("href"), mime.alias("mime"))
    return relate.spine(refs, manifest)


_PACK = "refs AS (SELECT o_orderkey AS file_id, 'r' || (o_custkey % 5) AS rid, 'p' || (o_custkey % 5) AS path, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS alt FROM orders), media AS (SELECT o_orderkey AS file_id, 'p' || (o_orderkey % 5) AS path, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders)"


def _pack(spark, sf_dir):
    o = i.table(spark, sf_dir, "orders")
    k = lambda c, p: F.concat(F.lit(p), (F.col(c) % 5).cast("string"))
    refs = o.select(F.col("o_orderkey").alias("file_id"), k("o_custkey", "r").alias("rid"), k("o_custkey", "p").alias("path"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("alt"))
    media = o.select(F.col("o_orderkey").alias("file_id"), k("o_orderkey", "p").alias("path"), F.floor("o_totalprice").cast("long").alias("bytes"))
    return refs, media


@_query("embedded_pictures", f"WITH {_PACK}, rels AS (SELECT file_id, rid, path FROM refs) SELECT r.file_id, r.rid, l.path, m.bytes FROM refs r JOIN rels l ON r.file_id = l.file_id AND r.rid = l.rid JOIN media m ON m.file_id = l.file_id AND m.path = l.path")
def embedded_pictures(spark, sf_dir):
    refs, media = _pack(spark, sf_dir)
    return relate.embedded(refs.select("file_id", "rid"), refs.select("file_id", "rid", "path"), media).select("file_id", "rid", "path", "bytes")


@_query("pictures_or_text", f"WITH {_PACK} SELECT r.file_id, r.path, m.bytes, CASE WHEN m.bytes IS NULL THEN '[image: ' || coalesce(r.alt, r.path) || ']' END AS stand_in FROM refs r LEFT JOIN media m ON r.file_id = m.file_id AND r.path = m.path")
def pictures_or_text(spark, sf_dir):
    refs, media = _pack(spark, sf_dir)
    return relate.pictures_or_text(refs, media).select("file_id", "path", "bytes", "stand_in")


_VOCAB = "t AS (SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{x}')" for f, xs in v.TARGETS.items() for x in xs) + ") AS t(family, target))"


def _capabilities(spark):
    from .capabilities import capabilities

    return capabilities(spark)


#: What the conversion makes, stated once more for the other engine.
_MADE = ["DOCX", "EPUB", "JPG", "MD", "PDF", "PNG", "RTF", "SVG", "TXT", "WAV"]
_OFFERED = f"{i.FILES_SQL}, {_VOCAB}, f AS (SELECT hid, {i.FAMILY_SQL} AS family FROM files)"


def _offered(spark, sf_dir):
    """Each file with the targets of its family."""
    files = i.files(spark, sf_dir)
    return files.select("hid", family_of(F.col("name"), F.col("type")).alias("family")).join(F.broadcast(v.targets_table(spark).where("available").select("family", "target")), "family")


@_query("capable_targets", f"WITH {_OFFERED} SELECT f.hid, t.family, t.target FROM f JOIN t ON f.family = t.family WHERE t.target IN {i._in(_MADE)}")
def capable_targets(spark, sf_dir):
    return relate.able(_offered(spark, sf_dir), _capabilities(spark)).select("hid", "family", "target")


@_query("missing_targets", f"WITH {_OFFERED} SELECT f.hid, t.family, t.target FROM f JOIN t ON f.family = t.family WHERE t.target NOT IN {i._in(_MADE)}")
def missing_targets(spark, sf_dir):
    return relate.able(_offered(spark, sf_dir), _capabilities(spark), yes=False).select("hid", "family", "target")


_CODES = [*v.REASONS, "no-such-code"]
_FAMILIES = ["image", "audio", "document", "video"]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


@_query(
    "reasons",
    f"""WITH f AS (SELECT p_partkey, {i._list(_CODES)}[p_partkey % {len(_CODES)} + 1] AS code, {i._list(_FAMILIES)}[p_partkey % 4 + 1] AS family, {i._list(ABLE)}[p_partkey % {len(ABLE)} + 1] AS target FROM part)
SELECT p_partkey, code, replace(CASE {" ".join(f"WHEN family = 'video' AND code = '{c}' THEN {_quoted(r)}" for c, r in v.VIDEO_REASONS.items())} {" ".join(f"WHEN code = '{c}' THEN {_quoted(r)}" for c, r in v.REASONS.items())} ELSE {_quoted(v.DEFAULT_REASON)} END, '{{target}}', target) AS reason FROM f""",
)
def reasons(spark, sf_dir):
    k = F.col("p_partkey")
    f = i.table(spark, sf_dir, "part").select("p_partkey", i.pick(_CODES, k % len(_CODES)).alias("code"), i.pick(_FAMILIES, k % 4).alias("family"), i.pick(ABLE, k % len(ABLE)).alias("target"))
    return relate.with_reason(spark, f).select("p_partkey", "code", "reason")


@_query("rung_range_join", "WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(100, greatest(1, CASE WHEN l_partkey % 130 = 0 THEN 82 ELSE l_partkey % 130 END)) AS INTEGER) AS q FROM lineitem), r AS (SELECT * FROM (VALUES (0, 20, '480p', 1000000), (20, 40, '720p', 2500000), (40, 60, '1080p', 5000000), (60, 80, '2K', 10000000), (80, 100, '4K', 16000000)) AS r(low, high, label, bps)) SELECT l_orderkey, l_linenumber, l_partkey, label, bps FROM q JOIN r ON q.q > r.low AND q.q <= r.high")
def rung_range_join(spark, sf_dir):
    rows = i.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_partkey") % 130).alias("q"))
    return relate.with_rung(spark, rows, "q").select("l_orderkey", "l_linenumber", "l_partkey", "label", "bps")


@_query("style_at_place", "SELECT p_partkey, CASE WHEN p_partkey % 40 < 5 THEN 'F1' WHEN p_partkey % 40 < p_size THEN 'F2' WHEN p_partkey % 40 < p_size + 9 THEN 'F3' ELSE 'F3' END AS style FROM part")
def style_at_place(spark, sf_dir):
    bound = lambda end, s: F.struct(end.cast("int").alias("end"), F.lit(s).alias("style"))
    bounds = F.array(bound(F.lit(5), "F1"), bound(F.col("p_size"), "F2"), bound(F.col("p_size") + 9, "F3"))
    return i.table(spark, sf_dir, "part").select("p_partkey", relate.style_at(bounds, F.col("p_partkey") % 40).alias("style"))


@_query("metadata_join", "SELECT o_orderkey, c_custkey IS NOT NULL AS probed, c_acctbal AS seconds FROM orders LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING') ON o_custkey = c_custkey")
def metadata_join(spark, sf_dir):
    probes = i.table(spark, sf_dir, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("hid"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("seconds"))
    rows = i.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("hid"))
    return relate.with_metadata(rows, probes).select("o_orderkey", "probed", "seconds")


@_query("set_union", "SELECT c_nationkey AS key FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    c, s = (i.table(spark, sf_dir, t).select(F.col(k).alias("key")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey")))
    return c.unionByName(s).distinct()


@_query("set_except", "SELECT p_partkey AS key FROM part EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_except(spark, sf_dir):
    used = i.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("key"))
    return i.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).exceptAll(used)


@_query("remove_rows", "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def remove_rows(spark, sf_dir):
    gone = i.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return lists.remove(i.table(spark, sf_dir, "part").select("p_partkey", "p_name"), gone, "p_partkey")


@_query("nearest_zone", "WITH d AS (SELECT p_brand, p_partkey, abs(CAST(floor(p_retailprice) AS BIGINT) % 900 - 450) AS d FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY d, p_partkey) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY d DESC, p_partkey DESC) AS m FROM d) SELECT p_brand, max(p_partkey) FILTER (WHERE n = 1) AS nearest, max(p_partkey) FILTER (WHERE m = 1) AS farthest FROM k GROUP BY p_brand")
def nearest_zone(spark, sf_dir):
    """The row nearest to a centre (the first of equals) and the farthest (the last)."""
    d = F.abs(F.floor("p_retailprice").cast("long") % 900 - 450)
    place = F.struct(d.alias("d"), F.col("p_partkey").alias("k"))
    return i.table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", place).alias("nearest"), F.max_by("p_partkey", place).alias("farthest"))


@_query("sizes_by_language", "SELECT d.lang, l.quality, count(*) AS n, CAST(sum(d.n_chars) AS BIGINT) AS chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang, l.quality")
def sizes_by_language(spark, sf_dir):
    d, l = i.table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), i.table(spark, sf_dir, "labels").select("doc_id", "quality")  # noqa: E741
    return d.join(l, "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").cast("long").alias("chars"))
