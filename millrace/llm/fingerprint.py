"""Document fingerprints: threshold-scaled sketches (native).

A text's shingles are its distinct runs of ``SHINGLE`` words (with fewer words, the whole sequence). A shingle's hash is the first 64 bits of
its MD5, as 16 hexadecimal digits. The sketch keeps, in order, every hash below the fixed fraction 1 / ``SHARE``: whatever the size of a text, two
sketches have drawn alike from what both texts hold, so that overlaps can be counted even between very unequal texts. As a short
text may have no hash that low, a sketch also keeps its ``LEAST`` smallest hashes; texts of as few shingles are kept whole.

A sketch is complete up to ``limit``: all hashes if it holds all shingles, else the larger of the threshold and its last hash. Estimates count the
hashes up to the lower limit of the two sketches. ``merge`` is the sketch of the union of both texts' shingles, from the sketches alone.

Next documents: rows are placed in the order of their ids (rows that repeat an id, and those of a null id, which come last, by a hash of
their texts and then by these). Ids and hashes alone are range-partitioned first; the smallest of each range are splitters, of
bounded number. Each row finds its range by binary search; the first of a range goes to the range before as well (of the first range to the
last), so that a window within ranges finds each row's successor, and texts are shuffled once.

Defined cases: a null text counts as empty; texts without a word have no shingles, and are like each other (1) and like no other text (0); equal
texts tie and have equal sketches, so do rows repeated in full, of which one is next to the other; a single row is next to itself; very
long texts are sketched whole; an empty table gives an empty result; further columns are ignored by the query, and ``sketch`` takes
any column. Rows that agree in id and text are in one range, however many they are.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SHINGLE, SHARE, LEAST = 5, 8, 16
#: Rows of a range, and most ranges (their splitters come to the driver).
RANGE_ROWS, MOST_RANGES = 256, 20_000
_SPACE = r"[\x20\x09-\x0D]+"


def _last_below(share: int) -> str:
    """The largest hash below the fraction."""
    return f"{(1 << 64) // share - 1:016x}"


def sketch(text: Column, shingle: int = SHINGLE, share: int = SHARE, least: int = LEAST) -> Column:
    """Struct of ``whole`` (all shingles are kept) and ``hashes`` (ascending)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")

    def hashes(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
        each = F.transform(starts, lambda i: F.substring(F.md5(F.array_join(F.slice(w, i, shingle), " ")), 1, 16))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).otherwise(each)

    def kept(h: Column) -> Column:
        n = F.greatest(F.lit(least), F.size(F.filter(h, lambda x: x <= _last_below(share))))
        return F.struct((F.size(h) <= n).alias("whole"), F.slice(h, F.lit(1), n).alias("hashes"))

    # arrays are bound to lambda variables, so that each is made once a row
    return F.transform(F.transform(F.transform(F.array(words), hashes), lambda h: F.array_sort(F.array_distinct(h))), kept)[0]


def limit(s: Column, share: int = SHARE) -> Column:
    """Up to which hash a sketch is complete."""
    last = F.coalesce(F.get(s["hashes"], F.size(s["hashes"]) - 1), F.lit(""))
    return F.when(s["whole"], F.lit("g")).otherwise(F.greatest(F.lit(_last_below(share)), last))


def merge(a: Column, b: Column, share: int = SHARE, least: int = LEAST) -> Column:
    """The sketch of what both sketched texts hold together."""
    both, whole = F.array_sort(F.array_union(a["hashes"], b["hashes"])), a["whole"] & b["whole"]

    def kept(h: Column) -> Column:
        n = F.greatest(F.lit(least), F.size(F.filter(h, lambda x: x <= _last_below(share))))
        return F.struct((whole & (F.size(h) <= n)).alias("whole"), F.slice(h, F.lit(1), n).alias("hashes"))

    return F.transform(F.array(both), kept)[0]


def overlap(a: Column, b: Column, share: int = SHARE) -> Column:
    """Struct of how many hashes up to both limits the sketches have (n_a, n_b) and share (n_both)."""

    def counted(top: Column) -> Column:
        x, y = F.filter(a["hashes"], lambda h: h <= top), F.filter(b["hashes"], lambda h: h <= top)
        return F.struct(F.size(x).alias("n_a"), F.size(y).alias("n_b"), F.size(F.array_intersect(x, y)).alias("n_both"))

    return F.transform(F.array(F.least(limit(a, share), limit(b, share))), counted)[0]


def likeness(o: Column) -> Column:
    """Estimated Jaccard similarity, from an overlap."""
    union = o["n_a"] + o["n_b"] - o["n_both"]
    return F.when(union == 0, F.lit(1.0)).otherwise(o["n_both"] / F.greatest(union, F.lit(1)))


def containment(o: Column) -> Column:
    """Estimated share of the first text's shingles that the second has, from an overlap; 1 if the first has none."""
    return F.when(o["n_a"] == 0, F.lit(1.0)).otherwise(o["n_both"] / F.greatest(o["n_a"], F.lit(1)))


def fingerprint(s: Column) -> Column:
    """A sketch as text: ``w`` (whole) or ``p`` (part), and the hashes."""
    return F.concat(F.when(s["whole"], F.lit("w")).otherwise(F.lit("p")), F.array_join(s["hashes"], ""))


def parsed(text: Column) -> Column:
    """The sketch of a fingerprint."""
    return F.struct((F.substring(text, 1, 1) == "w").alias("whole"), _sixteens(F.substring(text, 2, 1 << 30)).alias("hashes"))


def _sixteens(digits: Column) -> Column:
    return F.regexp_extract_all(digits, F.lit("[0-9a-f]{16}"), F.lit(0))


def _unpacked(whole: Column, bits: Column) -> Column:
    return F.struct(whole.alias("whole"), _sixteens(F.lower(F.hex(bits))).alias("hashes"))


def low_hashes(df: DataFrame, by: list[str], sketch_col: str = "sketch", share: int = SHARE) -> DataFrame:
    """The merged sketches of groups of any size, a row a hash below the fraction: ``by`` and hash."""
    each = df.select(*by, F.explode(F.filter(F.col(sketch_col)["hashes"], lambda h: h <= _last_below(share))).alias("hash"))
    return each.distinct()


def with_next(df: DataFrame, id_col: str, text_col: str, carried: list[str], out: str = "next") -> DataFrame:
    """df and a struct ``out`` of the ``carried`` columns of the next row. Reads ids and texts twice."""
    z, i = F.col(id_col).isNull().cast("int"), F.coalesce(F.col(id_col).cast("long"), F.lit(0))
    key = F.struct(z.alias("z"), i.alias("i"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"))
    keys = df.select(key.alias("key")).select("key.*")
    n = max(1, min(MOST_RANGES, -(-keys.count() // RANGE_ROWS)))
    firsts = keys.repartitionByRange(n, "z", "i", "h").groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct("z", "i", "h")).alias("key"))
    splits = sorted((r["key"]["z"], r["key"]["i"], r["key"]["h"]) for r in firsts.collect()) or [(0, 0, 0)]  # a row a range
    n = len(splits)
    table = F.from_json(F.lit(json.dumps([{"z": a, "i": b, "h": c} for a, b, c in splits])), "array<struct<z:int,i:long,h:long>>")

    def halved(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        found = F.get(table, mid) <= F.col("__key")
        return F.struct(F.when(found, mid).otherwise(s["lo"]).alias("lo"), F.when(found, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))
    steps = F.array(*[F.lit(k) for k in range(n.bit_length())])
    placed = df.withColumn("__key", key).withColumn("__range", F.aggregate(steps, start, halved)["lo"])
    before = F.when(F.get(table, F.col("__range")) == F.col("__key"), F.pmod(F.col("__range") - 1, F.lit(n)))
    own, guest = F.struct(F.col("__range").alias("at"), F.lit(0).alias("guest")), F.struct(before.alias("at"), F.lit(1).alias("guest"))
    dealt = placed.withColumn("__to", F.explode(F.filter(F.array(own, guest), lambda x: x["at"].isNotNull())))
    order = Window.partitionBy(F.col("__to")["at"]).orderBy(F.col("__to")["guest"], "__key", text_col)
    found = dealt.withColumn(out, F.lead(F.struct(*carried)).over(order))
    return found.where(F.col("__to")["guest"] == 0).drop("__key", "__range", "__to")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the fingerprints of its text and of the text whose second half is the next document's begin, and their likeness."""
    texts = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text")))
    # hashes are shuffled as eight bytes each
    own = texts.select("doc_id", "text", F.col("sketch")["whole"].alias("whole"), F.unhex(F.array_join(F.col("sketch")["hashes"], "")).alias("bits"))
    rows = with_next(own, "doc_id", "text", ["text", "whole", "bits"])
    n, half = F.length("text"), F.shiftright(F.length("text"), 1)
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next")["text"].substr(F.lit(1), half))
    cut = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), _unpacked(F.col("whole"), F.col("bits")).alias("sketch"), _unpacked(F.col("next")["whole"], F.col("next")["bits"]).alias("next_sketch"))
    both = cut.withColumn("edited_sketch", sketch(F.col("edited")))
    met = both.select("*", overlap(F.col("sketch"), F.col("edited_sketch")).alias("with_edited"), overlap(F.col("sketch"), F.col("next_sketch")).alias("with_next"))
    return met.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("with_edited")).alias("near_edited"),
        likeness(F.col("with_next")).alias("near_next"),
        containment(F.col("with_edited")).alias("within_edited"),
        containment(F.col("with_next")).alias("within_next"),
    )


def op11_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op11_scaled_sketch": op11_scaled_sketch}
_TOP = _last_below(SHARE)
ORACLES = {
    "op11_scaled_sketch": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
nx AS (SELECT *, lead(text) OVER (ORDER BY doc_id) AS after, first_value(text) OVER (ORDER BY doc_id) AS head FROM d),
e AS (SELECT doc_id, n, text, coalesce(after, head) AS next, text[:n - n // 2] || CASE WHEN n < 2 THEN '' ELSE coalesce(after, head)[:n // 2] END AS edited FROM nx),
t AS (SELECT doc_id, 'own' AS kind, text AS x FROM e UNION ALL SELECT doc_id, 'edited', edited FROM e UNION ALL SELECT doc_id, 'next', next FROM e),
w AS (SELECT doc_id, kind, list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda s: s <> '') AS w FROM t),
h AS (SELECT doc_id, kind, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1),
  lambda i: md5(array_to_string(w[i:i + {SHINGLE - 1}], ' '))[:16]))) END AS h FROM w),
k AS (SELECT doc_id, kind, h, greatest({LEAST}, len(list_filter(h, lambda x: x <= '{_TOP}'))) AS n FROM h),
s AS (SELECT doc_id, kind, len(h) <= n AS whole, h[:n] AS h, CASE WHEN len(h) <= n THEN 'g' ELSE greatest('{_TOP}', h[n]) END AS top FROM k),
p AS (SELECT a.doc_id, b.kind, a.whole AS own_whole, a.h AS own_h, b.whole, b.h, list_filter(a.h, lambda x: x <= least(a.top, b.top)) AS x,
  list_filter(b.h, lambda x: x <= least(a.top, b.top)) AS y FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.kind = 'own' AND b.kind <> 'own'),
o AS (SELECT *, len(list_intersect(x, y)) AS met FROM p),
l AS (SELECT *, CASE WHEN len(x) + len(y) - met = 0 THEN 1.0::DOUBLE ELSE met::DOUBLE / (len(x) + len(y) - met) END AS near,
  CASE WHEN len(x) = 0 THEN 1.0::DOUBLE ELSE met::DOUBLE / len(x) END AS within FROM o)
SELECT e.doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256,
  CASE WHEN c.own_whole THEN 'w' ELSE 'p' END || array_to_string(c.own_h, '') AS fingerprint,
  CASE WHEN c.whole THEN 'w' ELSE 'p' END || array_to_string(c.h, '') AS edited_fingerprint,
  c.near AS near_edited, x.near AS near_next, c.within AS within_edited, x.within AS within_next
FROM e JOIN l c ON c.doc_id = e.doc_id AND c.kind = 'edited' JOIN l x ON x.doc_id = e.doc_id AND x.kind = 'next'
"""
}
