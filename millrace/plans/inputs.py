"""File rows made of the tables at hand, and the same in SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v

NAME_ENDS = [e for f in v.EXTS.values() for e in f] + v.STUB_EXTS + [".gif", ".avif", "", ".XYZ", ".PNG", ".tar.gz", ".x_y"]
KINDS: list[str | None] = [None, "", *(t for f in v.TYPES.values() for t in f), "image/gif", "image/avif", "image/x-other", "audio/x-other", "video/x-other", "text/html", "IMAGE/PNG"]
GLOBAL_TARGETS = ["PNG", "WEBP", "MP3", "WAV", "PDF", "DOCX", "MP4", "AVI", "HEIC", "GIF"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list, place: Column) -> Column:
    """The value at a place from 0."""
    return F.element_at(F.array(*(F.lit(x).cast("string") for x in values)), (place + 1).cast("int"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hid, name, size, type and a wanted target, one for each part."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("f"), k.cast("string")).alias("hid"),
        k.alias("seq"),
        F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), pick(NAME_ENDS, k % len(NAME_ENDS))).alias("name"),
        (F.floor(F.col("p_retailprice") * 100).cast("long") * (1 + (k * 37) % 997) * (1 + 99 * (k % 2))).alias("size"),
        pick(KINDS, (k * 7) % len(KINDS)).alias("type"),
        pick(GLOBAL_TARGETS, F.col("p_size") % len(GLOBAL_TARGETS)).alias("wanted"),
        (k % 101).cast("int").alias("quality"),
        F.col("p_size").alias("batch"),
    )


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if x is None else "'" + x + "'" for x in values) + "]"


FILES_SQL = f"""
files AS (
  SELECT 'f' || p_partkey AS hid, p_partkey AS seq,
    replace(p_name, ' ', '-') || {_list(NAME_ENDS)}[p_partkey % {len(NAME_ENDS)} + 1] AS name,
    CAST(floor(p_retailprice * 100) AS BIGINT) * (1 + (p_partkey * 37) % 997) * (1 + 99 * (p_partkey % 2)) AS size,
    {_list(KINDS)}[(p_partkey * 7) % {len(KINDS)} + 1] AS type,
    {_list(GLOBAL_TARGETS)}[p_size % {len(GLOBAL_TARGETS)} + 1] AS wanted,
    CAST(p_partkey % 101 AS INTEGER) AS quality, p_size AS batch
  FROM part)
"""


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{x}'" for x in values) + ")"


def _ends(column: str, exts: list[str]) -> str:
    return "(" + " OR ".join(f"ends_with({column}, '{e}')" for e in exts) + ")"


EXT_SQL = "CASE WHEN contains(lower(name), '.') THEN substr(lower(name), length(name) - strpos(reverse(name), '.') + 1) ELSE '' END"
SUPPORTED_SQL = "(" + " OR ".join(f"coalesce(lower(type), '') IN {_in(v.TYPES[f])} OR {_ends('lower(name)', v.EXTS[f])}" for f in v.TYPES) + ")"
FAMILY_SQL = (
    f"CASE WHEN {EXT_SQL} IN ('.gif', '.avif') OR coalesce(lower(type), '') IN ('image/gif', 'image/avif') THEN '' "
    + " ".join(f"WHEN coalesce(lower(type), '') IN {_in(v.TYPES[f])} OR {_ends('lower(name)', v.EXTS[f])} THEN '{f}'" for f in v.TYPES)
    + f" WHEN {EXT_SQL} IN {_in(v.STUB_EXTS)} THEN 'image' "
    + " ".join(f"WHEN coalesce(lower(type), '') LIKE '{f}/%' THEN '{f}'" for f in ("image", "audio", "video"))
    + " ELSE '' END"
)
LIMIT_SQL = f"CASE WHEN family = 'video' THEN {v.MAX_BYTES_VIDEO}::BIGINT ELSE {v.MAX_BYTES}::BIGINT END"
TARGET_SQL = (
    "CASE WHEN family = 'document' THEN 'PDF' "
    + " ".join(f"WHEN family = '{f}' THEN CASE WHEN wanted IN {_in(v.TARGETS[f])} THEN wanted ELSE '{v.DEFAULT_TARGET[f]}' END" for f in ("image", "audio", "video"))
    + " ELSE wanted END"
)


def weight_sql(family: str, target: str) -> str:
    return f"CASE {target} " + " ".join(f"WHEN '{t}' THEN {w}::DOUBLE" for t, w in v.WEIGHTS[family].items()) + f" ELSE {v.MISSING_WEIGHT[family]}::DOUBLE END"


def estimate_sql(family: str, target: str, size: str, q: str) -> str:
    source, q = f"greatest(1.0::DOUBLE, {size} / 1024.0::DOUBLE)", f"({q})::DOUBLE"
    base = lambda f: f"{source} * {weight_sql(f, target)} / 1.2::DOUBLE"
    lossy = f"(0.4::DOUBLE + 0.98::DOUBLE * {q} / 100.0::DOUBLE)"
    return f"""CASE {family}
      WHEN 'audio' THEN {base("audio")} * CASE WHEN {target} = 'WAV' THEN 1.0::DOUBLE ELSE {lossy} END * 1.35::DOUBLE
      WHEN 'document' THEN {base("document")} * CASE WHEN {target} = 'PDF' THEN 0.6::DOUBLE + 0.6::DOUBLE * {q} / 100.0::DOUBLE ELSE 1.0::DOUBLE END
      WHEN 'video' THEN {base("video")} * (0.35::DOUBLE + 1.85::DOUBLE * {q} / 100.0::DOUBLE)
      ELSE {base("image")} * {lossy} END"""


def size_sql(n: str) -> str:
    """fmt_size in whole numbers."""

    def fixed(unit: int, digits: int) -> str:
        s = 10**digits
        x = f"(({n} * {s} + {unit // 2}) // {unit})"
        return f"({x} // {s}) || '.' || lpad(CAST({x} % {s} AS VARCHAR), {digits}, '0')"

    return f"CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN {fixed(1 << 10, 1)} || ' KB' WHEN {n} < 1073741824 THEN {fixed(1 << 20, 1)} || ' MB' ELSE {fixed(1 << 30, 2)} || ' GB' END"


def kb_sql(kb: str) -> str:
    t = f"CAST(floor({kb} / 1024.0::DOUBLE * 10.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)"
    return f"CASE WHEN {kb} >= 1024 THEN ({t} // 10) || '.' || ({t} % 10) || ' MB' ELSE CAST(floor({kb} + 0.5::DOUBLE) AS BIGINT) || ' KB' END"
