"""Exact dedup by content sort (native).

Texts are normalised (each run of white space becomes one space), range-partitioned along sampled
splitters by their first bytes and then a hash of all bytes, and sorted within the partitions by those and
by the whole texts, which spills to disk where it must. In that order equal texts are neighbours; the window operator walks it, comparing the full bytes of
neighbours, and the smallest identifier of each run stays.

A text that very many rows hold would fill one range. Texts are therefore counted by a 64-bit hash of what they are
normalised to (all rows, with partial sums), and one that holds more than a ``1 / HOT_SHARE`` of the rows (and more than
``hot_rows``) is dealt over several cells by a salt after the text, in proportion to its count. At most HOT_SHARE
texts can hold so much, so the table of salts, which is broadcast, has a proven bound without leaving any out. What the cells
of one text found is merged by the SHA-256 of the text; only texts of several cells take part, so that this table has the same
bound. Neither number changes the result.

Defined cases: a null text counts as empty; a null doc_id loses against any other; of rows that
repeat both text and id one stays (and ties are no others); very long texts are sorted and compared whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

HOT_SHARE, HOT_ROWS = 1 << 16, 256
#: Bytes of a text that a splitter holds; texts with the same ones are told apart by their hash, and then in full.
SPLITTER_BYTES = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per row of df: doc_id, keep_id, group_size, kept, text_sha256."""
    space = Workspace(df.sparkSession, "exact")
    rows = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm")).withColumn("hash", F.xxhash64("norm"))
    least = max(hot_rows, -(-df.count() // HOT_SHARE))
    hot = rows.groupBy("hash").count().where(F.col("count") > least)
    salts = hot.select("hash", F.ceil(F.col("count") / F.lit(least)).alias("salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(F.col("doc_id")), F.col("salts")), F.lit(0)).cast("int")
    salted = rows.join(F.broadcast(salts), "hash", "left").select("doc_id", "norm", "hash", salt.alias("salt"))
    # the sampled splitters come to the driver: a head of the bytes and a hash bound their size, and equal texts share both
    routed = salted.select("*", F.substring(F.col("norm").cast("binary"), 1, SPLITTER_BYTES).alias("head"))
    dealt = routed.repartitionByRange("head", "hash", "salt")
    run = Window.partitionBy("head", "hash", "salt", "norm").orderBy(F.asc_nulls_last("doc_id"))
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = space.save(
        dealt.select(
            "doc_id",
            F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
            "salt",
            F.first("doc_id").over(whole).alias("cell_keep"),
            F.count(F.lit(1)).over(whole).alias("cell_size"),
            F.row_number().over(run).alias("place"),
        )
    )
    heads = cells.where("place = 1").groupBy("text_sha256").agg(F.count(F.lit(1)).alias("cells"), F.min("cell_keep").alias("all_keep"), F.sum("cell_size").alias("all_size"))
    merged = heads.where("cells > 1").drop("cells")
    out = cells.join(F.broadcast(merged), "text_sha256", "left")
    keep, size = F.coalesce("all_keep", "cell_keep"), F.coalesce("all_size", "cell_size")
    return out.select("doc_id", keep.alias("keep_id"), size.cast("long").alias("group_size"), ((F.col("place") == 1) & F.col("doc_id").eqNullSafe(keep)).alias("kept"), "text_sha256")


def op5_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_content_sort_dedup": op5_content_sort_dedup}
ORACLES = {
    "op5_content_sort_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
