"""Sharding by weighted rendezvous hashing (native).

Every shard scores every record key; the best score wins. With u in (0, 1) from a 64-bit hash of
key and shard, the score of a shard of weight w is -w / ln(u), so a shard gets records in
proportion to its weight, and a shard that is added takes records only into itself: the scores of
the others do not change. A key alone decides, so the law is ``key``.

Defined cases: a null key is hashed like a value of its own, so all null keys share a shard; rows
with equal keys share a shard and are numbered one by one, those that agree in every column
in any order; equal scores go to the larger shard number; very long texts count by all of their bytes; a null text has no bytes and the CRC of
the empty text; an empty table gives an empty result; further columns are kept by
``assign_shards`` and ignored by the query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes that a record takes besides its text.
ROW_BYTES = 16


def _score(key: Column, shard: Column, weight: Column, seed: int) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, shard, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return -weight / F.ln(u)


def assign_shards(
    df: DataFrame, key: str = "doc_id", shards: int = 40, weights: Sequence[float] | None = None, grown_weight: float | None = None, seed: int = 20011, shard_col: str = "shard", grown_col: str | None = "grown_shard"
) -> DataFrame:
    """df with its shard and, if asked for, the shard it would have with one shard more.

    ``weights`` has one positive weight a shard (default: equal); the shard that is added has
    ``grown_weight`` (default: the mean).
    """
    weights = list(weights) if weights is not None else [1.0] * shards
    if len(weights) != shards or min(weights, default=1.0) <= 0:
        raise ValueError("one positive weight a shard is needed")
    extra = grown_weight if grown_weight is not None else sum(weights) / len(weights)
    scale = F.array(*(F.lit(float(w)) for w in [*weights, extra]))
    scored = F.transform(scale, lambda w, i: F.struct(_score(F.col(key), i, w, seed).alias("score"), i.alias("shard")))
    best = F.transform(
        F.array(scored),
        lambda s: F.struct(F.array_max(F.slice(s, 1, shards)).alias("now"), F.element_at(s, shards + 1).alias("added")),
    )[0]
    held = "__rendezvous"
    out = df.withColumn(held, best).withColumn(shard_col, F.col(f"{held}.now.shard").cast("int"))
    if grown_col:
        wins = F.col(f"{held}.added.score") > F.col(f"{held}.now.score")
        out = out.withColumn(grown_col, F.when(wins, F.lit(shards)).otherwise(F.col(shard_col)).cast("int"))
    return out.drop(held)


def number_slots(df: DataFrame, key: str = "doc_id", shard_col: str = "shard", slot_col: str = "slot", cells: int | None = None) -> DataFrame:
    """Number the rows of every shard from 0 without gaps.

    No shard is sorted in one task: rows are numbered within (shard, cell), a cell being a hash
    of the whole row, so that rows of one key spread too, and the counts of the cells before are added. The table of counts has at most
    shards x cells rows, and no more rows than df has groups, which bounds what is broadcast.
    """
    cells = cells or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cell = "__cell"
    rows = df.withColumn(cell, F.pmod(F.xxhash64(*(F.col(c) for c in df.columns), F.lit("cell")), F.lit(cells)).cast("int"))
    counts = rows.groupBy(shard_col, cell).count()
    before = Window.partitionBy(shard_col).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(shard_col), F.col(cell), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(shard_col, cell).orderBy(F.col(key), F.xxhash64(*(F.col(c) for c in df.columns))))
    ranked = rows.withColumn("__rank", rank)
    joined = ranked.join(F.broadcast(offsets), [shard_col, cell])
    return joined.withColumn(slot_col, (F.col("__before") + F.col("__rank") - 1).cast("long")).drop(cell, "__rank", "__before")


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = number_slots(assign_shards(sized, shards=40))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


QUERIES = {"op3_rendezvous_shards": op3_rendezvous_shards}
#: The hash of the law has no counterpart in the other engine; the tests compare with brute force.
ORACLES: dict[str, str] = {}
