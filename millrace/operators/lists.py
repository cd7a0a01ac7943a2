"""Ordered lists: history, staging, set operations and updates by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY_ROWS = 10


def dedup_history(entries: DataFrame, keys: Sequence[str], owner: Sequence[str] = (), order: str = "ts", tie: str = "id") -> DataFrame:
    """Newest entry of each (owner, keys). Partial maxima are combined before the shuffle."""
    rest = [c for c in entries.columns if c not in (*keys, *owner)]
    newest = F.max(F.struct(F.col(order), F.col(tie), *(F.col(c) for c in rest if c not in (order, tie)))).alias("__newest")
    out = entries.groupBy(*owner, *keys).agg(newest)
    return out.select(*owner, *keys, *(F.col(f"__newest.{c}").alias(c) for c in rest))


def top_history(entries: DataFrame, owner: Sequence[str] = (), most: int = HISTORY_ROWS, order: str = "ts", tie: str = "id") -> DataFrame:
    """The newest ``most`` entries (of each owner), with their place from 1. Spark limits each window group before the
    shuffle, or plans a top-k where there is no owner."""
    by = [F.desc(order), F.desc(tie)]
    if not owner:
        top = entries.orderBy(*by).limit(most)
        return top.withColumn("place", F.row_number().over(Window.orderBy(*by)))
    place = F.row_number().over(Window.partitionBy(*owner).orderBy(*by))
    return entries.withColumn("place", place).where(F.col("place") <= most)


def push_history(history: DataFrame, entry: DataFrame, most: int | None = None) -> DataFrame:
    """History with the new entries in front: an older one of the same name and size goes. ``most`` cuts what is stored."""
    out = dedup_history(history.unionByName(entry), ["name", "size"])
    return top_history(out, most=most).drop("place") if most else out.orderBy(F.desc("ts"), F.desc("id"))


def read_history(raw: DataFrame, column: str = "value") -> DataFrame:
    """Entries of JSON lists; what cannot be parsed, or is no list, gives no entry. Members that a list's object lacks are null, and so
    are those of a wrong type; an entry without name or size is none."""
    is_list = F.col(column).rlike(r"^\s*\[")
    parsed = F.from_json(F.when(is_list, F.col(column)), "array<struct<id:string,name:string,size:long,format:string,state:string,ts:long>>")
    whole = F.filter(parsed, lambda e: e["name"].isNotNull() & e["size"].isNotNull())
    others = [c for c in raw.columns if c != column]
    return raw.select(*others, F.explode(whole).alias("e")).select(*others, "e.*")


def write_history(entries: DataFrame) -> Column:
    """Entries of a group as one JSON list, for use in an aggregate."""
    return F.to_json(F.collect_list(F.struct(*entries.columns)))


def stage_order(staged: DataFrame, tie: str = "seq") -> DataFrame:
    """Staged rows by time, those without first; ties by their number in the batch."""
    return staged.orderBy(F.coalesce("ts", F.lit(0)), tie)


def stage_places(staged: DataFrame, owner: Sequence[str], tie: str = "seq") -> DataFrame:
    """The place of each staged row in its owner's order, from 1."""
    w = Window.partitionBy(*owner).orderBy(F.coalesce("ts", F.lit(0)), tie)
    return staged.withColumn("place", F.row_number().over(w))


def put_staged(rows: DataFrame, path: str) -> None:
    """Replace the staging table."""
    rows.write.mode("overwrite").parquet(path)


def clear_staged(spark: SparkSession, path: str) -> None:
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def load_staged(staged: DataFrame, usable: Column, most: int, tie: str = "seq") -> DataFrame:
    """The first ``most`` usable rows in staging order, with ``extra``: how many staged rows did not make it."""
    rows = staged.withColumn("__ok", usable)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("__ok").alias("ok"))
    top = rows.where("__ok").drop("__ok").orderBy(F.coalesce("ts", F.lit(0)), tie).limit(most)
    extra = counts.select((F.col("n") - F.least(F.col("ok"), F.lit(most))).cast("long").alias("extra"))
    return top.join(F.broadcast(extra), F.lit(True))


def remove(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def set_target(rows: DataFrame, target: str, which: Column) -> DataFrame:
    return rows.withColumn("target", F.when(which, F.lit(target)).otherwise(F.col("target")))
