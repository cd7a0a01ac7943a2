"""Aggregates over planned and converted files. All are hash aggregates that combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import files as fx
from ..functions import vocab as v
from ..functions.files import bitrate_label, fmt_size
from ..functions.text import round_half_up


def _trend(pct: Column) -> Column:
    return F.when(pct >= 0, "smaller").otherwise("larger")


def estimate_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Files, bytes, estimated KB, percentage saved, trend and bar (percent of the input, 100 at most)."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").cast("long").alias("bytes"), F.sum("est_kb").alias("est_kb"))
    share = F.col("est_kb") / (F.col("bytes") / 1024.0)
    pct = round_half_up((1 - share) * 100)
    return g.select(*keys, "n_files", "bytes", "est_kb", pct.alias("pct"), _trend(pct).alias("trend"), F.least(F.lit(100.0), share * 100).alias("bar"))


def batch_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each queue (with family, target and supported): its files, those that can be converted, those skipped, files of each family, and whether quality changes nothing for
    any of what is converted."""
    able = fx.convertible(F.col("family"), F.col("target"))
    ignoring = F.every(F.when(able, fx.ignores_quality(F.col("family"), F.col("target"))))
    kinds = [F.count_if(fx.is_family(F.col("family"), f)).alias(f"n_{f}") for f in v.TARGETS]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"), F.count_if(able).alias("n_convertible"), F.count_if(~able).alias("n_skipped"), *kinds, F.coalesce(ignoring, F.lit(False)).alias("quality_idle"))


#: How far a file of a queue is when a step begins (see ``progress``).
STEPS = {"decoding": 0.08, "recognising": 0.15, "encoding": 0.35, "finished": 1.0}


def progress(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """A row for each file and step of a queue: percent of the whole queue and its label."""
    queue = Window.partitionBy(*keys)
    placed = df.withColumn("nth", F.row_number().over(queue.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(queue))
    steps = F.array(*(F.struct(F.lit(step).alias("step"), F.lit(part).alias("part")) for step, part in STEPS.items()))
    each = placed.withColumn("s", F.explode(steps))
    label = F.when(F.col("n") > 1, F.concat(F.lit(" ("), F.col("nth").cast("string"), F.lit(" of "), F.col("n").cast("string"), F.lit(")"))).otherwise("")
    return each.select(*df.columns, F.col("s.step").alias("step"), ((F.col("nth") - 1 + F.col("s.part")) * 100 / F.col("n")).alias("percent"), label.alias("label"))


def measured_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What conversions measured: only results count, so files that failed are in neither sum."""
    one = F.when(F.count_distinct("target") == 1, F.min("target")).otherwise("Mixed")
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("src_size").cast("long").alias("bytes_in"), F.sum("size").cast("long").alias("bytes_out"), one.alias("label"))
    pct = round_half_up((1 - F.col("bytes_out") / F.col("bytes_in").cast("double")) * 100)
    return g.select(*keys, "n", "bytes_in", "bytes_out", "label", fmt_size(F.col("bytes_out")).alias("out_label"), pct.alias("pct"))


def result_header(df: DataFrame, keys: Sequence[str], quality: int, order: str = "seq") -> DataFrame:
    """The line above the results: here the input counts all files, failed ones too. The rates stand in the order in which they first
    come up; a group has no more of them than there are rates."""
    done = F.col("state") == "done"
    lossy = done & F.col("target").isin([t for t in v.TARGETS["audio"] if t not in v.LOSSLESS])
    label = F.when(lossy, bitrate_label(F.lit(quality), F.col("target")))
    rates = df.where(label.isNotNull()).groupBy(*keys, label.alias("label")).agg(F.min(order).alias("at"))
    rates = rates.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]), " / ").alias("rates"))
    counted = df.groupBy(*keys).agg(
        F.sum("src_size").cast("long").alias("bytes_in"),
        F.sum(F.when(done, F.col("size")).otherwise(0)).cast("long").alias("bytes_out"),
        F.count_if(done).alias("n_done"),
        F.count_if(F.col("state") == "failed").alias("n_failed"),
        F.count_if(F.col("state") == "unsupported").alias("n_unsupported"),
    )
    return counted.join(rates, list(keys), "left").withColumn("rates", F.coalesce("rates", F.lit("")))


def queue_state(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Common family of each queue (or mixed), whether all can be set at once, mode, and the queue's target repaired to its family."""
    same = F.min("family") == F.max("family")
    g = df.groupBy(*keys).agg(F.when(same, F.when(F.min("family") == "", "image").otherwise(F.min("family"))).otherwise("mixed").alias("family"), (same & (F.min("family") != "")).alias("bulk"), F.lower(F.min("wanted")).alias("wanted"))
    repaired = None
    for family, default in (("image", "png"), ("audio", "mp3"), ("document", "pdf"), ("video", "mp4")):
        own = F.when(F.col("wanted").isin(v.PICKER[family]), F.col("wanted")).otherwise(default)
        repaired = F.when(F.col("family") == family, own) if repaired is None else repaired.when(F.col("family") == family, own)
    return g.select(*keys, "family", "bulk", F.when(F.col("bulk"), "bulk").otherwise("manual").alias("mode"), repaired.otherwise(F.col("wanted")).alias("repaired"))
