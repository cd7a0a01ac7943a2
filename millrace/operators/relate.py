"""Lookups that are joins: parts of packages, capabilities, reasons, ranges and style intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab as v


def spine(itemrefs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Chapters in reading order: each reference with every HTML item of that id; equal ids repeat."""
    html = manifest.where(F.col("mime").rlike("x?html"))
    return itemrefs.join(html, (itemrefs["file_id"] == html["file_id"]) & (itemrefs["idref"] == html["id"])).select(itemrefs["file_id"], itemrefs["seq"], html["href"])


def embedded(refs: DataFrame, rels: DataFrame, media: DataFrame) -> DataFrame:
    """References to pictures, over relationships to media."""
    return refs.join(rels, ["file_id", "rid"]).join(media, ["file_id", "path"])


def pictures_or_text(refs: DataFrame, media: DataFrame) -> DataFrame:
    """Each picture reference with its size, or with the text that stands for it."""
    out = refs.join(media, ["file_id", "path"], "left")
    return out.withColumn("stand_in", F.when(F.col("bytes").isNull(), F.concat(F.lit("[image: "), F.coalesce("alt", "path"), F.lit("]"))))


def able(targets: DataFrame, capabilities: DataFrame, yes: bool = True) -> DataFrame:
    """Targets that can (or cannot) be written. The vocabulary has some twenty rows."""
    return targets.join(F.broadcast(capabilities.where("supported").select("target").distinct()), "target", "left_semi" if yes else "left_anti")


def with_reason(spark: SparkSession, failures: DataFrame) -> DataFrame:
    """failures (code, family, target) with the reason a user reads; video has its own for two codes. The table of reasons is fixed and small."""
    table = v.reasons_table(spark)
    common = F.broadcast(table.where("family IS NULL").select("code", F.col("reason").alias("__common")))
    own = F.broadcast(table.where("family IS NOT NULL").select("code", "family", F.col("reason").alias("__own")))
    out = failures.join(common, "code", "left").join(own, ["code", "family"], "left")
    text = F.coalesce("__own", "__common", F.lit(v.DEFAULT_REASON))
    return out.withColumn("reason", F.replace(text, F.lit("{target}"), F.coalesce("target", F.lit("")))).drop("__own", "__common")


def with_rung(spark: SparkSession, rows: DataFrame, quality: str) -> DataFrame:
    """Range lookup: the rung whose range (low, high] holds the clamped quality. Five rows, broadcast."""
    from ..functions.files import clamp_quality

    q = clamp_quality(F.col(quality))
    r = F.broadcast(v.rungs_table(spark))
    return rows.join(r, (q > F.col("low")) & (q <= F.col("high")))


def style_at(bounds: Column, place: Column) -> Column:
    """Style of the first bound (struct of end and style) that ends after the place; the last one's beyond all."""
    hit = F.filter(bounds, lambda b: place < b["end"])
    return F.coalesce(F.get(hit, F.lit(0))["style"], F.element_at(bounds, -1)["style"])


def with_metadata(rows: DataFrame, probes: DataFrame, key: str = "hid") -> DataFrame:
    """Cached probes: not probed, probed and unreadable, or known."""
    out = rows.join(probes.withColumn("probed", F.lit(True)), key, "left")
    return out.withColumn("probed", F.coalesce("probed", F.lit(False)))
