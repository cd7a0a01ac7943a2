"""Admission to a queue: files are taken in order until the queue is full."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import MAX_FILES


def admit(df: DataFrame, ok: Column, queue: Sequence[str], order: str, most: int = MAX_FILES) -> DataFrame:
    """df with state (accepted, rejected or full) and place (from 1, of accepted rows).

    Once ``most`` rows of a queue were accepted, every later one meets a full queue, whatever it is.
    A queue is a batch that one user handed in; the window runs along it and keeps one counter.
    """
    before = Window.partitionBy(*queue).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum(F.when(ok, 1).otherwise(0)).over(before), F.lit(0))
    state = F.when(taken >= most, "full").when(ok, "accepted").otherwise("rejected")
    return df.withColumn("state", state).withColumn("place", F.when((taken < most) & ok, taken + 1).cast("long"))
