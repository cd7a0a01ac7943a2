"""Sample arithmetic as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pcm16(samples: Column) -> Column:
    """Samples as 16-bit numbers: clamped to -1 to 1, scaled on either side of 0, cut towards 0."""

    def one(x: Column) -> Column:
        s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))
        return F.when(s < 0, s * 32768).otherwise(s * 32767).cast("smallint")

    return F.transform(samples, one)


def interleave(left: Column, right: Column) -> Column:
    return F.flatten(F.zip_with(left, right, lambda a, b: F.array(a, b)))


def resampled_length(n: Column, source: Column, target: Column) -> Column:
    return F.ceil(n * target / source).cast("long")


def wav_sizes(frames: Column, channels: Column) -> tuple[Column, Column]:
    """Bytes of data and of the file, of 16-bit sound with at most two channels."""
    data = (frames * F.least(channels, F.lit(2)) * 2).cast("long")
    return data, data + 44
