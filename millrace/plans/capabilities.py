"""What this engine can read and write, with the code it gives for what it cannot.

What can be written follows from the writers that are there; formats that need an outside library are named by their
code and never imitated.
"""

from __future__ import annotations

import shutil
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab as v
from ..operators import convert

#: Targets that ``convert`` accepts.
WRITERS = set(convert.TARGETS)
NO_WRITER = {t: code for t, (_, code) in convert.FAILING.items()}


def encoder_found(name: str = "ffmpeg") -> bool:
    """Whether an outside encoder is on this machine's path."""
    return shutil.which(name) is not None


def capabilities(spark: SparkSession, writers: Iterable[str] = WRITERS) -> DataFrame:
    """family, target, supported, code."""
    able = set(writers)
    rows = [(f, t, t in able, None if t in able else NO_WRITER.get(t, "unsupported-target")) for f, ts in v.TARGETS.items() for t in ts]
    rows.append(("image", "HEIC", False, NO_WRITER["HEIC"]))
    return spark.createDataFrame(rows, "family string, target string, supported boolean, code string")


def recorder_type(target: str, offered: Iterable[str]) -> str | None:
    """First container type of a target that is offered."""
    offered = set(offered)
    return next((t for t in v.RECORDER_TYPES.get(target, ()) if t in offered), None)
