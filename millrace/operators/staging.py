"""A staging store of snapshots: what is put replaces all that was there, readers keep what they began with.

Each put writes a snapshot of its own; a commit is an empty file whose name holds its number and the snapshot's name, so that it is there or it is not. The
highest name counts. Two puts at once give two commits of one number, of which all readers take the same. ``vacuum`` removes snapshots that no reader of the last
commits can hold.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files as fx
from ..functions.vocab import MAX_FILES
from .lists import load_staged

_EMPTY = "empty"


class StagingStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._files.mkdirs(self._path(f"{self.root}/commits"))

    def commits(self) -> list[str]:
        """Names of the commits, the current one last."""
        return sorted(s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.root}/commits")) if not s.getPath().getName().startswith((".", "_")))

    def _commit(self, snapshot: str) -> str:
        last = self.commits()
        name = f"{int(last[-1].split('.')[0]) + 1 if last else 1:012d}.{snapshot}"
        self._files.createNewFile(self._path(f"{self.root}/commits/{name}"))
        return name

    def put(self, rows: DataFrame, target: str) -> str:
        """Replace what is staged: rows (name, size, type and more, in the order of ``seq``), with id, target and ts of this put."""
        snapshot = uuid.uuid4().hex
        told = rows.select(F.concat(F.lit(f"s{snapshot[:12]}-"), F.col("seq").cast("string")).alias("id"), *[c for c in rows.columns if c not in ("id", "target", "ts")], F.lit(target).alias("target"), F.unix_millis(F.current_timestamp()).alias("ts"))
        told.write.parquet(f"{self.root}/snapshots/{snapshot}")
        return self._commit(snapshot)

    def clear(self) -> str:
        return self._commit(_EMPTY)

    def staged(self) -> DataFrame | None:
        """What is staged now; None if nothing is."""
        last = self.commits()
        snapshot = last[-1].split(".")[1] if last else _EMPTY
        return None if snapshot == _EMPTY else self.spark.read.parquet(f"{self.root}/snapshots/{snapshot}")

    def vacuum(self, keep: int = 2) -> None:
        """Remove the commits before the last ``keep`` and the snapshots that no commit left names."""
        names = self.commits()
        held = {n.split(".")[1] for n in names[-keep:]}
        for n in names[:-keep]:
            self._files.delete(self._path(f"{self.root}/commits/{n}"), False)
        snapshots = self._path(f"{self.root}/snapshots")
        if self._files.exists(snapshots):
            for s in self._files.listStatus(snapshots):
                if s.getPath().getName() not in held and s.getPath().getName() in {n.split(".")[1] for n in names}:
                    self._files.delete(s.getPath(), True)


def usable(name: Column, kind: Column, size: Column) -> Column:
    """Whether a staged file may go into the queue: a supported type, within its family's size."""
    return fx.is_supported(name, kind) & (size <= fx.limit_bytes(fx.family_of(name, kind)))


def load_files(staged: DataFrame, most: int = MAX_FILES, tie: str = "seq") -> DataFrame:
    """The first ``most`` usable files (name, type, size, target) in staging order, each with the target that it was staged for if its family has it, else
    its family's own, and ``extra``: how many did not make it."""
    rows = load_staged(staged, usable(F.col("name"), F.col("type"), F.col("size")), most, tie)
    return rows.withColumn("target", fx.default_target(fx.family_of(F.col("name"), F.col("type")), F.col("target")))
