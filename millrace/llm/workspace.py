"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder and is read from the session. Only where it is unset
(as in tests) a folder is chosen: a temporary one for a local master, else one below the warehouse.
A stage that was saved is never computed again, so lost executors cost at most one stage; and the
shuffle files of a stage are dropped as soon as its table is written, which keeps the disk need at
that of the largest stage instead of their sum.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith(("local[", "local")) and "cluster" not in spark.sparkContext.master:
            found = tempfile.mkdtemp(prefix="millrace-")
            atexit.register(shutil.rmtree, found, ignore_errors=True)
        else:
            found = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_millrace"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """Tables of one run of one operator. ``drop()`` removes them once the result has been written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and read it back; its lineage ends here."""
        self.count += 1
        path = f"{self.path}/{self.count}"
        before = self.spark.conf.get(_CLEAN, "false")
        self.spark.conf.set(_CLEAN, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            self.spark.conf.set(_CLEAN, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_last(self) -> None:
        """Remove the table before the last, when nothing will read it any more."""
        self._remove(f"{self.path}/{self.count - 1}")

    def drop(self) -> None:
        self._remove(self.path)

    def _remove(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
