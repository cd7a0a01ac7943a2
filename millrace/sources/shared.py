"""Intermediate tables in the folder that driver and executors share (``spark.checkpoint.dir``, read from the session)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """As the session says; chosen here only where it is unset: a temporary folder for a local master, else one below the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    found = tempfile.mkdtemp(prefix="millrace-")
    atexit.register(shutil.rmtree, found, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def saved(df: DataFrame, by: str) -> DataFrame:
    """Write df, a folder for each value of ``by``, and read it back: what made it runs once, and readers of some values read no others."""
    path = f"{shared_folder(df.sparkSession)}/saved-{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
