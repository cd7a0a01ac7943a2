"""Files from folders and into folders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.files import family_of
from ..functions.vocab import MAX_BYTES_VIDEO

_COLUMNS = ["hid", "name", "size", "type", "family", "ts", "content"]


def _rows(raw: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]*)$", 1)  # a path is no URL: signs stand for themselves
    named = raw.select(F.sha2("path", 256).alias("hid"), name.alias("name"), F.col("length").alias("size"), F.lit("").alias("type"), (F.unix_millis("modificationTime")).alias("ts"), "content")
    return named.withColumn("family", family_of(F.col("name"), F.col("type"))).select(*_COLUMNS)


def scan_files(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int = MAX_BYTES_VIDEO) -> DataFrame:
    """hid (a hash of the path, so that it is the same on every run), name, size, type, family, ts and content of the files below a path.
    Larger files than any limit allows are skipped before they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _rows(reader.load(path).where(F.col("length") <= most_bytes))


def arrivals(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """scan_files() of a folder that files keep coming into, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return _rows(reader.load(path))


def sample_file(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One named file of a folder of samples."""
    return scan_files(spark, folder, name)


def job_parameters(spark: SparkSession, **given: str) -> dict[str, str]:
    """staged and target of a job: as given, else of the session (``spark.millrace.staged``, ``spark.millrace.target``)."""
    return {k: given.get(k) or spark.conf.get(f"spark.millrace.{k}", "") for k in ("staged", "target")}


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    names: list[str]


class _FilesWriter(DataSourceWriter):
    """Files of one write: tasks write below a folder of the write, and a commit puts them in place. A task that is run again writes anew below its own
    folder, and only what succeeded is put in place; an abort leaves nothing behind."""

    def __init__(self, target: str):
        self.target, self.mark = target, f"_writing-{uuid.uuid4().hex}"

    def _at(self) -> tuple[fs.FileSystem, str]:
        found, path = fs.FileSystem.from_uri(self.target) if "://" in self.target else (fs.LocalFileSystem(), self.target)
        return found, path.rstrip("/")

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, path = self._at()
        own = f"{path}/{self.mark}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=True)
        names = []
        for name, content in rows:
            with store.open_output_stream(f"{own}/{name}") as f:
                f.write(bytes(content))
            names.append(name)
        return _Written(own, names)

    def commit(self, messages: list) -> None:
        store, path = self._at()
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{m.folder}/{name}", f"{path}/{name}")
        self._clear(store, path)

    def abort(self, messages: list) -> None:
        self._clear(*self._at())

    def _clear(self, store: fs.FileSystem, path: str) -> None:
        with suppress(FileNotFoundError):
            store.delete_dir(f"{path}/{self.mark}")


class FilesSink(DataSource):
    """``df.write.format("millrace_files")``: name and content of each row as a file below ``path``."""

    @classmethod
    def name(cls) -> str:
        return "millrace_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _FilesWriter(self.options["path"])


def distinct_names(results: DataFrame) -> DataFrame:
    """results (hid, name and more), each name given once: the second of one name is called ``name (2).end``, and so on. Contents take no part in the numbering."""
    safe = F.regexp_replace(F.coalesce("name", F.lit("file")), r"[/\\\x00]", "_")
    place = F.row_number().over(Window.partitionBy("name").orderBy("hid"))
    stem, end = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    first = results.select("hid", safe.alias("name")).withColumn("place", place)
    numbered = first.withColumn("name", F.when(F.col("place") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("place").cast("string"), F.lit(")"), end)))
    # a number may make a name that is there already
    twice = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    stem, end = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 2)
    told = numbered.withColumn("name", F.when(twice & (F.col("place") > 1), F.concat(stem, F.lit(" "), F.col("hid"), end)).otherwise(F.col("name"))).drop("place")
    return results.drop("name").join(told, "hid")


def save_files(results: DataFrame, folder: str) -> DataFrame:
    """Write content of each row (hid, name, content) as a file below a folder that all executors see; gives name, size and path. No two rows share a name."""
    spark = results.sparkSession
    spark.dataSource.register(FilesSink)
    named = distinct_names(results.where("content IS NOT NULL").select("hid", "name", "content"))
    named.select("name", "content").write.format("millrace_files").mode("append").save(folder)
    return named.select("name", F.octet_length("content").cast("long").alias("size"), F.concat(F.lit(f"{folder.rstrip('/')}/"), "name").alias("path"))
