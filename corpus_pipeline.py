"""A corpus pipeline of five of the training-data operators.

Each stage works on all rows that the one before kept, and its decisions take effect: documents that
the quality rules reject go; repeated lines go, and with them documents of which no word is left; of
each group of near copies (Jaccard 0.8 or more of 5-word shingles) the smallest id stays; documents are sampled to the target mix; what is left
is encoded, and decoded from the ids. All stages but the last return the columns of ``documents``.

Defined cases: null and empty texts fail the quality rules and go; rows with a null id stay in the n-gram join, as they link with
nothing; rows that repeat an id are judged by their own texts, and share the draw of the mix; very long texts are handled whole; ties
go to the smaller id; an empty table gives an empty result; further columns, whatever their names, are kept up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bpe import decode, default_vocabulary, encode
from millrace.llm.linededup import dedup_lines
from millrace.llm.mixing import sample_mix
from millrace.llm.ngramjoin import jaccard_groups
from millrace.llm.quality import judge, learn
from millrace.llm.workspace import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = "judged"
    while judged in docs.columns:
        judged += "_"
    return judge(docs, rules, out=judged).where(F.col(judged)["kept"]).drop(judged)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs, least_words=1)
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    kept = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = jaccard_groups(docs, gram=5, percent=80).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sample_mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = default_vocabulary()
    ids = encode(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return decode(ids, vocabulary).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_join),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe),
]

#: The learned rules, the groups of lines and the merges cannot be stated in SQL; tests run the line and
#: n-gram stages against brute force on small tables, and all stages on odd rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = space.save(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
