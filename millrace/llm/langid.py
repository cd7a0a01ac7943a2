"""Language ID by nearest centroid.

Texts are lower-cased, runs of ASCII bytes other than letters read as one space, and the byte n-grams of one to three bytes are hashed to a fixed
number of columns. Counts are damped by the logarithm, weighted by inverse document frequency and
scaled to length 1. Every language gets several centroids by spherical k-means; a text gets the
language of the centroid of highest cosine, and that cosine as score. A text whose cosine lies below
what training documents of that centroid had (their lowest hundredth, less a margin) is marked as
rejected; ``predict`` can turn that into ``und``, the query must name a learned language
and gives the mark as a further column.

Training takes at most ``sample_rows`` labelled documents, the same number of each language and at most ``per_language`` (those of
the smallest hash): a documented bound of the sample, in which every language has its part. Their vectors stay on the executors, where
each language is clustered by a task of its own; the centroids come to the driver, 8 KB each and no more than the sample has
rows. Whole texts are used in training and prediction. lang, source and doc_id are no inputs of a prediction.

Defined cases: null texts and texts without a letter are ``und`` with score 0; so is every text if
nothing could be learned; very long texts are counted whole; ties go to the first centroid in alphabetical order of the languages;
repeated rows are judged alike; a document of a null id takes no part in training, is not marked as held out and is judged like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrowmap import gathered
from .kernel import buffers, chunks
from .workspace import Workspace

DIMENSIONS = 2048
PER_LANGUAGE, SAMPLE_ROWS = 400, 20_000
UND = "und"


#: ASCII bytes other than small letters tell no language: they all read as a space.
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:128] = 0x20
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def letters_only(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets with each run of ASCII marks, digits and white space as one space."""
    d = _LETTERS[data]
    gap = d == 0x20
    keep = np.ones(len(d), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    first = offsets[:-1]
    keep[first[first < len(d)]] = True
    ends = np.append(0, np.cumsum(keep))
    return d[keep], ends[offsets]


def vectors(texts: pa.Array, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of hashed byte n-grams (1 to 3) of the lower-cased texts, a row each."""
    lowered = pc.utf8_lower(pc.fill_null(texts, ""))
    data, offsets = letters_only(*buffers(lowered))
    out = np.zeros((len(lowered), dimensions), np.float32)
    spread = np.uint32(0x9E3779B1)
    shift = np.uint32(32 - dimensions.bit_length() + 1)
    for i, j, d, o in chunks(data, offsets, 1 << 20):
        row = np.repeat(np.arange(j - i, dtype=np.int32), np.diff(o))
        x, here = d.astype(np.uint32), np.zeros((j - i) * dimensions, np.int64)
        for n in (1, 2, 3):
            if len(d) < n:
                continue
            m = len(d) - n + 1
            gram = x[:m].copy()
            for k in range(1, n):
                gram |= x[k : k + m] << np.uint32(8 * k)
            inside = row[:m] == row[n - 1 :]
            column = ((gram + np.uint32(n << 26)) * spread) >> shift
            here += np.bincount(row[:m][inside].astype(np.int64) * dimensions + column[inside], minlength=len(here))
        out[i:j] = here.reshape(j - i, dimensions)
    return out


def _scaled(v: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", v, v))
    return v / np.maximum(length, 1e-12)[:, None]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray  # cosine below which each centroid rejects

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        return _scaled(np.log1p(counts) * self.idf)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        n = len(texts)
        lang, score, rejected = [UND] * n, np.zeros(n), np.zeros(n, bool)
        if not self.languages:
            return lang, score, rejected
        cosine = self.weigh(vectors(texts)) @ self.centroids.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(n), best], 0.0, 1.0)
        for k in np.flatnonzero(letters):
            lang[k] = self.languages[best[k]]
        score[letters] = top[letters]
        rejected[letters] = (top < self.floor[best])[letters]
        return lang, score, rejected


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; starts far apart, so it needs no random numbers."""
    k = min(k, len(x))
    picks = [int((x @ x.mean(axis=0)).argmax())]
    while len(picks) < k:
        picks.append(int((x @ x[picks].T).max(axis=1).argmin()))
    centres = x[picks].copy()
    of = np.zeros(len(x), int)
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        for c in range(k):
            if (of == c).any():
                centres[c] = x[of == c].mean(axis=0)
        centres = _scaled(centres)
    return centres, of


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, clusters: int = 4, margin: float = 0.05) -> Model:
    """Learn from the rows of df that have text, language and id; the caller leaves out held-out rows."""
    space = Workspace(df.sparkSession, "langid")
    usable = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = usable.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = space.save(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows))
    languages = counted.count()
    if not languages:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    each = max(1, min(per_language, sample_rows // languages))
    # of a large language only rows of a small hash go on, some twice as many as are taken, so that no task gets all of its rows
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("draw")), 11).cast("double") / F.lit(float(1 << 53))
    drawn = rows.join(F.broadcast(counted), "lang").where(draw * F.col("count") <= F.lit(2.0 * each + 100)).drop("count")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit("draw")), "id", F.xxhash64("text"))
    chosen = drawn.where(F.col("text").rlike(r"\p{L}")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            v = vectors(t["text"].combine_chunks())
            yield pa.RecordBatch.from_arrays([t["id"].combine_chunks(), t["lang"].combine_chunks().cast(pa.string()), pa.array([x.tobytes() for x in v], pa.binary())], names=["id", "lang", "counts"])

    sample = space.save(chosen.select("id", "lang", "text").mapInArrow(count, "id long, lang string, counts binary"))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, seen = 0, np.zeros(DIMENSIONS, np.int64)
        for b in batches:
            v = _matrix(b["counts"])
            rows, seen = rows + len(v), seen + (v > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([seen.tobytes()], pa.binary())], names=["rows", "seen"])

    parts = sample.mapInArrow(frequency, "rows long, seen binary").collect()
    total, seen = sum(p.rows for p in parts), sum(np.frombuffer(p.seen, np.int64) for p in parts)
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    def cluster(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("counts", "ascending")])
        own = _scaled(np.log1p(_matrix(table["counts"])) * idf)
        centres, of = _kmeans(own, clusters)
        near = np.einsum("ij,ij->i", own, centres[of])
        floors = [float(np.quantile(near[of == k], 0.01)) - margin if (of == k).any() else 1.0 for k in range(len(centres))]
        return pa.table({"lang": table["lang"].slice(0, 1).to_pylist() * len(centres), "k": list(range(len(centres))), "centre": pa.array([c.astype(np.float32).tobytes() for c in centres], pa.binary()), "floor": floors})

    found = sorted(sample.groupBy("lang").applyInArrow(cluster, "lang string, k long, centre binary, floor double").collect(), key=lambda r: (r.lang, r.k))
    if not found:
        return Model([], np.zeros((0, DIMENSIONS), np.float32), np.ones(DIMENSIONS, np.float32), np.zeros(0))
    return Model([r.lang for r in found], np.stack([np.frombuffer(r.centre, np.float32) for r in found]), idf, np.array([r.floor for r in found]))


def _matrix(counts: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return buffers(counts)[0].view(np.float32).reshape(-1, DIMENSIONS)


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row; with ``reject``, rejected texts are ``und``.
    The id must be an integer or null."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(batches):
            for at in range(0, t.num_rows, 4096):  # bounds the matrix of vectors
                part = t.slice(at, 4096).combine_chunks()
                lang, score, rejected = model.predict(part["text"].combine_chunks())
                if reject:
                    lang = [UND if r else x for x, r in zip(lang, rejected, strict=True)]
                yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), pa.array(lang, pa.string()), pa.array(np.round(score, 6)), pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, "doc_id long, lang_pred string, score double, rejected boolean")


def op7_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    model = train(docs.where(~held_out))
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op7_nearest_centroid": op7_nearest_centroid}
#: A trained model has no counterpart in SQL; the tests measure held-out accuracy.
ORACLES: dict[str, str] = {}
