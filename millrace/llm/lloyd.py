"""Centroid clustering: delta Lloyd.

Vectors become integers, so that sums are exact and do not depend on the order in which they add up. A table keeps for each
vector its owner (the nearest centroid) and the squared distance to it; the driver keeps, for each centroid, the sum and the count of its
vectors (``k`` times ``dims`` numbers). A round does only what the last one made necessary:

- a vector whose owner stands where it stood compares its known distance with the centroids that moved, and with no other;
- a vector whose owner moved compares all;
- vectors that change hands are added to the sums of the new owner and taken from those of the old one: signed integers,
  summed by Spark to a row a centroid. Nothing else is summed again.

A round writes the table anew in the shared folder, from partitions that are never shuffled, and removes the last one; a lost
executor costs the tasks of its round. When no centroid moves, all further rounds would change nothing, and are left out.

Defined cases: vectors that are null, of another length, or with a component that is null, not finite or so large that a squared distance might not
fit a long (2^17 and more) are left out; ties go to the smaller number; rows that repeat an id or a vector are vectors of
their own; a null id counts as an empty one in the choice of first centroids, and rows of one id are chosen by their components; with
fewer vectors than centroids there are as many centroids; an empty table gives an empty result; further columns are ignored; a sum of
distances that no long holds is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

DIMS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Scaled components are below this, so that 64 squares of differences fit a long.
_MOST = 1 << 27


def scaled(vec: Column, dims: int = DIMS, scale: int = SCALE) -> tuple[Column, Column]:
    """Whether a vector is kept, and its integers."""
    fits = F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < _MOST, F.lit(False)))
    return (F.size(vec) == dims) & fits, F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("int"))


def _assign(centroids: np.ndarray, moved: np.ndarray):
    """The step of one round over batches of (vec_id, v, cluster, distance, was)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, centroids.shape[1]).astype(np.int64)
            was = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
            owner, best = was.copy(), b.column("distance").to_numpy(zero_copy_only=False).astype(np.int64)
            lost = (was < 0) | moved[was]
            best[lost], owner[lost] = np.iinfo(np.int64).max, len(centroids)
            for k, c in enumerate(centroids):
                at = np.arange(n) if moved[k] else np.flatnonzero(lost)
                if len(at):
                    d = ((v[at] - c) ** 2).sum(axis=1)
                    nearer = (d < best[at]) | ((d == best[at]) & (k < owner[at]))
                    owner[at[nearer]], best[at[nearer]] = k, d[nearer]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(owner.astype(np.int32)), pa.array(best), pa.array(was.astype(np.int32))], names=["vec_id", "v", "cluster", "distance", "was"])

    return run


def transfers(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """What each centroid won and lost in a round: count and sums, signed; a row a centroid comes to the driver."""
    gone = F.struct(F.col("was").alias("k"), F.lit(-1).cast("long").alias("sign"))
    come = F.struct(F.col("cluster").alias("k"), F.lit(1).cast("long").alias("sign"))
    hands = state.where("cluster <> was").select("v", F.explode(F.array(gone, come)).alias("m")).where("m.k >= 0")
    sums = [F.sum(F.col("m")["sign"] * F.col("v")[i]).alias(f"s{i}") for i in range(dims)]
    rows = hands.groupBy(F.col("m")["k"].alias("k")).agg(F.sum(F.col("m")["sign"]).alias("n"), *sums).collect()
    return {r["k"]: (r["n"], [r[f"s{i}"] for i in range(dims)]) for r in rows}


def clusters(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark, space = df.sparkSession, Workspace(df.sparkSession, "lloyd")
    kept, v = scaled(F.col(vec_col), dims)
    rows = df.where(kept).select(F.col(id_col).alias("vec_id"), v.alias("v"))
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.orderBy(named, "v").limit(k).select("v").collect()
    schema = f"vec_id {df.schema[id_col].dataType.simpleString()}, v array<int>, cluster int, distance long, was int"
    state = rows.select("vec_id", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(-1).alias("was"))
    if not first:
        return state.select("vec_id", "cluster", "distance", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
    moved = np.ones(len(centroids), dtype=bool)
    for round_ in range(rounds + 1):
        state = space.save(state.mapInArrow(_assign(centroids, moved), schema))
        space.keep_last()
        if round_ == rounds:
            break
        for c, (n, change) in transfers(state, dims).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], change, strict=True)]
        after = np.array([[s // n for s in total] if n else list(old) for total, n, old in zip(sums, counts, centroids.tolist(), strict=True)], dtype=np.int64)
        moved, centroids = (after != centroids).any(axis=1), after
        if not moved.any():
            break
    inertia = {r["cluster"]: r["s"] for r in state.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}
    whole = None if None in inertia.values() or sum(inertia.values()) >= 1 << 63 else sum(inertia.values())
    told = [(c, s, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    table = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # a row a centroid
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """All rounds in full, each with every vector against every centroid."""
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS BIGINT) AS k, v AS c FROM (SELECT v, sha256('{SEED}:' || vec_id) AS h FROM v ORDER BY h LIMIT {CENTROIDS}))",
    ]
    square = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for r in range(ROUNDS + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, CAST(m % {CENTROIDS} AS INTEGER) AS k, m // {CENTROIDS} AS d FROM (SELECT vec_id, v, min(CAST({square} AS BIGINT) * {CENTROIDS} + k) AS m FROM v, c{r} GROUP BY vec_id, v))")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT k, list(x ORDER BY i) AS c FROM (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n, (s - ((s % n + n) % n)) // n AS x FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i) GROUP BY k)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(s.c, o.c) AS c FROM c{r} o LEFT JOIN s{r} s ON s.k = o.k)")
    last = f"SELECT vec_id, a.k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"
    return "WITH " + ",\n".join(parts) + "\n" + last


QUERIES = {"op12_delta_lloyd": op12_delta_lloyd}
ORACLES = {"op12_delta_lloyd": _sql()}
