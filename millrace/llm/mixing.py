"""Mixing sources to target weights by iterative proportional fitting (native).

Tokens are counted for each cell (source, language, topic). Raking scales the cells' weights to the
source, language and topic marginals in turn until the largest error of a marginal is below ``TOLERANCE``, or the rounds
are used up; marginals that contradict each other never meet, and the error that remains is told. The ratio of a cell's weight to
its tokens, scaled so that the expected sample has the wanted share of all tokens and no document
is wanted more than once, is the probability with which each of its documents is kept; the draw is
a hash of the document's id, so that it repeats.

Targets are shares by name, or by default the corpus' own shares raised to a power below 1, which
flattens the mix (small sources gain). The topic of a document is an expression of its columns;
the default tells genres by the surface of the text, as no table has topics.

The cells are few against the documents. Where they are at most ``BOUND_CELLS`` (counted, not
assumed) they are raked in one task and broadcast; beyond that the same statements run distributed.

Defined cases: null source, language or text form a category of their own (null text: topic
``none``); a document without words has no tokens, probability 0, and is not kept; very long texts count whole; ids that repeat
share their draw; ties do not arise, as a draw equals a probability in one case of 2^53 and then loses; an empty table gives an empty result. Further columns are ignored by
``op9`` and kept by ``sample_mix``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import Workspace

#: Cells that one task may rake and that may be broadcast: some 5 MB.
BOUND_CELLS = 50_000
#: Powers by which the shares of the corpus become targets.
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
_NAMES = ("source", "lang", "topic")
#: Largest error of a marginal, as a share of the whole, at which raking ends; rounds at once, and at most.
TOLERANCE, ROUNDS_AT_ONCE, MOST_ROUNDS = 1e-6, 6, 120


def token_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def surface_topic(text: Column) -> Column:
    """Genre by surface: shares of marks among the characters, and length."""
    n = F.length(text)
    marks = n - F.length(F.regexp_replace(text, r"[|#$%&*<>{}=]", ""))
    digits = n - F.length(F.regexp_replace(text, r"[0-9]", ""))
    return (
        F.when(text.isNull(), "none")
        .when(marks * 25 > n, "markup")
        .when(digits * 20 > n, "figures")
        .when(n < 300, "note")
        .when(n > 10000, "long")
        .otherwise("prose")
    )


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, space: Workspace | None = None) -> DataFrame:
    """Cells (source, lang, topic, n_tokens) with the raked ``weight``, which sum to 1, and ``error``: the largest difference of a
    marginal from its target that is left, the same in all rows.

    A name that ``targets[column]`` lacks gets the target 0; a column that it lacks gets the default.
    """
    space = space or Workspace(cells.sparkSession, "rake")
    over = {c: Window.partitionBy(c) for c in _NAMES}
    few = cells.count() <= BOUND_CELLS
    out = (cells.coalesce(1) if few else cells).select(*_NAMES, "n_tokens")
    for c in _NAMES:
        out = out.withColumn(f"__n_{c}", F.sum("n_tokens").over(over[c]).cast("double"))
    raw = {}
    for c in _NAMES:
        given = (targets or {}).get(c)
        if given is not None:
            named = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(float(v)))))
            raw[c] = F.coalesce(named[F.coalesce(F.col(c), F.lit(""))], F.lit(0.0))
        else:
            raw[c] = F.pow(F.col(f"__n_{c}"), F.lit(POWERS[c]))
    # each marginal's total, from its cells: a cell holds n / n_c of its category
    totals = out.agg(*(F.sum(raw[c] * F.col("n_tokens") / F.col(f"__n_{c}")).alias(c) for c in _NAMES)).first()
    total = {c: (totals[c] if totals and totals[c] else 1.0) for c in _NAMES}
    for c in _NAMES:
        out = out.withColumn(f"__t_{c}", raw[c] / F.lit(total[c]))
    out = out.withColumn("weight", F.col("n_tokens").cast("double"))
    error, done = 1.0, 0
    while done < MOST_ROUNDS:
        for _ in range(ROUNDS_AT_ONCE):
            for c in _NAMES:
                held = F.sum("weight").over(over[c])
                out = out.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"__t_{c}") / held).otherwise(0.0))
        out, done = space.save(out), done + ROUNDS_AT_ONCE
        out = out.coalesce(1) if few else out
        gaps = out.select(*(F.abs(F.sum("weight").over(over[c]) - F.col(f"__t_{c}")).alias(c) for c in _NAMES)).agg(*(F.max(c).alias(c) for c in _NAMES)).first()
        before, error = error, max(gaps[c] or 0.0 for c in _NAMES)
        if error < TOLERANCE or abs(before - error) < TOLERANCE / 100:
            break
    return out.select(*_NAMES, "n_tokens", "weight", F.lit(error).alias("error"))


def calibrate(cells: DataFrame, share: float) -> DataFrame:
    """Probability of each cell: min(1, k * weight / n_tokens), k such that the sample is expected
    to hold ``share`` of all tokens (or as much as cells of positive weight hold)."""
    ratio = F.col("weight") / F.col("n_tokens")
    k = None
    for _ in range(12):
        full = F.lit(False) if k is None else ratio * k >= 1
        s = cells.agg(F.sum("n_tokens").alias("n"), F.sum(F.when(full, F.col("n_tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        if not s["n"] or not s["rest"] or s["rest"] < 1e-12:
            k = k or 1.0
            break
        new = (share * s["n"] - s["full"]) / s["rest"]
        if k is not None and abs(new - k) <= 1e-9 * k:
            break
        k = new
    return cells.withColumn("prob", F.round(F.least(F.lit(1.0), ratio * F.lit(float(k))), 9))


def mix_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None, targets: Mapping[str, Mapping[str, float]] | None = None, share: float = 0.5, seed: int = 9001) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, prob, sampled, and the error that raking left (null without tokens)."""
    spark = df.sparkSession
    space = Workspace(spark, "mixing")
    text = F.col(text_col)
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), (surface_topic(text) if topic is None else topic).alias("topic"), token_count(text).alias("n_tokens"))
    rows = space.save(rows)
    cells = space.save(rows.where("n_tokens > 0").groupBy(*_NAMES).agg(F.sum("n_tokens").alias("n_tokens")))
    few = cells.count() <= BOUND_CELLS
    raked = rake(cells, targets, space)
    probs = calibrate(raked, share).select(*(F.col(c).alias(f"__{c}") for c in _NAMES), "prob", "error")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in _NAMES]
    joined = rows.join(F.broadcast(probs) if few else probs, same[0] & same[1] & same[2], "left")
    prob = F.when(F.col("n_tokens") > 0, F.coalesce("prob", F.lit(0.0))).otherwise(0.0)
    draw = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return joined.select("doc_id", *_NAMES, "n_tokens", prob.alias("prob"), (draw < prob).alias("sampled"), F.col("error").alias("rake_error"))


def sample_mix(df: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of df that the mix keeps, all columns. The ids that stay are joined by id; a row
    whose id repeats stays or goes with its like only if category and draw agree, else each id stays
    if any of its rows does. Rows with a null id go with the null id's draw."""
    kept = mix_rows(df, id_col=id_col, **options).where("sampled").select(F.col("doc_id").alias("__kept")).distinct()
    return df.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")), "left_semi")


def op9_mix_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_mix_to_targets": op9_mix_to_targets}
#: Raking to convergence and the hash draw cannot be stated in the other engine; tests use brute force.
ORACLES: dict[str, str] = {}
