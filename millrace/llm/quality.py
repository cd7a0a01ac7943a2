"""Quality rules: a learned decision list (native).

Statistics of every text are Spark expressions. From labelled rows, sequential covering learns an
ordered list of threshold conjunctions that tell junk: a rule grows by the condition of the highest
FOIL gain, is pruned on rows held back for that, is kept if it is precise enough there, and what
it covers is set aside before the next. The list becomes one ordered CASE expression, so applying
it is a projection and needs no shuffle.

Learning reads at most ``sample_rows`` labelled documents (those of the smallest hash; a documented
bound). Their statistics are reduced by Spark to counts per combination of bins, and only those
counts (at most one a sampled row) come to the driver.

Defined cases: null text has no words and fails the base rule; a null or unlabelled document is
judged like any other; without usable labels the list is empty and the base rule alone decides;
very long texts are measured whole; rows of equal statistics tie and are judged alike, so are rows
that repeat an id or a text; of thresholds of equal gain the first in the order of features and values is taken; an empty
table gives an empty result; further columns are kept by ``judge``, which puts all that it adds into one column of a free
name, and ignored by the query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

SAMPLE_ROWS = 12_000
_SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = 5


def _repeat_words(words: Column) -> Column:
    """Words in windows of five words that the text has twice or more.

    Windows are compared by a 64-bit hash. Only where two are equal are they sorted with their
    places, to find the equal neighbours; the covered words are then counted along the places.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (_WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, _WINDOW)))

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        found = F.transform(
            F.array(placed),
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["h"] == x["h"])) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )[0]
        start = F.struct(F.lit(-_WINDOW).alias("last"), F.lit(0).alias("n"))
        total = F.aggregate(found, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(_WINDOW), p - a["last"])).alias("n")))
        return total["n"]

    counted = F.transform(F.array(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))[0]
    return F.when(n <= _WINDOW, F.lit(0)).otherwise(counted)


def statistics(text: Column) -> Column:
    """n_words, word_chars, n_dup_lines, n_repeat_words, n_symbols, n_upper and n_marks of a text, as one struct."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def without(pattern: str) -> Column:
        return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")

    def stats(w: Column, x: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            without(r"[#*$%&|<>]").alias("n_symbols"),
            without(r"[A-Z]").alias("n_upper"),
            without(r"[!?]").alias("n_marks"),
        )

    # the arrays are bound to lambda variables, so that each is made once a row
    return F.transform(F.array(words), lambda w: F.transform(F.array(lines), lambda x: stats(w, x))[0])[0]


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    """What the rules may put thresholds on: shares, and the mean length of a word."""
    chars, words = F.greatest(s["word_chars"], F.lit(1)), F.greatest(s["n_words"], F.lit(1))
    return {
        "symbol_share": s["n_symbols"] / chars,
        "upper_share": s["n_upper"] / chars,
        "mark_share": s["n_marks"] / chars,
        "repeat_share": s["n_repeat_words"] / words,
        "dup_lines_share": s["n_dup_lines"] / words,
        "word_length": s["word_chars"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        x = of[self.feature]
        return x >= F.lit(self.threshold) if self.above else x < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float


def _cover(cells: list[tuple[dict[str, int], bool, int, int]], cuts: dict[str, list[float]], most_rules: int, most_conditions: int, least_precision: float, least_covered: int) -> list[Rule]:
    """Sequential covering over (bin of each feature, for pruning?, junk, other) counts."""
    rules: list[Rule] = []
    options = [(f, above, i) for f, at in cuts.items() for i in range(1, len(at) + 1) for above in (True, False)]

    def meets(bins: dict[str, int], c: tuple[str, bool, int]) -> bool:
        return (bins[c[0]] >= c[2]) is c[1]

    def count(rows, conj) -> tuple[int, int]:
        p = n = 0
        for b, _, junk, other in rows:
            if all(meets(b, c) for c in conj):
                p, n = p + junk, n + other
        return p, n

    rest = cells
    while len(rules) < most_rules:
        grow, prune = [c for c in rest if not c[1]], [c for c in rest if c[1]]
        conj: list[tuple[str, bool, int]] = []
        inside = grow
        p, n = count(inside, [])
        while n and len(conj) < most_conditions:
            if p == 0:
                break
            sums: dict[tuple[str, bool, int], tuple[int, int]] = {}
            for f, at in cuts.items():
                by = [[0, 0] for _ in range(len(at) + 1)]
                for b, _, junk, other in inside:
                    by[b[f]][0] += junk
                    by[b[f]][1] += other
                low_p = low_n = 0
                for i in range(1, len(at) + 1):
                    low_p, low_n = low_p + by[i - 1][0], low_n + by[i - 1][1]
                    sums[f, False, i], sums[f, True, i] = (low_p, low_n), (p - low_p, n - low_n)
            now = math.log2(p / (p + n))
            gain, best = max(((q * (math.log2(q / (q + m)) - now) if (q := sums[c][0]) else -1.0, -options.index(c)) for c in options for m in [sums[c][1]]), default=(0, 0))
            if gain <= 1e-9:
                break
            conj.append(options[-best])
            inside = [c for c in inside if meets(c[0], conj[-1])]
            p, n = count(inside, [])
        while len(conj) > 1:  # drop final conditions as long as the rows held back do not object
            (p0, n0), (p1, n1) = count(prune, conj), count(prune, conj[:-1])
            if p1 and (p1 - n1) / (p1 + n1) >= ((p0 - n0) / (p0 + n0) if p0 + n0 else -1):
                conj.pop()
            else:
                break
        if not conj:
            break
        (pg, ng), (pp, np_) = count(grow, conj), count(prune, conj)
        precision = (pg + pp) / max(1, pg + pp + ng + np_)
        held = pp / (pp + np_) if pp + np_ else 0.0
        if pg + pp < least_covered or precision < least_precision or held < least_precision:
            break
        rules.append(Rule(tuple(Condition(f, above, cuts[f][i - 1]) for f, above, i in conj), pg + pp, precision))
        rest = [c for c in rest if not all(meets(c[0], x) for x in conj)]
    return rules


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, bins: int = 24, most_rules: int = 12, most_conditions: int = 3, least_precision: float = 0.97, least_covered: int = 5) -> list[Rule]:
    """Ordered rules for junk (label 0). Conflicting labels of one id count as junk only if all say so."""
    spark = df.sparkSession
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = marked.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__label")).orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    space = Workspace(spark, "quality")
    # the sample is written before it is measured, as a filter on the statistics would else be run on all documents
    rows = space.save(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "__id"))
    measured = space.save(rows.select("__id", "__label", statistics(F.col("text")).alias("s")))
    of = features(F.col("s"))
    names = list(of)
    sample = measured.where(~base_failed(F.col("s"))).select("__id", "__label", *(x.alias(f) for f, x in of.items()))
    at = [(2 * i + 1) / (2 * bins) for i in range(bins)]
    quantiles = sample.agg(*(F.percentile_approx(f, at, 10_000).alias(f) for f in names)).first()
    # between quantiles lie the thresholds; zero and the tails count as they stand
    cuts = {f: sorted({float(x) for x in (quantiles[f] or []) if x > 0} | {0.001, 0.01, 0.05}) if f != "word_length" else sorted({float(x) for x in (quantiles[f] or [])}) for f in names}
    cuts = {f: x for f, x in cuts.items() if x}
    binned = sample.select(
        *(sum((F.when(F.col(f) >= F.lit(c), 1).otherwise(0) for c in x), F.lit(0)).alias(f) for f, x in cuts.items()),
        (F.pmod(F.xxhash64("__id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        (F.col("__label") == 0).alias("junk"),
    )
    counts = binned.groupBy(*cuts, "prune").agg(F.sum(F.col("junk").cast("int")).alias("p"), F.sum((~F.col("junk")).cast("int")).alias("n"))
    cells = sorted((({f: r[f] for f in cuts}, r["prune"], r["p"], r["n"]) for r in counts.collect()), key=lambda c: (sorted(c[0].items()), c[1]))
    return _cover(cells, cuts, most_rules, most_conditions, least_precision, least_covered)


def verdict(rules: list[Rule], s: Column) -> Column:
    """Number of the first rule that holds, from 1; 0 if none does."""
    of, out = features(s), None
    for k, rule in enumerate(rules, 1):
        holds = rule.conditions[0].column(of)
        for c in rule.conditions[1:]:
            holds = holds & c.column(of)
        out = F.when(holds, F.lit(k)) if out is None else out.when(holds, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def judge(df: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "judged") -> DataFrame:
    """df and, in one column ``out`` (which must be new), the statistics, base_failed, rule (that of the list, 0 if none or
    base_failed) and kept."""
    if out in df.columns:
        raise ValueError(f"the table has a column {out}; name another")

    def whole(s: Column) -> Column:
        failed = base_failed(s)
        rule = F.when(failed, F.lit(0)).otherwise(verdict(rules, s))
        parts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
        return F.struct(*(s[p].alias(p) for p in parts), failed.alias("base_failed"), rule.alias("rule"), (~failed & (rule == 0)).alias("kept"))

    return df.withColumn(out, F.transform(F.array(statistics(F.col(text_col))), whole)[0])


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = judge(docs.select("doc_id", "text"), learn(docs, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return out.select("doc_id", *(F.col(f"judged.{n}").alias(n) for n in names))


QUERIES = {"op4_decision_list": op4_decision_list}
#: The learned verdict cannot be stated in SQL; the tests compare the base columns with plain Python, and the verdict with the rules
#: applied to these.
ORACLES: dict[str, str] = {}
