"""Spelling variant grouping: tries in shards, met by each word's distance-one Levenshtein automaton.

Words are counted by Spark expressions with partial sums. The vocabulary is sorted by range, and each task packs its words, in order,
into tries of at most ``shard_words`` words: the nodes level by level in three flat arrays (labels, first child, count), so that the children of a node are neighbours
and a child is found by bisection. Shards are broadcast in batches of at most ``batch_bytes``, one batch after the other, so that what is broadcast
has a bound whatever the vocabulary; a pass over the vocabulary meets every shard of a batch.

A word's automaton walks a trie depth first: as long as no edit is spent it follows the word, and at each of those nodes spends the one edit (leave out the next
code point, put another in its place, or take one more before it); from there only the rest of the word is followed. Each neighbour is reached by one
path only: a code point is left out at the first of equal ones, and taken in after equal ones. A word keeps only the number of
its neighbours and the best of them, so no pairs are written; what batches found is merged by word.

Roots: a form has ``ratio`` times as many occurrences, so chains are short (the logarithm of the largest count); pointers are doubled by joins as often as that bound asks.

Defined cases: a null text has no words; a null id counts as an empty one in the check-sum; ties between neighbours of like count go to the first in code-point order; rows that
repeat are counted as often as they stand; very long texts are read whole; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
SHARD_WORDS, BATCH_BYTES = 1 << 15, 32 << 20
#: Words that a task meets with a batch of shards, and most tasks.
TASK_WORDS, MOST_TASKS = 10_000, 20_000
_RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The check-sums that this divides lose a code point.
_SLIP = 199


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the runs of letters of all texts, some of them with a code point left out as the check-sum says."""
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(F.col(text_col), _UPPER, _LOWER), F.lit(_RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length)
    h = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    words = h.select(F.when(F.col("h") % _SLIP == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


class Trie:
    """A compact trie: node 0 is the root, and the children of a node are ``first[node]`` to ``first[node + 1]``, by label."""

    def __init__(self, labels: array, first: array, counts: array):
        self.labels, self.first, self.counts = labels, first, counts

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        """Of distinct words in code-point order."""
        labels, first, ends, level, at = array("I", [0]), array("I"), array("Q"), [(0, len(words))], 0
        while level:
            below, made = [], len(labels)
            for lo, hi in level:
                first.append(made)
                whole = lo < hi and len(words[lo]) == at
                ends.append(counts[lo] if whole else 0)
                for label, same in groupby(range(lo + whole, hi), key=lambda k: words[k][at]):
                    same = list(same)
                    labels.append(ord(label))
                    below.append((same[0], same[-1] + 1))
                    made += 1
            level, at = below, at + 1
        first.append(len(labels))
        return cls(labels, first, ends)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.labels.tobytes(), self.first.tobytes(), self.counts.tobytes()

    @classmethod
    def unpacked(cls, labels: bytes, first: bytes, counts: bytes) -> Trie:
        found = array("I"), array("I"), array("Q")
        for a, b in zip(found, (labels, first, counts), strict=True):
            a.frombytes(b)
        return cls(*found)

    def child(self, node: int, label: int) -> int:
        """The child, or 0."""
        end = self.first[node + 1]
        at = bisect_left(self.labels, label, self.first[node], end)
        return at if at < end and self.labels[at] == label else 0

    def rest(self, node: int, codes: list[int], at: int) -> int:
        """The count of the word that goes on with the codes from a place; 0 if there is none."""
        for k in range(at, len(codes)):
            node = self.child(node, codes[k])
            if not node:
                return 0
        return self.counts[node]

    def neighbours(self, word: str) -> Iterator[tuple[int, str]]:
        """(count, word) of the words at distance one."""
        codes, node = [ord(c) for c in word], 0
        n = len(codes)
        for i in range(n + 1):
            ahead = codes[i] if i < n else -1
            if i < n and (i == 0 or codes[i - 1] != ahead) and (c := self.rest(node, codes, i + 1)):
                yield c, word[:i] + word[i + 1 :]
            for k in range(self.first[node], self.first[node + 1]):
                label = self.labels[k]
                if label == ahead:
                    continue
                if i < n and (c := self.rest(k, codes, i + 1)):
                    yield c, word[:i] + chr(label) + word[i + 1 :]
                if c := self.rest(k, codes, i):
                    yield c, word[:i] + chr(label) + word[i:]
            if i == n or not (node := self.child(node, ahead)):
                return


def shards(vocabulary: DataFrame, shard_words: int) -> DataFrame:
    """Rows of a trie each; vocabulary is in order within its partitions."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: list[str] = []
        counts: list[int] = []

        def made() -> pd.DataFrame:
            packed = Trie.of(words, counts).packed()
            return pd.DataFrame([(words[0], sum(map(len, packed)), *packed)], columns=["start", "bytes", "labels", "first", "counts"])

        for b in batches:
            for w, n in zip(b["word"], b["n"], strict=True):
                words.append(w)
                counts.append(n)
                if len(words) == shard_words:
                    yield made()
                    words, counts = [], []
        if words:
            yield made()

    return vocabulary.mapInPandas(build, "start string, bytes long, labels binary, first binary, counts binary")


def near_words(vocabulary: DataFrame, space: Workspace, shard_words: int = SHARD_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """word, n, n_near and best (struct of the negative count and the word; null without neighbours)."""
    spark = vocabulary.sparkSession
    tries = space.save(shards(vocabulary.repartitionByRange("word").sortWithinPartitions("word"), shard_words))
    sizes = sorted((r["start"], r["bytes"]) for r in tries.select("start", "bytes").collect())  # a row a shard
    groups: list[list] = []
    for start, size in sizes:
        if not groups or groups[-1][2] + size > batch_bytes:
            groups.append([start, start, 0])
        groups[-1][1], groups[-1][2] = start, groups[-1][2] + size
    # walking tries costs far more than the few bytes of a word tell
    words, parts = vocabulary.repartition(max(1, min(MOST_TASKS, -(-vocabulary.count() // TASK_WORDS))), "word"), []
    for k, (low, high, _) in enumerate(groups):
        batch = spark.sparkContext.broadcast([tuple(map(bytes, r)) for r in tries.where(F.col("start").between(low, high)).select("labels", "first", "counts").collect()])
        parts.append(space.save(words.mapInArrow(_meet(batch, k == 0), "word string, n long, n_near long, best struct<less: long, word: string>")))
        batch.destroy()
    found = parts[0] if parts else vocabulary.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.struct((-F.col("n")).alias("less"), "word").alias("best")).limit(0)
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _meet(batch, all_words: bool):
    """Over words: what the shards of a batch have near them; words without any only where all are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = [Trie.unpacked(*packed) for packed in batch.value]
        for b in batches:
            rows = []
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                count, best = 0, None
                for t in tries:
                    for c, other in t.neighbours(word):
                        count += 1
                        if best is None or (-c, other) < best:
                            best = (-c, other)
                if count or all_words:
                    rows.append((word, n, count, best and {"less": best[0], "word": best[1]}))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = pa.string(), pa.int64(), pa.int64(), pa.struct([("less", pa.int64()), ("word", pa.string())])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["word", "n", "n_near", "best"])

    return run


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO, shard_words: int = SHARD_WORDS, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """A row a word: word, form, root, n, n_near, form_n."""
    space = Workspace(df.sparkSession, "spelling")
    vocabulary = space.save(word_counts(df, id_col, text_col))
    near = near_words(vocabulary, space, shard_words, batch_bytes)
    fits = -F.col("best")["less"] >= ratio * F.col("n")
    rows = space.save(near.select("word", F.when(fits, F.col("best")["word"]).alias("form"), "n", "n_near", F.when(fits, -F.col("best")["less"]).alias("form_n")))
    most, least = rows.agg(F.max("n"), F.min("n")).first()
    steps = 0  # a chain has no more forms
    while most and least * ratio ** (steps + 1) <= most:
        steps += 1
    root = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, steps - 1).bit_length()):
        on: Column = F.col("root") == F.col("via")
        root = space.save(root.join(root.select(F.col("word").alias("via"), F.col("root").alias("on")), on, "left").select("word", F.coalesce("on", "root").alias("root")))
    out = rows.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_trie_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op13_trie_variants": op13_trie_variants}
#: The check-sum goes bit by bit; a byte is followed by seven zeros.
ORACLES = {
    "op13_trie_variants": rf"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS times FROM r WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
b AS (SELECT run, times, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192::BIGINT | (unicode(x) >> 6), 128::BIGINT | (unicode(x) & 63)] END)) AS bytes FROM g),
h AS (SELECT run, times, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(bytes, lambda x: [x, 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, e: xor(xor(c, e) >> 1, 3988292384::BIGINT * (xor(c, e) & 1)))) AS h FROM b),
w AS (SELECT CASE WHEN h % {_SLIP} = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM h),
v AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
d AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, b.word AS other FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
k AS (SELECT p.word, p.other, o.n, row_number() OVER (PARTITION BY p.word ORDER BY o.n DESC, p.other) AS rank, count(*) OVER (PARTITION BY p.word) AS n_near FROM p JOIN v o ON o.word = p.other),
f AS MATERIALIZED (SELECT v.word, CASE WHEN k.n >= {RATIO} * v.n THEN k.other END AS form, v.n, coalesce(k.n_near, 0) AS n_near, CASE WHEN k.n >= {RATIO} * v.n THEN k.n END AS form_n FROM v LEFT JOIN k ON k.word = v.word AND k.rank = 1),
c AS (SELECT word, word AS root FROM f UNION SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f last ON last.word = c.root AND last.form IS NULL
"""
}
