"""Substring dedup with suffix automata of reference shards.

Every word goes that is covered by a window of ``window`` words whose sequence also starts earlier (in
a smaller id, or earlier in the same document). The reference is what the frame in ``repeats`` routes:
the distinct segments around repeated anchors, in shards by anchor. For each shard a generalised suffix
automaton is built over word numbers; then the segments are streamed through it for matching
statistics, and where at least ``window`` words match, the state that holds the last ``window`` words
names the window's class. Of a class all windows but the earliest are removed, and maximal spans follow.

A shard's automaton lives in the task that the documents' segments are sent to, instead of being broadcast
to all: the reference grows with the corpus, so no bound of a broadcast could be proven, while a
segment can only match in the shard of its anchor.

Defined cases: null text has no words; texts with fewer words than the window lose nothing; rows of one
id count as one document in the order of their texts, and a null id as a last one; places that tie in id are told apart by their start; very long texts
are read whole; kept words are joined by one space; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import words
from .repeats import Units, numbered, remove_repeats

WINDOW = 20


class SuffixAutomaton:
    """Of several sequences of numbers; states are places in three lists."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list[int]) -> None:
        """Extend by a sequence of its own, from the root."""
        step, link, length = self.step, self.link, self.length
        last = 0
        for c in sequence:
            there = step[last].get(c)
            if there is not None:
                # the sequences before hold this extension already
                if length[there] == length[last] + 1:
                    last = there
                    continue
                last = self._split(last, c, there)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
            last = new

    def _split(self, p: int, c: int, q: int) -> int:
        """Part the state q, reached from p by c, at the length that p gives it."""
        step, link = self.step, self.link
        copy = len(step)
        step.append(step[q].copy())
        self.length.append(self.length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def stream(self, sequence: list[int], least: int) -> list[int]:
        """State of the last ``least`` numbers after each number from which on so many match in a row;
        -1 where fewer do."""
        step, link, length = self.step, self.link, self.length
        state = have = 0
        out = []
        for c in sequence:
            while state and c not in step[state]:
                state = link[state]
                have = length[state]
            if c in step[state]:
                state = step[state][c]
                have += 1
            else:
                have = 0
            if have >= least:
                while length[link[state]] >= least:
                    state = link[state]
                    have = length[state]
                out.append(state)
            else:
                out.append(-1)
        return out


def _windows(window: int):
    def count(data: np.ndarray, size: np.ndarray) -> np.ndarray:
        first = words(data, np.append(0, np.cumsum(size)))[2]
        return np.maximum(np.diff(first) - window + 1, 0)

    return count


def _engine(window: int):
    def classes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
        starts, ends, first = words(data, np.append(0, np.cumsum(size)))
        numbers = numbered(data.tobytes(), starts, ends).tolist()
        at = first.tolist()
        automaton = SuffixAutomaton()
        sequences = [numbers[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for s in sequences:
            automaton.add(s)
        out: list[int] = []
        for s in sequences:
            out += automaton.stream(s, window)[window - 1 :]
        return np.unique(np.array(out, np.int64), return_inverse=True)[1].astype(np.int64)

    return classes


def remove_repeated_words(df: DataFrame, window: int = WINDOW, gram: int | None = None, **options) -> DataFrame:
    """doc_id, n_words, n_removed, spans and kept (the words that stay, joined by one space) of every row."""
    u = Units(words=True, window=window, gram=gram or max(1, window * 2 // 5), within=True)
    out = remove_repeats(df, u, _engine(window), _windows(window), **options)
    return out.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", "spans", F.col("kept").cast("string").alias("kept"))


def op8_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_automata": op8_suffix_automata}
#: No SQL that could run on whole tables; the tests use brute force.
ORACLES: dict[str, str] = {}
