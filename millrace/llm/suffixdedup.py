"""Substring dedup with suffix arrays built by two-stage sorting.

Every byte covered by a string of ``window`` bytes that also starts in a document of a smaller id
goes. The frame in ``repeats`` finds and routes the segments that can hold such strings; here the
segments of a bucket are laid end to end and their suffix array is built in two stages: suffixes
smaller than their successor (type B) are sorted directly, the others (type A) are induced by scanning
the buckets of first bytes in order. Adjacent common prefixes then tell which windows are equal. Suffixes at which
no window starts, and that induce none at which one does, stay out of the array.

Only prefixes of ``window`` bytes matter, so the direct sort looks at the first 56 bytes or more
and leaves later ties as they come; an induced suffix is then in order to at least that depth.

Defined cases: null text is empty and has no bytes; texts shorter than the window lose nothing; rows
of one id never remove from each other, and a null id comes last; very long texts are cut whole, as are rows of them in a chunk of their own; of places that
tie in id none is removed for the other; cuts may fall within a character, so what is kept is
binary; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import ragged
from .repeats import Units, remove_repeats

WINDOW = 50


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number, in byte order; zeros beyond the end."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data), ">u8", padded, strides=(1,)).astype(np.uint64)


def _smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Type B: the suffix is smaller than its successor. The last suffix is not: its successor is empty."""
    change = np.flatnonzero(data[1:] != data[:-1])
    # the end of a run of equal bytes decides for all of it
    known = np.repeat(data[change] < data[change + 1], np.diff(change, prepend=-1))
    return np.append(known, np.zeros(len(data) - len(known), bool))


def _inducing(wanted: np.ndarray, is_b: np.ndarray) -> np.ndarray:
    """The wanted suffixes, and those that induce them: of a type A suffix its successors up to the next of type B."""
    n = len(wanted)
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    direct = np.flatnonzero(is_b)
    until = np.append(direct, n - 1)[np.searchsorted(direct, last)]
    depth = np.bincount(last, minlength=n + 1) - np.bincount(until + 1, minlength=n + 1)
    return wanted | (np.cumsum(depth)[:n] > 0)


def _sort_direct(at: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes by their first ``depth`` bytes, eight at a time; only ties go on. ``words`` go ``depth`` beyond the last suffix."""
    k = words[at]
    order = np.argsort(k)
    at, k = at[order], k[order]
    same = k[1:] == k[:-1]
    tie = np.append(False, same) | np.append(same, False)
    group = np.cumsum(np.append(True, ~same)).astype(np.uint64)
    for d in range(8, depth, 8):
        which = np.flatnonzero(tie)
        if not len(which):
            break
        sub = at[which]
        k = words[sub + d]
        order = np.argsort(k)
        k = k[order]
        rank = np.empty(len(k), np.uint64)
        rank[order] = np.cumsum(np.append(True, k[1:] != k[:-1]))
        key = (group[which] << np.uint64(32)) | rank
        order = np.argsort(key)
        at[which], key = sub[order], key[order]
        same = key[1:] == key[:-1]
        tie[which] = np.append(False, same) | np.append(same, False)
        group[which] = np.cumsum(np.append(True, ~same))
    return at


def suffix_array(data: np.ndarray, words: np.ndarray, depth: int, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes, and those that induce them, in the order of their first ``depth`` bytes at least, by two-stage sorting.
    ``words`` are those of the data and ``depth`` zeros. Suffixes that no wanted one needs are not sorted."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    is_b = _smaller_than_next(data)
    needed = _inducing(wanted, is_b)
    direct = _sort_direct(np.flatnonzero(is_b & needed), words, depth)
    induces = np.append(False, needed[:-1] & ~is_b[:-1])  # the suffix before it is needed and of type A
    ends = np.searchsorted(data[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def scan(bucket: np.ndarray, own: int) -> np.ndarray:
        """Deal the type A predecessors of these suffixes to the buckets of their first bytes; those of the bucket itself are returned."""
        before = bucket[induces[bucket]] - 1
        first = data[before]
        mine = before[first == own]
        rest, first = before[first != own], first[first != own]
        order = np.argsort(first, kind="stable")
        rest, first = rest[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        if len(rest):
            at = [0, *cut.tolist(), len(rest)]
            for c, x, y in zip(first[at[:-1]].tolist(), at[:-1], at[1:], strict=True):
                induced[c].append(rest[x:y])
        return mine

    # the empty suffix comes before all and induces the last one
    induced[int(data[-1])].append(np.array([n - 1]))
    for c in range(256):
        level = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        while len(level):  # one more byte of a run of c with each round
            out.append(level)
            level = scan(level, c)
        part = direct[ends[c] : ends[c + 1]]
        if len(part):
            out.append(part)
            scan(part, -1)
    return np.concatenate(out)


def common_prefix(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int, words: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes a and b, up to ``most``; both have ``most`` bytes."""
    length = np.zeros(len(a), np.int64)
    going = np.arange(len(a))
    for d in range(0, most, 8):
        x = words[a[going] + d] ^ words[b[going] + d]
        hit = x != 0
        # the leading zero bytes of the difference
        lead = np.zeros(int(hit.sum()), np.int64)
        y = x[hit]
        for k in range(1, 8):
            lead += y < (np.uint64(1) << np.uint64(64 - 8 * k))
        length[going[hit]] += lead
        length[going[~hit]] += 8
        going = going[~hit]
        if not len(going):
            break
    return np.minimum(length, most)


def _windows(window: int):
    def count(data: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.maximum(size - window + 1, 0)

    return count


def _engine(window: int):
    depth = max(56, -(-window // 8) * 8)

    def classes(data: np.ndarray, size: np.ndarray) -> np.ndarray:
        content, place = ragged(size)
        valid = place <= size[content] - window
        number = np.cumsum(valid) - 1
        words = np.append(_words(data), np.zeros(depth, np.uint64))
        order = suffix_array(data, words, depth, valid)
        order = order[valid[order]]
        prefix = common_prefix(data, order[1:], order[:-1], window, words)
        out = np.empty(len(order), np.int64)
        out[number[order]] = np.cumsum(np.append(0, prefix < window))
        return out

    return classes


def remove_repeated_bytes(df: DataFrame, window: int = WINDOW, gram: int | None = None, **options) -> DataFrame:
    """doc_id, n_units (bytes), n_removed, spans and kept (binary) of every row; see repeats.remove_repeats."""
    u = Units(words=False, window=window, gram=gram or max(1, window * 24 // 50), within=False)
    return remove_repeats(df, u, _engine(window), _windows(window), **options)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
#: No SQL that could run on whole tables; the tests use brute force.
ORACLES: dict[str, str] = {}
