"""Lines that share a key and are unlike do not meet."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from millrace.llm import linededup
from millrace.llm.linededup import SQUARE_KEY, WHOLE_KEY, dedup_lines, fit_parts


def test_unlike_lines_of_a_key_do_not_meet(spark, monkeypatch):
    """Forty lines share their three longest words and no others; two of them are similar to one more each."""
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    same = [word(30) for _ in range(3)]
    lines = [[*same, *(word(6) for _ in range(6))] for _ in range(40)]
    lines += [[*x[:-1], word(6)] for x in lines[:2]]
    seen = []
    real = linededup.linked
    monkeypatch.setattr(linededup, "linked", lambda space, keys, *a: (seen.append(keys), real(space, keys, *a))[1])
    df = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(lines)], "doc_id long, text string")
    gone = {r["doc_id"] for r in dedup_lines(df).where("n_removed > 0").collect()}
    assert gone == {40, 41}
    groups = [r["count"] for r in seen[0].groupBy("col").count().collect()]
    assert groups and max(groups) <= 3  # a chance fit of 64 bits is allowed for


def test_long_unlike_lines_of_a_key_are_kept_apart():
    """Twenty lines of ninety words share a run of twenty words and no others: 64 bits connect them all, wide sketches none but near copies."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    same = [word(30) for _ in range(20)]
    lines = [[*same, *(word(6) for _ in range(70))] for _ in range(20)]
    lines += [[*x[:-9], *(word(6) for _ in range(9))] for x in lines[:2]]
    read = linededup.Lines(*linededup._read(pa.array([" ".join(x) for x in lines])), 5)
    wide, words, key = np.stack(read.sketch(np.arange(22)), axis=1), np.full(22, 90), np.zeros(22, np.int64)
    assert not fit_parts(words, np.bitwise_xor.reduce(wide, axis=1), 80).any()
    order, start, count = linededup._parts_of_keys(key, words, wide, 80)
    assert sorted(sorted(order[x : x + n].tolist()) for x, n in zip(start, count, strict=True)) == [[0, 20], [1, 21]]


def test_parts_of_a_key():
    rng = np.random.default_rng(5)
    for n in (1, 2, 40, SQUARE_KEY, SQUARE_KEY + 150):
        words = np.sort(rng.integers(8, 40, n))
        base = rng.integers(0, 1 << 63, max(1, n // 5), dtype=np.uint64)
        sketch = base[rng.integers(0, len(base), n)] ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        common = -(-80 * np.maximum(words[:, None], words) // 100)
        fits = (np.minimum(words[:, None], words) >= common) & (np.bitwise_count(sketch[:, None] ^ sketch) <= words[:, None] + words - 2 * common)
        want = np.arange(n)
        for k in range(n):
            for j in np.flatnonzero(fits[k]):
                want[want == max(want[k], want[j])] = min(want[k], want[j])
        assert fit_parts(words, sketch, 80).tolist() == want.tolist()
    assert not fit_parts(np.full(WHOLE_KEY + 1, 9), np.arange(WHOLE_KEY + 1, dtype=np.uint64), 80).any()
