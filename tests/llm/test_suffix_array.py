"""The engine of op6 on small alphabets, zero bytes and long runs, against plain sorting and plain windows."""

import numpy as np
import pytest

from millrace.llm import suffixdedup

DEPTH = 56


def random_segments(seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    size = rng.integers(1, 130, rng.integers(1, 30))
    data = rng.integers(0, rng.integers(2, 5), size.sum()).astype(np.uint8) * np.uint8(rng.integers(1, 60))
    at = int(rng.integers(0, len(data)))
    data[at : at + 90] = rng.integers(0, 256)  # a run longer than a window
    data[rng.random(len(data)) < 0.02] = 0
    return data, size


@pytest.mark.parametrize("seed", range(60))
def test_classes_are_equal_windows(seed):
    data, size = random_segments(seed)
    size = np.append(size, size)  # every segment twice
    data = np.append(data, data)
    got = suffixdedup._engine(50)(data, size)
    windows = [data[e - s + k : e - s + k + 50].tobytes() for s, e in zip(size, np.cumsum(size), strict=True) for k in range(s - 49)]
    assert len(got) == len(windows)
    pairs = set(zip(windows, got.tolist(), strict=True))
    assert len(pairs) == len(set(windows)) == len(set(got.tolist()))


@pytest.mark.parametrize("seed", range(60))
def test_order_of_wanted_suffixes(seed):
    data, _ = random_segments(seed)
    wanted = np.random.default_rng(seed + 1000).random(len(data)) < 0.3
    words = np.append(suffixdedup._words(data), np.zeros(DEPTH, np.uint64))
    order = suffixdedup.suffix_array(data, words, DEPTH, wanted)
    assert len(set(order.tolist())) == len(order)
    got = [k for k in order.tolist() if wanted[k] and k + DEPTH <= len(data)]
    raw = data.tobytes()
    assert sorted(got) == [k for k in np.flatnonzero(wanted).tolist() if k + DEPTH <= len(data)]
    assert all(raw[a : a + DEPTH] <= raw[b : b + DEPTH] for a, b in zip(got[:-1], got[1:], strict=True))
