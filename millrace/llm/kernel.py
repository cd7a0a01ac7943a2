"""Array kernels shared by the free-style operators.

They work on the two buffers of an Arrow string column (offsets and bytes), so a batch of texts
is tokenised and hashed without making one Python object per word. Hashes are 64 bits wide;
they choose candidates and routes, and where the result rests on them the docstring of the
operator says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: The separators of the word pattern ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Lower-cases A-Z and leaves every other byte alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64 bits."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def looked_up(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """table[data] for bytes and a table of 256 values of one byte; not to be written to."""
    return np.frombuffer(data.tobytes().translate(table.tobytes()), table.dtype)


#: Runs of units of any length are hashed by two polynomials over the field of this many elements, each with a base of its own: two different spans
#: of n units then agree with a probability of (n / PRIME) squared. (A polynomial modulo a power of two would not do: it
#: confuses the Thue-Morse sequence and its complement, whatever the base.)
PRIME = U64((1 << 31) - 1)
_BASES = (0x5A827999 | 1, 0x1B873593)
_powers: list[list[np.ndarray]] = [[np.ones(1, U64), np.ones(1, U64)] for _ in _BASES]


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME but for multiples of it: below 2^33 for 64 bits, and below 2^31 + 4 for what is below 2^33."""
    return (x & PRIME) + (x >> U64(31))


def _powers_of(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a lane's base, and those of its inverse."""
    held = _powers[lane]
    if len(held[0]) < n:
        size = 1 << max(18, int(n - 1).bit_length())
        prime = int(PRIME)
        for k, base in enumerate((_BASES[lane], pow(_BASES[lane], -1, prime))):
            p = np.ones(size, U64)
            have = 1
            while have < size:
                p[have : 2 * have] = p[:have] * U64(pow(base, have, prime)) % PRIME
                have *= 2
            held[k] = p
    return held[0][:n], held[1][:n]


def prefix_sums(lanes: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Of a sequence whose units are numbers below 2^31 in each lane: the sums that span_hash() takes."""
    out = []
    for k, x in enumerate(lanes):
        sums = np.zeros(len(x) + 1, U64)
        np.cumsum(_fold(x * _powers_of(k, len(x))[0]), out=sums[1:])
        out.append(sums)
    return out


def prefix_of_hashes(h: np.ndarray) -> list[np.ndarray]:
    """prefix_sums() of units that are 64-bit hashes."""
    return prefix_sums((h & PRIME, h >> U64(33)))


def span_hash(prefix: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end)."""
    out = np.zeros(len(starts), U64)
    for k, sums in enumerate(prefix):
        down = _powers_of(k, len(sums))[1]
        x = _fold(_fold(_fold(_fold(sums[ends] - sums[starts]) * down[starts])))
        x[x >= PRIME] -= PRIME
        out = (out << U64(31)) | x
    return mix(out + (np.asarray(ends) - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rebased to 0) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        empty = b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""
        column = column.fill_null(empty)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``most`` bytes: first row, last row + 1, bytes, rebased offsets."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of every row, and the row's first word:
    row r has the words first[r] to first[r + 1]."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = looked_up(data, SPACE)
    inside = ~gap[1:-1]
    before = gap[:-2].copy()
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = True
    after = gap[2:].copy()
    after[cuts - 1] = True
    starts = np.flatnonzero(inside & before)
    ends = np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number (little end first), zeros beyond the end; a view."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), "<u8", padded.data, strides=(1,))


#: Words of more bytes than this are hashed one by one.
_LONG = 64


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words() and a 64-bit hash of each: its length, mixed with eight bytes after eight."""
    starts, ends, first = words(data, offsets)
    size = ends - starts
    at = loads(data)
    h = mix(mix(size.astype(U64)) ^ (at[starts] << np.maximum(8 * (8 - size), 0).astype(U64)))
    left = np.flatnonzero(size <= _LONG)
    for k in range(8, _LONG, 8):
        left = left[size[left] > k]
        if not len(left):
            break
        x = at[starts[left] + k]
        spare = np.maximum(8 * (8 - (size[left] - k)), 0).astype(U64)
        h[left] = mix(h[left] ^ (x << spare))
    for i in np.flatnonzero(size > _LONG).tolist():
        h[i] = int.from_bytes(blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h, starts, ends, first


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place on that has as many."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, U64)
    at, out = loads(data), np.full(n, gram, U64)
    if gram < 8:
        return mix(out ^ (at[:n] << U64(8 * (8 - gram))))
    for k in [*range(0, gram - 8, 8), gram - 8]:
        out = mix(out ^ at[k : k + n])
    return out


_STEPS = mix(np.arange(1, 65, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes, whatever rows they are of."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _STEPS[0]
    for j in range(1, k):
        out += h[j : j + n] * _STEPS[j]
    return mix(out)


def starts_within(first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the items that begin a run of k items within their row."""
    n = int(first[-1]) if len(first) else 0
    if n < k:
        return np.zeros(0, np.int64)
    ok = np.ones(n, bool)
    # the last k - 1 items of each row begin no such run
    for j in range(1, k):
        p = first[1:] - j
        ok[p[(p >= 0) & (p >= first[:-1])]] = False
    return np.flatnonzero(ok)


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these lengths laid end to end: the item of each place, and the place within it."""
    lengths = np.asarray(lengths, np.int64)
    item = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.cumsum(lengths) - lengths
    return item, np.arange(len(item)) - begin[item]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    out, have = x, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out
