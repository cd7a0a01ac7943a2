"""Pictures as arrays: fitted to the longest edge by area, flattened on white, and written as PNG, JPEG or SVG.

JPEG is the baseline process without subsampling: blocks of 8 x 8 are transformed all at once by two matrix products, runs and
sizes are found for all blocks by array operations, and both Huffman tables are made for the picture from how often each symbol comes.
"""

from __future__ import annotations

import base64
import heapq
import struct
import zlib
from xml.sax.saxutils import escape

import numpy as np

from ..functions.vocab import DEFAULT_QUALITY, MAX_EDGE
from .media import png_parts, png_rows
from .model import CodecError


def fitted(pixels: np.ndarray, most: int = MAX_EDGE) -> np.ndarray:
    """Pixels with no edge over ``most``; each new pixel is the mean of the area that it covers."""
    for axis in (0, 1):
        n = pixels.shape[axis]
        scale = most / max(pixels.shape[0], pixels.shape[1]) if axis == 0 else scale  # noqa: F821 - both axes by the one scale
        if scale >= 1:
            return pixels
        made = max(1, int(n * scale + 0.5))
        sums = np.concatenate([np.zeros_like(pixels.take([0], axis), dtype=np.float64), np.cumsum(pixels, axis, dtype=np.float64)], axis)
        edges = np.arange(made + 1) * (n / made)
        low = np.minimum(edges.astype(np.int64), n - 1)
        part = (edges - low).reshape([-1 if k == axis else 1 for k in range(pixels.ndim)])
        at = sums.take(low, axis) * (1 - part) + sums.take(low + 1, axis) * part
        pixels = np.clip(np.diff(at, axis=axis) * (made / n) + 0.5, 0, 255).astype(np.uint8)
    return pixels


def flattened(pixels: np.ndarray) -> np.ndarray:
    """Red, green and blue on white."""
    alpha = pixels[..., 3:].astype(np.uint16)
    return ((pixels[..., :3] * alpha + 255 * (255 - alpha) + 127) // 255).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """A PNG of red, green, blue and alpha; alpha is left out if there is none. Each row has the filter of the least sum of differences."""
    if (pixels[..., 3] == 255).all():
        pixels = pixels[..., :3]
    height, width, n = pixels.shape
    rows = pixels.reshape(height, width * n)
    left = np.zeros_like(rows)
    left[:, n:] = rows[:, :-n] if width > 1 else left[:, n:]
    above = np.zeros_like(rows)
    above[1:] = rows[:-1]
    ways = np.stack([rows, rows - left, rows - above])
    cost = np.minimum(ways, 256 - ways.astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    raw = np.concatenate([best.astype(np.uint8)[:, None], ways[best, np.arange(height)]], axis=1)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if n == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")


def _zigzag() -> np.ndarray:
    """Places of a block by diagonals, each in the other direction."""
    return np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))


_ORDER = _zigzag()
_K = np.arange(8)
_COSINES = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _steps(quality: int, coarse: int) -> np.ndarray:
    """Sizes of the steps of the 64 frequencies: higher frequencies and colours are coarser."""
    q = max(1, min(100, quality))
    scale = (5000 / q if q < 50 else 200 - 2 * q) / 100
    base = 10 + coarse * (_K[:, None] + _K[None, :])
    return np.clip(np.floor(base * scale + 0.5), 1, 255).astype(np.int64)


def _lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of Huffman codes, 16 at most, with one code left over so that none is all ones."""
    counts = counts.copy()
    while True:
        heap = [(int(c), k, [k]) for k, c in enumerate(counts) if c] + [(0, 256, [256])]
        heapq.heapify(heap)
        size = dict.fromkeys((k for _, _, members in heap for k in members), 0)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for k in a[2] + b[2]:
                size[k] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if max(size.values()) <= 16:
            break
        counts = np.where(counts > 0, counts // 2 + 1, 0)  # flatter counts give shorter codes
    longest = max(size.values())
    spare = max((k for k in size if size[k] == longest), key=lambda k: k == 256)
    if spare != 256:  # the code left over is one of the longest
        size[spare], size[256] = size[256], longest
    del size[256]
    return {k: max(1, n) for k, n in size.items()}


def _table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The part of a DHT segment, and code and length by symbol."""
    size = _lengths(counts)
    order = sorted(size, key=lambda k: (size[k], k))
    codes, lengths = np.zeros(256, np.int64), np.zeros(256, np.int64)
    code, last = 0, 0
    for k in order:
        code <<= size[k] - last
        codes[k], lengths[k], last = code, size[k], size[k]
        code += 1
    return bytes(sum(1 for k in order if size[k] == n) for n in range(1, 17)) + bytes(order), codes, lengths


def _bits(values: np.ndarray) -> np.ndarray:
    """How many bits a value's size takes."""
    return np.where(values == 0, 0, np.floor(np.log2(np.maximum(np.abs(values), 1))).astype(np.int64) + 1)


def _symbols(blocks: np.ndarray, first: np.ndarray, component: int, n: int) -> tuple[np.ndarray, ...]:
    """Place in the scan, table (0 or 1), symbol, and extra bits with their number, of all blocks (in the order of the scan) of a component."""
    count = len(blocks)
    base = (np.arange(count) * n + component) * 400
    size = _bits(first)
    parts = [(base, np.zeros(count, np.int64), size, first, size)]
    row, col = np.nonzero(blocks[:, 1:])
    col = col + 1
    before = np.where(np.concatenate([[True], row[1:] != row[:-1]]), 0, np.concatenate([[0], col[:-1]]))
    run = col - before - 1
    value = blocks[row, col]
    size = _bits(value)
    one = np.ones_like(row)
    parts.append((base[row] + col * 6 + 5, one, (run % 16) * 16 + size, value, size))
    for k in range(3):  # runs of sixteen zeros and more
        long = run >= 16 * (k + 1)
        parts.append((base[row[long]] + col[long] * 6 + k, one[long], np.full(long.sum(), 0xF0), 0 * row[long], 0 * row[long]))
    last = np.zeros(count, np.int64)
    np.maximum.at(last, row, col)
    short = np.flatnonzero(last < 63)
    parts.append((base[short] + 399, np.ones(len(short), np.int64), 0 * short, 0 * short, 0 * short))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def jpeg(pixels: np.ndarray, quality: int = DEFAULT_QUALITY) -> bytes:
    """A baseline JPEG of red, green and blue (height, width, 3)."""
    height, width, _ = pixels.shape
    r, g, b = (pixels[..., k].astype(np.float64) for k in range(3))
    # Weights of the colours in brightness.
    y = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [y - 128, (b - y) / 1.772, (r - y) / 1.402]
    found = []
    for component, plane in enumerate(planes):
        full = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge")
        cut = full.reshape(full.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        steps = _steps(quality, 4 if component == 0 else 8)
        levels = np.rint(_COSINES @ cut @ _COSINES.T / steps).astype(np.int64).reshape(-1, 64)[:, _ORDER]
        found.append(_symbols(levels, np.diff(levels[:, 0], prepend=0), component, 3))
    place, table, symbol, extra, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(place, kind="stable")
    table, symbol, extra, size = table[order], symbol[order], extra[order], size[order]
    heads, codes, lengths = zip(*(_table(np.bincount(symbol[table == k], minlength=256)) for k in (0, 1)), strict=True)
    code, length = np.stack(codes)[table, symbol], np.stack(lengths)[table, symbol]
    whole = (code << size) | np.where(extra < 0, extra + (1 << size) - 1, extra)
    total = length + size
    ends = np.cumsum(total)
    bits = np.ones(int(ends[-1]) + (-int(ends[-1]) % 8), np.uint8)
    for k in range(int(total.max())):  # a bit of every symbol at a time
        has = total > k
        bits[ends[has] - 1 - k] = (whole[has] >> k) & 1
    scan = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")

    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    quantised = b"".join(bytes([k]) + bytes(_steps(quality, c).reshape(-1)[_ORDER].tolist()) for k, c in enumerate((4, 8)))
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])
    trees = b"".join(bytes([kind]) + head for kind, head in zip((0x00, 0x10), heads, strict=True))
    start = bytes([3, 1, 0x00, 2, 0x00, 3, 0x00, 0, 63, 0])
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xDB, quantised) + segment(0xC0, frame) + segment(0xC4, trees) + segment(0xDA, start) + scan + b"\xff\xd9"


def probe(content: bytes) -> list[dict]:
    """A row of kind "image" of a picture whose size can be told."""
    found = png_parts(content)
    if found:
        width, height, mime = found[0], found[1], "image/png"
    elif content[:2] == b"\xff\xd8":
        from .pdf import jpeg_frame

        frame = jpeg_frame(content)
        if frame is None:
            raise CodecError("decode-failed")
        (height, width, _), mime = frame, "image/jpeg"
    else:
        raise CodecError("decode-failed")
    return [{"kind": "image", "data": content, "mime": mime, "x": float(width), "y": float(height)}]


def encoded(data: bytes, mime: str, width: int, height: int, name: str, target: str, quality: int = DEFAULT_QUALITY) -> bytes:
    """A picture as a file of a target."""
    if target == "SVG":
        shown = base64.b64encode(data).decode()
        return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><title>{escape(name)}</title><image width="{width}" height="{height}" href="data:{mime};base64,{shown}"/></svg>'.encode()
    pixels = png_rows(data)
    if pixels is None:
        raise CodecError("decode-failed")
    pixels = fitted(pixels)
    return png(pixels) if target == "PNG" else jpeg(flattened(pixels), quality)
