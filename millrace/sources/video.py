"""Video heads: width, height and seconds by a walk over boxes (MP4, MOV), elements (WEBM, MKV) or chunks (AVI).

A walk reads the heads of what it passes and skips the rest by its length, wherever the index lies; media data is never touched.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

from .model import CodecError


class Video(NamedTuple):
    width: int
    height: int
    seconds: float | None


#: Boxes that hold boxes.
_NESTED = {b"moov", b"trak", b"mdia"}
_DEEPEST = 12


def _boxes(data: memoryview, at: int, end: int, depth: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """Kind, begin and end of the boxes between two places, each before those within it."""
    while at + 8 <= end and depth < _DEEPEST:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", data, at + 8)
            head = 16
        stop = end if size == 0 else at + size
        if size and size < head or stop > end:
            stop = end if kind == b"mdat" else at
        if stop <= at:
            return
        yield kind, at + head, stop
        if kind in _NESTED:
            yield from _boxes(data, at + head, stop, depth + 1)
        at = stop


def _mp4(data: memoryview) -> Video | None:
    size, seconds, shown = None, None, None
    for kind, at, end in _boxes(data, 0, len(data)):
        if kind == b"trak":
            shown = None
        elif kind == b"mvhd" and end - at >= 20:
            wide = data[at] == 1
            if end - at >= (32 if wide else 20):
                scale, length = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
                seconds = length / scale if scale else None
        elif kind == b"tkhd" and end - at >= 84:
            w, h = struct.unpack_from(">II", data, end - 8)  # 16 bits each side of the point
            shown = (w >> 16, h >> 16)
        elif kind == b"hdlr" and end - at >= 12 and bytes(data[at + 8 : at + 12]) == b"vide" and shown and all(shown) and size is None:
            size = shown
    return Video(*size, seconds) if size else None


def _number(data: memoryview, at: int, end: int, marked: bool) -> tuple[int, int]:
    """A number whose first byte tells its length, and the place after it; -1 if all its bits are set (a length that is not known)."""
    if at >= end or not data[at]:
        raise ValueError("no number")
    n = 9 - int(data[at]).bit_length()
    if at + n > end:
        raise ValueError("cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if marked:
        return value, at + n
    full = (1 << 7 * n) - 1
    return (-1 if value & full == full else value & full), at + n


# Ids of elements; those that hold others are walked into.
_SEGMENT, _CLUSTER, _INFO, _SCALE, _LENGTH, _TRACKS, _TRACK, _VIDEO, _WIDTH, _HEIGHT = 0x18538067, 0x1F43B675, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE, 0xE0, 0xB0, 0xBA
_HOLDING = {_SEGMENT, _INFO, _TRACKS, _TRACK, _VIDEO}


def _elements(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, begin and end of elements, those within others right after them; a cluster of unknown length ends the walk."""
    while at < end:
        try:
            name, at = _number(data, at, end, True)
            size, at = _number(data, at, end, False)
        except ValueError:
            return
        stop = end if size < 0 else at + size
        if size < 0 and name not in _HOLDING:
            return
        yield name, at, min(stop, end)
        if name not in _HOLDING:
            at = stop


def _webm(data: memoryview) -> Video | None:
    found: dict[int, int] = {}
    scale, length = 1_000_000, None
    for name, at, end in _elements(data, 0, len(data)):
        part = data[at:end]
        if name == _SCALE:
            scale = int.from_bytes(part, "big")
        elif name == _LENGTH and len(part) in (4, 8):
            (length,) = struct.unpack(">f" if len(part) == 4 else ">d", part)
        elif name in (_WIDTH, _HEIGHT) and len(part) <= 8:
            found.setdefault(name, int.from_bytes(part, "big"))
    if not found.get(_WIDTH) or not found.get(_HEIGHT):
        return None
    return Video(found[_WIDTH], found[_HEIGHT], None if length is None else length * scale / 1e9)


def _avi(data: memoryview) -> Video | None:
    at = bytes(data[: 1 << 16]).find(b"avih")
    if at < 0 or at + 48 > len(data):
        return None
    each, _, _, _, frames = struct.unpack_from("<5I", data, at + 8)
    width, height = struct.unpack_from("<II", data, at + 40)
    return Video(width, height, frames * each / 1e6) if width and height else None


def head(content: bytes) -> Video:
    """What the head of a video tells."""
    data = memoryview(content)
    found = None
    if content[:4] == b"\x1aE\xdf\xa3":
        found = _webm(data)
    elif content[:4] == b"RIFF" and content[8:12] == b"AVI ":
        found = _avi(data)
    elif len(content) >= 8:
        found = _mp4(data)
    if found is None:
        raise CodecError("video-unsupported")
    return found


def probe(content: bytes) -> list[dict]:
    """A row of kind "video": width and height, and the seconds in ``body``; the bytes are not passed on."""
    v = head(content)
    return [{"kind": "video", "x": float(v.width), "y": float(v.height), "body": None if v.seconds is None else repr(v.seconds)}]
