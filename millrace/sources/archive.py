"""ZIP archives: a reader that tells what is wrong, and a writer with fixed fields.

The standard library writes and inflates the members; the central directory is read here so that each fault
gives its own code, and members with other methods than stored and deflated are refused.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable
from functools import lru_cache

from .model import CodecError

_END, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x01\x02", b"PK\x03\x04"


#: Most bytes that the members of one archive may take when inflated.
MOST_INFLATED = 1 << 30


def _inflated(body: bytes, most: int) -> bytes:
    stream = zlib.decompressobj(-15)
    out = stream.decompress(body, most + 1)
    if len(out) > most or not stream.eof:
        raise CodecError("zip-corrupt")
    return out


#: Members up to this size are remembered: the fixed parts of packages are the same in file after file.
_SMALL = 4096


def _inflate(body: bytes, size: int, crc: int, most: int) -> bytes:
    try:
        out = _inflated(body, min(size, most))
    except zlib.error:
        raise CodecError("zip-corrupt") from None
    if zlib.crc32(out) != crc or len(out) != size:
        raise CodecError("zip-corrupt")
    return out


def _deflate(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush()


_inflate_small = lru_cache(64)(_inflate)
_deflate_small = lru_cache(64)(_deflate)

#: An entry of the directory from its mark to the place of its member; the mark of a member, and the lengths of its name and extra field.
_LISTED, _HEAD = struct.Struct("<4s4xHH4xIIIHHH8xI"), struct.Struct("<4s22xHH")


def read(data: bytes, most: int = MOST_INFLATED) -> dict[str, bytes]:
    """Members by name, in the order of the directory; folders are left out. No more than ``most`` bytes are inflated."""
    end = data.rfind(_END, max(0, len(data) - 22 - 65535))
    if end < 0 or end + 22 > len(data):
        raise CodecError("zip-corrupt")
    count, _, at = struct.unpack_from("<HII", data, end + 10)
    out: dict[str, bytes] = {}
    for _ in range(count):
        if at + 46 > len(data):
            raise CodecError("zip-corrupt")
        mark, flags, method, crc, packed, size, n_name, n_extra, n_note, local = _LISTED.unpack_from(data, at)
        if mark != _ENTRY:
            raise CodecError("zip-corrupt")
        name = data[at + 46 : at + 46 + n_name].decode("utf-8", "replace")
        at += 46 + n_name + n_extra + n_note
        if flags & 1:
            raise CodecError("zip-encrypted")
        if name.endswith("/"):
            continue
        if local + 30 > len(data):
            raise CodecError("zip-corrupt")
        mark, own_name, own_extra = _HEAD.unpack_from(data, local)
        if mark != _LOCAL:
            raise CodecError("zip-corrupt")
        start = local + 30 + own_name + own_extra
        body = data[start : start + packed]
        if method == 8 and size <= min(_SMALL, most) and len(body) <= _SMALL:
            body = _inflate_small(body, size, crc, _SMALL)
        elif method == 8:
            body = _inflate(body, size, crc, most)
        elif method != 0:
            raise CodecError("zip-unsupported-method")
        elif zlib.crc32(body) != crc or len(body) != size:
            raise CodecError("zip-corrupt")
        out[name] = body
        most -= len(body)
    return out


def write(entries: Iterable[tuple[str, bytes, bool]]) -> bytes:
    """(name, data, packed?) as an archive: names in UTF-8, version 2.0, no times, so that equal input gives equal bytes."""
    body, directory, count = bytearray(), bytearray(), 0
    for name, data, packed in entries:
        label = name.encode()
        stored = data
        if packed:
            stored = _deflate_small(data) if len(data) <= _SMALL else _deflate(data)
        fields = struct.pack("<HHHHHIIIHH", 20, 0x0800, 8 if packed else 0, 0, 0, zlib.crc32(data), len(stored), len(data), len(label), 0)
        directory += _ENTRY + struct.pack("<H", 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(body)) + label
        body += _LOCAL + fields + label + stored
        count += 1
    return bytes(body + directory + _END + struct.pack("<HHHHIIH", 0, 0, count, count, len(directory), len(body), 0))
