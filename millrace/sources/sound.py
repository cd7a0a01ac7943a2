"""Sound files: a walk over RIFF chunks, and samples as arrays."""

from __future__ import annotations

import struct

import numpy as np

from .model import CodecError

# Format tags of whole numbers, of fractions, and of formats that tell their tag later.
_WHOLE, _FRACTION, _EXTENDED = 1, 3, 0xFFFE


def riff(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples from -1 to 1 (frames, channels) of a WAV file, whatever chunks come before its data."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise CodecError("decode-failed")
    at, told, body = 12, None, None
    while at + 8 <= len(content) and body is None:
        name, size = content[at : at + 4], int.from_bytes(content[at + 4 : at + 8], "little")
        part = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(part) >= 16:
            told = part
        elif name == b"data":
            body = part
        at += 8 + size + size % 2
    if told is None or body is None:
        raise CodecError("decode-failed")
    tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", told)
    if tag == _EXTENDED and len(told) >= 26:
        (tag,) = struct.unpack_from("<H", told, 24)
    width = bits // 8
    if not channels or not rate or (tag, bits) not in ((_WHOLE, 8), (_WHOLE, 16), (_WHOLE, 24), (_WHOLE, 32), (_FRACTION, 32), (_FRACTION, 64)):
        raise CodecError("decode-failed")
    body = body[: len(body) // (width * channels) * width * channels]
    if tag == _FRACTION:
        samples = np.frombuffer(body, f"<f{width}").astype(np.float64)
    elif bits == 8:
        samples = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        three = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        samples = ((three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8) / float(1 << 23)
    else:
        samples = np.frombuffer(body, f"<i{width}") / float(1 << (bits - 1))
    return rate, samples.reshape(-1, channels)


def wav(rate: int, samples: np.ndarray) -> bytes:
    """16-bit samples of at most two channels after a plain head."""
    shown = np.clip(np.nan_to_num(samples[:, :2]), -1, 1)
    whole = np.trunc(np.where(shown < 0, shown * 32768, shown * 32767)).astype("<i2")
    channels = whole.shape[1]
    body = whole.tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16) + b"data" + struct.pack("<I", len(body)) + body


def probe(content: bytes) -> list[dict]:
    """A row of kind "sound" of a file whose samples can be read: rate and seconds beside its bytes."""
    rate, samples = riff(content)
    return [{"kind": "sound", "data": content, "mime": "audio/wav", "x": float(rate), "y": len(samples) / rate}]


def encoded(data: bytes) -> bytes:
    return wav(*riff(data))
