"""Sound and pictures as far as bytes tell: heads, 16-bit sound, PNG, and pictures wrapped as SVG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.glyphs import base64_line
from ..functions.text import xml_escape
from .model import CodecError
from .sound import riff


def big_end(data: Column, at: Column | int, n: int) -> Column:
    """The number in n bytes from a place (from 0), big end first."""
    return F.conv(F.hex(F.substring(data, at + 1, n)) if isinstance(at, int) else F.hex(data.substr(at + 1, F.lit(n))), 16, 10).cast("long")


def little_end(data: Column, at: int, n: int) -> Column:
    return sum((big_end(data, at + k, 1) * (1 << 8 * k) for k in range(n)), F.lit(0)).cast("long")


def png_size(data: Column) -> Column:
    """Struct of width and height from the head of a PNG, null for other data."""
    is_png = (F.octet_length(data) >= 30) & (F.hex(F.substring(data, 1, 2)) == "8950")
    return F.when(is_png, F.struct(big_end(data, 16, 4).alias("width"), big_end(data, 20, 4).alias("height")))


def jpeg_size(data: Column) -> Column:
    """Struct of width and height from the frame of a JPEG: its segments are followed by their lengths."""
    state = F.struct(F.lit(2).cast("long").alias("at"), F.lit(None).cast("long").alias("width"), F.lit(None).cast("long").alias("height"))

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        marker, size = big_end(data, at + 1, 1), big_end(data, at + 2, 2)
        valid = s["width"].isNull() & (at + 9 < F.octet_length(data)) & (big_end(data, at, 1) == 255)
        frame = marker.between(0xC0, 0xCF) & ~marker.isin(0xC4, 0xC8)
        found = F.struct(at.alias("at"), big_end(data, at + 7, 2).alias("width"), big_end(data, at + 5, 2).alias("height"))
        return F.when(valid & frame, found).when(valid, F.struct((at + 2 + size).alias("at"), s["width"].alias("width"), s["height"].alias("height"))).otherwise(s)

    def stride(s: Column, _: Column) -> Column:
        """Further segments, as long as there are any; heads have some ten, but metadata may be cut into very many."""
        on = s["width"].isNull() & (s["at"] + 9 < F.octet_length(data)) & (big_end(data, s["at"], 1) == 255)
        return F.when(on, F.aggregate(F.sequence(F.lit(1), F.lit(64)), s, step)).otherwise(s)

    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.octet_length(data) / 256)).cast("int")), state, stride)
    is_jpeg = (F.octet_length(data) >= 30) & (F.hex(F.substring(data, 1, 2)) == "FFD8")
    return F.when(is_jpeg & walked["width"].isNotNull(), F.struct(walked["width"].alias("width"), walked["height"].alias("height")))


def wav_info(data: Column) -> Column:
    """Struct of rate, channels, bits and seconds of a PCM file with the plain head of 44 bytes; null for other data."""
    is_wav = (F.octet_length(data) >= 44) & (F.hex(F.substring(data, 1, 4)) == "52494646") & (F.hex(F.substring(data, 9, 8)) == "57415645666D7420")
    per_second = F.nullif(little_end(data, 28, 4), F.lit(0))
    return F.when(is_wav, F.struct(little_end(data, 24, 4).alias("rate"), little_end(data, 22, 2).alias("channels"), little_end(data, 34, 2).alias("bits"), (little_end(data, 40, 4) / per_second).alias("seconds")))


def _le(number: Column, n: int) -> Column:
    """Hex digits of a number in n bytes, little end first."""
    digits = F.lpad(F.hex(number.cast("long")), 2 * n, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(n))))


def wav_head(frames: Column, rate: Column, channels: Column) -> Column:
    """The 44 bytes before 16-bit samples, with at most two channels."""
    c = F.least(channels, F.lit(2))
    data, whole = audio.wav_sizes(frames, channels)
    digits = F.concat(F.lit("52494646"), _le(whole - 8, 4), F.lit("57415645666D7420"), _le(F.lit(16), 4), _le(F.lit(1), 2), _le(c, 2), _le(rate, 4), _le(rate * c * 2, 4), _le(c * 2, 2), _le(F.lit(16), 2), F.lit("64617461"), _le(data, 4))
    return F.unhex(digits)


def wav_bytes(samples: Column) -> Column:
    """16-bit samples as bytes, little end first."""
    one = lambda s: _le(F.pmod(s.cast("long"), F.lit(65536)), 2)
    return F.unhex(F.array_join(F.transform(samples, one), ""))


def write_wav(sounds: DataFrame) -> DataFrame:
    """(file_id, rate, left, right: arrays of samples from -1 to 1; right may be null) -> (file_id, content)."""
    left, right = audio.pcm16(F.col("left")), audio.pcm16(F.col("right"))
    samples = F.when(F.col("right").isNull(), left).otherwise(audio.interleave(left, right))
    channels = F.when(F.col("right").isNull(), 1).otherwise(2)
    return sounds.select("file_id", F.concat(wav_head(F.size("left"), F.col("rate"), channels), wav_bytes(samples)).alias("content"))


def read_wav(files: DataFrame) -> DataFrame:
    """(file_id, content) -> (file_id, rate, channels, samples array<float>, code) of PCM files, their frames one after the other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file_id, content in zip(b["file_id"], b["content"], strict=True):
                try:
                    rate, samples = riff(bytes(content or b""))
                    rows.append((file_id, rate, samples.shape[1], None, samples.reshape(-1).astype(np.float32)))
                except CodecError as e:
                    rows.append((file_id, None, None, e.code, None))
            yield pd.DataFrame(rows, columns=["file_id", "rate", "channels", "code", "samples"])

    return files.select("file_id", "content").mapInPandas(run, "file_id string, rate long, channels long, code string, samples array<float>")


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """Decoded pictures below a path by Spark's own reader: origin, width, height, channels, mode, data; broken ones are left out."""
    return spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(path).select("image.*")


# Samples of a pixel by the colour type of a PNG.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_parts(data: bytes) -> tuple[int, int, int, int, int, bytes, bytes] | None:
    """Width, height, bits, colour type, interlacing, palette and compressed rows of a PNG; None for other bytes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR" or len(data) < 33:
        return None
    width, height, bits, kind, _, _, laced = struct.unpack_from(">IIBBBBB", data, 16)
    at, palette, body = 8, b"", bytearray()
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, part = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        at += 12 + size
        if name == b"PLTE":
            palette = part
        elif name == b"IDAT":
            body += part
        elif name == b"IEND":
            break
    return (width, height, bits, kind, laced, palette, bytes(body)) if kind in _SAMPLES and width and height and body else None


def _unfiltered(raw: bytes, height: int, width: int, step: int) -> np.ndarray:
    """Rows of bytes without their filters; a filter that looks left goes by whole pixels, the others by whole rows."""
    rows = np.frombuffer(raw, np.uint8, height * (width + 1)).reshape(height, width + 1)
    out, above = np.zeros((height, width), np.uint8), np.zeros(width, np.uint8)
    for k in range(height):
        how, row = rows[k, 0], rows[k, 1:].copy()
        if how == 1:
            wide = np.concatenate([row, np.zeros(-width % step, np.uint8)]).reshape(-1, step)
            row = np.cumsum(wide, axis=0, dtype=np.uint8).reshape(-1)[:width]
        elif how == 2:
            row = row + above
        elif how in (3, 4):
            left, corner = [0] * step, [0] * step
            done, up = row.tolist(), above.tolist()
            for j in range(width):
                a, b, c = (done[j - step], up[j], up[j - step]) if j >= step else (left[0], up[j], corner[0])
                if how == 3:
                    guess = (a + b) >> 1
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                done[j] = (done[j] + guess) & 255
            row = np.array(done, np.uint8)
        out[k] = above = row
    return out


def png_rows(data: bytes, most_pixels: int = 1 << 27) -> np.ndarray | None:
    """Red, green, blue and alpha (height, width, 4) of a PNG that is not interlaced; None for what cannot be read."""
    found = png_parts(data)
    if found is None:
        return None
    width, height, bits, kind, laced, palette, body = found
    if laced or width * height > most_pixels or bits not in (1, 2, 4, 8, 16) or bits < 8 and kind not in (0, 3):
        return None
    samples = _SAMPLES[kind]
    line = (width * samples * bits + 7) // 8
    try:
        raw = zlib.decompressobj().decompress(body, height * (line + 1))
    except zlib.error:
        return None
    if len(raw) < height * (line + 1):
        return None
    rows = _unfiltered(raw, height, line, max(1, samples * bits // 8))
    if bits == 16:
        rows = rows[:, ::2]  # the high byte
    elif bits < 8:
        rows = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = (rows * (1 << np.arange(bits)[::-1])).sum(axis=2).astype(np.uint8)[:, :width]
        if kind == 0:
            rows = (rows.astype(np.uint16) * 255 // ((1 << bits) - 1)).astype(np.uint8)
    pixels = rows[:, : width * samples].reshape(height, width, samples)
    full = np.full((height, width, 1), 255, np.uint8)
    if kind == 3:
        colours = np.zeros((256, 3), np.uint8)
        colours[: len(palette) // 3] = np.frombuffer(palette[: len(palette) // 3 * 3], np.uint8).reshape(-1, 3)[:256]
        return np.concatenate([colours[pixels[..., 0]], full], axis=2)
    if kind in (0, 4):
        grey = np.repeat(pixels[..., :1], 3, axis=2)
        return np.concatenate([grey, pixels[..., 1:] if kind == 4 else full], axis=2)
    return pixels if kind == 6 else np.concatenate([pixels, full], axis=2)


def write_png(images: DataFrame) -> DataFrame:
    """(file_id, width, height, channels, data: rows of blue, green, red and perhaps alpha, as Spark reads them) -> (file_id, content)."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    def one(width: int, height: int, channels: int, data: bytes) -> bytes:
        size = height * width * channels
        rows = np.frombuffer(data[:size].ljust(size, b"\0"), np.uint8).reshape(height, width, channels)
        order = {1: [0], 2: [0, 1], 3: [2, 1, 0], 4: [2, 1, 0, 3]}[channels]
        raw = np.zeros((height, 1 + width * channels), np.uint8)  # a filter byte of 0 before each row
        raw[:, 1:] = rows[:, :, order].reshape(height, -1)
        kind = {1: 0, 2: 4, 3: 2, 4: 6}[channels]
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + chunk(b"IEND", b"")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(*r) for r in zip(b["width"], b["height"], b["channels"], b["data"], strict=True)]
            yield pd.DataFrame({"file_id": b["file_id"], "content": made})

    return images.select("file_id", "width", "height", "channels", "data").mapInPandas(run, "file_id string, content binary")


def svg_wrapper(data: Column, mime: Column, width: Column, height: Column, title: Column) -> Column:
    """A picture as a vector file that shows it."""
    w, h = width.cast("string"), height.cast("string")
    return F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), w, F.lit('" height="'), h, F.lit('"><title>'), xml_escape(title), F.lit('</title><image width="'), w, F.lit('" height="'), h, F.lit('" href="data:'), mime, F.lit(";base64,"), base64_line(data), F.lit('"/></svg>'))
