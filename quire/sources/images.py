"""Image files: reading and writing PNG, and what the headers of JPEG, JPEG 2000 and JBIG2 say."""

from __future__ import annotations

import re
import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.sources.binary import unfiltered

_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel by a PNG's colour type (palettes are not read).
_SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def png_bytes(width: int, height: int, samples: int, pixels: bytes) -> bytes:
    """A PNG of 8-bit rows without filters; samples is 1 (grey) or 3 (colour)."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    if samples not in (1, 3) or len(pixels) != width * height * samples:
        raise ValueError("pixels do not fill the image")
    row = width * samples
    raw = b"".join(b"\0" + pixels[k : k + row] for k in range(0, len(pixels), row)) if row else b""
    header = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[samples], 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_pixels(data: bytes) -> tuple[int, int, int, bytes]:
    """Width, height, samples and pixels of an 8-bit PNG that is not interlaced; ValueError for any other."""
    if data[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, packed, header = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if not header or header[2] != 8 or header[3] not in _SAMPLES or header[6]:
        raise ValueError("a PNG of a kind that is not read")
    width, height, _, colour, *_ = header
    samples = _SAMPLES[colour]
    raw, row = zlib.decompress(packed), width * samples
    made, before = bytearray(), bytes(row)
    for k in range(height):
        line = bytearray(raw[k * (row + 1) + 1 : (k + 1) * (row + 1)])
        unfiltered(line, before, raw[k * (row + 1)], samples)
        made += line
        before = bytes(line)
    return width, height, samples, bytes(made)


def probed(data: bytes | None) -> tuple[str, int, int, int] | None:
    """(format, width, height, components) from an image file's header; None for what is not known."""
    data = data or b""
    if data[:8] == _SIGNATURE and len(data) >= 26:
        width, height, _, colour = struct.unpack(">IIBB", data[16:26])
        return "png", width, height, _SAMPLES.get(colour, 1)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
            elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
                return "jpeg", width, height, parts
            else:
                at += 2 if kind == 1 or 0xD0 <= kind <= 0xD8 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        return None
    if data[4:8] == b"jP  " and (found := data.find(b"ihdr")) > 0 and len(data) >= found + 14:
        height, width, parts = struct.unpack(">IIH", data[found + 4 : found + 14])
        return "jpeg2000", width, height, parts
    if data[:4] == b"\xff\x4f\xff\x51" and len(data) >= 42:
        x1, y1, x0, y0 = struct.unpack(">IIII", data[8:24])
        return "jpeg2000", x1 - x0, y1 - y0, struct.unpack(">H", data[40:42])[0]
    if data[:8] == b"\x97JB2\r\n\x1a\n":
        # a page information segment: number, flags 48, referred-to 0, page, length 19, then width and height
        if found := re.compile(rb"....\x30\x00.....", re.S).search(data, 9):
            width, height = struct.unpack(">II", data[found.end() : found.end() + 8].ljust(8, b"\0"))
            return "jbig2", width, height, 1
    return None


def probe(column: str) -> Column:
    """struct<format, width, height, components> of image bytes, null for what is not known."""

    @F.pandas_udf("format string, width long, height long, components int")
    def made(values: pd.Series) -> pd.DataFrame:
        rows = [probed(v) or (None, None, None, None) for v in values]
        return pd.DataFrame(rows, columns=["format", "width", "height", "components"]).astype({"width": "Int64", "height": "Int64", "components": "Int32"})

    return made(F.col(column))


def as_png(width: str, height: str, samples: str, pixels: str) -> Column:
    """PNG bytes of raw 8-bit pixels; null where these do not fill the image."""

    @F.pandas_udf("binary")
    def made(w: pd.Series, h: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
        def one(row: tuple) -> bytes | None:
            try:
                return png_bytes(*map(int, row[:3]), bytes(row[3]))
            except (TypeError, ValueError):
                return None

        return pd.Series([one(r) for r in zip(w, h, n, p)])

    return made(F.col(width), F.col(height), F.col(samples), F.col(pixels))


def from_png(column: str) -> Column:
    """struct<width, height, samples, pixels> of PNG bytes, all null for what is not read."""

    @F.pandas_udf("width int, height int, samples int, pixels binary")
    def made(values: pd.Series) -> pd.DataFrame:
        def one(v: bytes | None) -> tuple:
            try:
                return png_pixels(bytes(v))
            except (TypeError, ValueError, struct.error, zlib.error, IndexError):
                return None, None, None, None

        return pd.DataFrame([one(v) for v in values], columns=["width", "height", "samples", "pixels"]).astype({"width": "Int32", "height": "Int32", "samples": "Int32"})

    return made(F.col(column))


def resampled(width: int, height: int, samples: int, pixels: bytes, percent: float) -> tuple[int, int, bytes]:
    """An 8-bit image at a share of its size, at least one pixel either way; each new pixel is the mean of those it covers."""
    import numpy as np

    to_width, to_height = max(1, round(width * percent / 100)), max(1, round(height * percent / 100))
    whole = np.frombuffer(pixels, np.uint8).reshape(height, width, samples).astype(np.float64)
    for axis, (size, new) in enumerate(((height, to_height), (width, to_width))):
        cuts = np.arange(new) * size // new
        counts = np.diff(np.append(cuts, size))
        whole = np.add.reduceat(whole, cuts, axis=axis) / counts.reshape([-1 if a == axis else 1 for a in range(3)])
    return to_width, to_height, np.floor(whole + 0.5).astype(np.uint8).tobytes()


def processed(columns: dict[str, str], percent: float, least_pixels: int) -> Column:
    """struct<width, height, pixels>: images (columns width, height, samples, pixels) of at least so many pixels at a share of their size, smaller ones as they are; null for what is no image."""

    @F.pandas_udf("width int, height int, pixels binary")
    def made(w: pd.Series, h: pd.Series, n: pd.Series, p: pd.Series) -> pd.DataFrame:
        def one(row: tuple) -> tuple:
            try:
                width, height, samples, pixels = *map(int, row[:3]), bytes(row[3])
            except (TypeError, ValueError):
                return None, None, None
            if not width * height or len(pixels) != width * height * samples:
                return None, None, None
            return resampled(width, height, samples, pixels, percent) if width * height >= least_pixels else (width, height, pixels)

        return pd.DataFrame([one(r) for r in zip(w, h, n, p)], columns=["width", "height", "pixels"]).astype({"width": "Int32", "height": "Int32"})

    return made(*[F.col(columns[c]) for c in ("width", "height", "samples", "pixels")])
