"""Perceptual hashes of images: 64 bits of the low frequencies of a 32 x 32 grey picture."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Values a pixel by colour type: grey, RGB, palette, grey with alpha, RGB with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _png(raw: bytes) -> np.ndarray | None:
    """Grey values of a PNG of 8 bits a channel, not interlaced; None for others."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at, data, palette, head = 8, [], b"", None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = body
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    if head is None or head[2] != 8 or head[6] or head[3] not in CHANNELS:
        return None
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width * n + n), np.int64)  # a row above and a pixel before, both zero
    for y in range(height):
        line, kind = lines[y, 1:].astype(np.int64), lines[y, 0]
        above = out[y, n:]
        if kind in (0, 2):
            out[y + 1, n:] = (line + (above if kind == 2 else 0)) & 255
            continue
        for x in range(width * n):
            a, b, c = out[y + 1, x], out[y, x + n], out[y, x]
            if kind == 4:
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
            else:
                guess = a if kind == 1 else (a + b) // 2
            out[y + 1, x + n] = (line[x] + guess) & 255
    pixels = out[1:, n:].reshape(height, width, n).astype(float)
    if head[3] == 3:
        pixels = np.frombuffer(palette, np.uint8).reshape(-1, 3)[pixels[:, :, 0].astype(int)].astype(float)
    return pixels[:, :, :3] @ np.array([0.299, 0.587, 0.114]) if pixels.shape[2] >= 3 else pixels[:, :, 0]


def grey(raw: bytes) -> np.ndarray | None:
    """Grey values by Pillow where it is installed, else of a PNG; None for what can't be read."""
    try:
        from PIL import Image
    except ImportError:
        try:
            return _png(raw)
        except (ValueError, struct.error, zlib.error):
            return None
    try:
        return np.asarray(Image.open(io.BytesIO(raw)).convert("L"), float)
    except OSError:
        return None


def phash(raw: bytes | None) -> int | None:
    """Bits of the 8 x 8 lowest frequencies above their median, as a signed number."""
    picture = grey(raw) if raw else None
    if picture is None or not picture.size:
        return None
    # means over a grid of 32 x 32
    rows, cols = (np.minimum(np.arange(n) * 32 // n, 31) for n in picture.shape)
    if len(rows) < 32 or len(cols) < 32:
        picture = np.kron(picture, np.ones((-(-32 // len(rows)), -(-32 // len(cols)))))
        rows, cols = (np.minimum(np.arange(n) * 32 // n, 31) for n in picture.shape)
    small = np.zeros((32, 32))
    np.add.at(small, (rows[:, None], cols[None, :]), picture)
    small /= np.bincount(rows, minlength=32)[:, None] * np.bincount(cols, minlength=32)[None, :]
    k = np.arange(32)
    cosines = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (cosines @ small @ cosines.T)[:8, :8].round(6)
    bits = (low > np.median(low)).ravel()
    value = int(sum(1 << i for i, b in enumerate(bits) if b))
    return value - (1 << 64) if value >> 63 else value


@F.pandas_udf(LongType())
def _phash(content: pd.Series) -> pd.Series:
    return pd.Series([phash(c) for c in content], dtype="Int64")


def image_hash(content: Column) -> Column:
    """The hash of an image's bytes; null for a null and for what can't be read."""
    return _phash(content)
