"""Vectorised work on the UTF-8 bytes of many texts at a time.

A word is a maximal run of ASCII letters, ASCII digits and bytes from 0x80 up; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
SLICE = 1 << 18

LOWER = np.zeros(256, np.uint8)
LOWER[48:58] = np.arange(48, 58)
LOWER[97:123] = np.arange(97, 123)
LOWER[65:91] = np.arange(97, 123)
LOWER[128:] = np.arange(128, 256)

_powers = np.ones(1, U)
_inverses = np.ones(1, U)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * SLICE)
        base, inverse = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        base[0] = inverse[0] = 1
        _powers, _inverses = np.cumprod(base), np.cumprod(inverse)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; one longer text is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def words(raw: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, heads: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (in ``raw``), row and 64-bit hash of every word; ``fold`` maps bytes, 0 is no word byte.

    ``heads`` has lengths as keys; each gets the rows and hashes of the first so many bytes of the words that are longer.
    """
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        for k in heads or ():
            heads[k] = none, np.zeros(0, U)
        return none, none, none, np.zeros(0, U)
    code = fold[raw]
    inside = code != 0
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] = inside[edges]
    ends = np.empty(n, bool)
    ends[-1] = inside[-1]
    ends[:-1] = inside[:-1] & (~inside[1:] | starts[1:])
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    powers, inverses = _tables(n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(code.astype(U) * powers[:n], out=total[1:])
    h = mix((total[e] - total[s]) * inverses[s] + (e - s).astype(U))
    row = np.searchsorted(offsets, s, "right") - 1
    for k in heads or ():
        a = s[e - s > k]
        heads[k] = row[e - s > k], mix((total[a + k] - total[a]) * inverses[a] + U(k))
    return s, e, row, h


def shingles(row: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and first word of every run of ``k`` words; a text of fewer words is one shingle."""
    if not len(h):
        return row, h, row
    m = len(h) - k + 1
    counts = np.bincount(row)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if m > 0:
        ok = row[:m] == row[k - 1 :]
        x = np.zeros(m, U)
        for i in range(k):
            x = x * U(0xC2B2AE3D27D4EB4F) + h[i : i + m]
        first = np.flatnonzero(ok)
        out_row, out = row[:m][ok], mix(x[ok])
    else:
        out_row, out, first = row[:0], h[:0], np.zeros(0, np.int64)
    if len(short):
        ends = np.cumsum(counts)
        extra = []
        for r in short:
            x = 0
            for v in h[ends[r] - counts[r] : ends[r]]:
                x = (x * 0xC2B2AE3D27D4EB4F + int(v)) % 2**64
            extra.append((x + int(counts[r])) % 2**64)
        out_row = np.concatenate([out_row, short])
        out = np.concatenate([out, mix(np.array(extra, U))])
        first = np.concatenate([first, ends[short] - counts[short]])
        order = np.argsort(out_row, kind="stable")
        out_row, out, first = out_row[order], out[order], first[order]
    return out_row, out, first


def word_list(text: str | None) -> list[str]:
    """The words of one text as strings: the plain statement of ``words``."""
    out, now = [], []
    for c in text or "":
        if "A" <= c <= "Z":
            c = c.lower()
        if c >= "\x80" or "0" <= c <= "9" or "a" <= c <= "z":
            now.append(c)
        elif now:
            out.append("".join(now))
            now = []
    if now:
        out.append("".join(now))
    return out
