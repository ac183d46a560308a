"""Hashed n-gram indicators of texts: word n-grams and n-grams of the shape of the bytes."""

from __future__ import annotations

import numpy as np

from tidemark.llm._bytes import U, mix, words

BITS = 20
#: Heads said once in so many words or more are features of their own.
RATES = (200, 70, 25)

SHAPE = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    SHAPE[_b] = 1 if _b >= 128 or "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t" else 5 if _c in "\r\n" else 6
for _i, _c in enumerate("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    SHAPE[ord(_c)] = 7 + _i


def _unique(row: np.ndarray, feature: np.ndarray, bits: int) -> np.ndarray:
    key = (row.astype(U) << U(bits)) | feature
    key.sort()
    keep = np.empty(len(key), bool)
    keep[:1] = True
    np.not_equal(key[1:], key[:-1], out=keep[1:])
    return key[keep]


def _hashed(x: np.ndarray, kind: int, bits: int) -> np.ndarray:
    return mix(x + U(kind * 0x9E3779B97F4A7C15 % 2**64)) >> U(64 - bits)


def indicators(
    raw: np.ndarray, offsets: np.ndarray, word_grams: tuple[int, ...] = (1,), shape_grams: tuple[int, ...] = (), runs: tuple[int, ...] = (), heads: tuple[int, ...] = (), bits: int = BITS
) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature (below 2 ** ``bits``) of every distinct feature of every text, in row order.

    ``word_grams`` are n-grams of words, ``shape_grams`` n-grams of the classes of bytes, ``runs`` n-grams of one word
    said n times, whichever it is, and ``heads`` the first n bytes of longer words, also by how often they are said.
    """
    parts = []
    if word_grams or runs or heads:
        begins = dict.fromkeys(heads)
        _, _, row, h = words(raw, offsets, heads=begins)
        said = np.bincount(row, minlength=len(offsets) - 1)
        for n, (at, x) in begins.items():
            key = (at.astype(U) << U(bits)) | _hashed(x, 300 + n, bits)
            key.sort()
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(key)))
            key = key[new]
            parts.append(key)
            # the same again where it is said more than once and often for the length of the text
            at = (key >> U(bits)).astype(np.int64)
            for level, least in enumerate(RATES):
                often = (times >= 2) & (times * least >= said[at])
                parts.append((at[often].astype(U) << U(bits)) | _hashed(key[often] & U((1 << bits) - 1), 400 + 10 * n + level, bits))
        for n in runs:
            if len(h) >= n:
                m = len(h) - n + 1
                same = row[:m] == row[n - 1 :]
                for i in range(1, n):
                    same &= h[i : i + m] == h[:m]
                parts.append(_unique(row[:m][same], np.full(int(same.sum()), _hashed(np.array([n], U), 200, bits)[0]), bits))
        for n in word_grams:
            if len(h) >= n:
                m = len(h) - n + 1
                x = np.zeros(m, U)
                for i in range(n):
                    x = x * U(0xC2B2AE3D27D4EB4F) + h[i : i + m]
                ok = row[:m] == row[n - 1 :]
                parts.append(_unique(row[:m][ok], _hashed(x[ok], n, bits), bits))
    if shape_grams and len(raw):
        code = SHAPE[raw].astype(np.uint32)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        for n in shape_grams:
            if len(raw) >= n:
                m = len(raw) - n + 1
                x = np.zeros(m, np.uint32)
                for i in range(n):
                    x = (x << np.uint32(6)) | code[i : i + m]
                ok = row[:m] == row[n - 1 :]
                parts.append(_unique(row[:m][ok], _hashed(x[ok].astype(U), 100 + n, bits), bits))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(parts)
    key.sort()
    return (key >> U(bits)).astype(np.int64), (key & U((1 << bits) - 1)).astype(np.int64)
