"""64-bit SimHash over CJK bigrams and words: one pass over the texts in Arrow batches, with no shuffle."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import BLANK_LINES, strip
from tidemark.session import ship

CJK = "[一-鿿]"
_BLANKS = re.compile("[\t-\r\x1c-\x20\x85\xa0  -     　]+")
_TOKEN = re.compile(f"{CJK}+|[a-zA-Z0-9]{{2,}}")


def tokens(c: Column) -> Column:
    """CJK runs as bigrams (a single one as itself) and words of two or more; else the first ten characters; none if blank."""
    flat = F.regexp_replace(strip(c), f"{BLANK_LINES}+", " ")
    runs = F.regexp_extract_all(flat, F.lit(f"{CJK}+"), F.lit(0))
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substr(r, i, F.lit(2)))))
    words = F.transform(F.regexp_extract_all(flat, F.lit("[a-zA-Z0-9]{2,}"), F.lit(0)), F.lower)
    found = F.concat(pairs, words)
    return F.when(F.coalesce(flat, F.lit("")) == "", F.array().cast("array<string>")).when(F.size(found) == 0, F.array(F.substring(flat, 1, 10))).otherwise(found)


def _tokens(text: str) -> list[str]:
    """The same in Python."""
    out = []
    for t in _TOKEN.findall(text):
        if t[0] < "一":
            out.append(t.lower())
        else:
            out.extend([t[i : i + 2] for i in range(len(t) - 1)] or [t])
    if out:
        return out
    flat = _BLANKS.sub(" ", text).strip(" ")
    return [flat[:10]] if flat else []


class Signs(dict):
    """Tokens to the places of their rows of +1 and -1, the bits of their hash; each token is hashed once."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.rows = np.zeros((1024, 64), np.int8)

    def __missing__(self, token: str) -> int:
        self.fresh.append(token)
        self[token] = at = len(self)
        return at

    def forget(self) -> None:
        self.clear()
        self.rows = np.zeros((1024, 64), np.int8)

    def indices(self, found: list[str]) -> np.ndarray:
        out = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        if self.fresh:
            new = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[7::-1] for t in self.fresh]
            bits = np.unpackbits(np.frombuffer(b"".join(new), np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            while len(self.rows) < len(self):
                self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
            self.rows[len(self) - len(new) : len(self)] = bits.astype(np.int8) * 2 - 1
            self.fresh.clear()
        return out


#: Tokens whose rows a worker keeps, some 200 bytes each with their text; it begins anew beyond that.
TOKENS = 1 << 17
#: Texts that a worker takes out of a batch at once.
TEXTS = 256


def hashes(texts: list[str | None], signs: Signs, block: int = 1 << 15) -> list[int]:
    """The hash of each text as a signed number; 0 for blank and null ones. Very long texts are summed in blocks."""
    power, out = np.uint64(1) << np.arange(64, dtype=np.uint64), []
    for text in texts:
        found = _tokens(text or "")
        total = np.zeros(64, np.int64)
        for i in range(0, len(found), block):
            at = signs.indices(found[i : i + block])
            total += signs.rows[at].sum(0, dtype=np.int32)
            if len(signs) > TOKENS:
                signs.forget()
        out.append(int(power[total > 0].sum(dtype=np.uint64).astype(np.int64)))
    return out


def hash_last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow``: the last column, a text, gives way to its hash; a null one to null."""
    signs = Signs()
    for whole in batches:
        for i in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(i, TEXTS)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [None if t is None else h for t, h in zip(texts, hashes(texts, signs))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*batch.schema.names[:-1], "simhash"])


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, simhash`` for every row; a blank or null text hashes to 0. Nothing but the two columns leaves the JVM, and nothing is shuffled."""
    ship(df.sparkSession)
    return df.select(F.col(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).mapInArrow(hash_last, f"`{key}` {df.schema[key].dataType.simpleString()}, simhash long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - distance(a, b) / 64.0
