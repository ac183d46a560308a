"""Benchmark decontamination by size-partitioned MinHash containment search.

Items are partitioned by their number of shingles into classes of up to u = 2, 4, 8, ... For each class a document is cut
into windows of 2 u shingles at every u, so that any run of u shingles is whole in one window and an item is never small
against what it is compared with. An item whose share t lies in such a window has a Jaccard similarity with it of at least
(t / 2) / (2 + t / 2), whatever the document's length; with ``rows`` = 64 hash functions, one of them agrees for all but
(1 - J) ** 64 of such pairs. Pairs that agree are verified by the exact containment of the item's shingles in the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import U, shingles, slices, text_buffers, words
from tidemark.session import ship


class Items:
    """A block of items ready for search: by shingle length, then by size class."""

    def __init__(self, ids: list[int], texts: list[str], k: int, rows: int) -> None:
        self.factors = np.random.default_rng(5).integers(0, 2**63, rows, dtype=np.int64).astype(U) * U(2) + U(1)
        raw, off = text_buffers(pa.array(texts, pa.large_string()))
        _, _, row, h = words(raw, off)
        count = np.bincount(row, minlength=len(ids))
        self.groups: list[tuple[int, list[dict]]] = []
        for n in sorted({int(min(k, c)) for c in count if c}):
            classes: dict[int, dict] = {}
            for i in np.flatnonzero(np.minimum(count, k) == n):
                at = np.searchsorted(row, [i, i + 1])
                own = np.unique(shingles(np.zeros(at[1] - at[0], np.int64), h[at[0] : at[1]], n)[1])
                u = max(2, 1 << int(np.ceil(np.log2(len(own)))))
                c = classes.setdefault(u, {"u": u, "ids": [], "sets": [], "least": []})
                c["ids"].append(ids[i])
                c["sets"].append(own)
                c["least"].append([(own * f).min() for f in self.factors])
            for c in classes.values():
                least = np.array(c.pop("least"), U)
                order = np.argsort(least, axis=0, kind="stable")
                c["sorted"] = np.take_along_axis(least, order, 0).T.copy()
                c["order"] = order.T.copy()
            self.groups.append((n, [classes[u] for u in sorted(classes)]))

    def candidates(self, row: np.ndarray, x: np.ndarray, classes: list[dict]) -> set[tuple[int, int, int]]:
        """(row, class, item) where a window's minimum is the item's. ``row`` is ascending."""
        out: set[tuple[int, int, int]] = set()
        size = classes[0]["u"]
        first = np.searchsorted(row, row)  # the first shingle of each one's row
        block = (np.arange(len(row)) - first) // size
        starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (block[1:] != block[:-1])]))
        block_row, block_no = row[starts], block[starts]
        plans = []
        for k, c in enumerate(classes):
            no = block_no // (c["u"] // size)
            begin = np.flatnonzero(np.concatenate([[True], (block_row[1:] != block_row[:-1]) | (no[1:] != no[:-1])]))
            plans.append((k, c, begin, block_row[begin]))
        for i, f in enumerate(self.factors):
            least = np.minimum.reduceat(x * f, starts)
            for k, c, begin, at in plans:
                low = np.minimum.reduceat(least, begin) if len(begin) < len(least) else least
                window = low.copy()
                same = at[1:] == at[:-1]
                window[:-1][same] = np.minimum(low[:-1][same], low[1:][same])
                have = c["sorted"][i]
                place = np.minimum(np.searchsorted(have, window), len(have) - 1)
                for w in np.flatnonzero(have[place] == window):
                    j = place[w]
                    while j < len(have) and have[j] == window[w]:
                        out.add((int(at[w]), k, int(c["order"][i][j])))
                        j += 1
        return out

    def search(self, raw: np.ndarray, off: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int]]:
        """(row, item id, shared shingles, shingles of the item) for every text and item of enough containment."""
        _, _, row, h = words(raw, off)
        for n, classes in self.groups:
            if len(h) < n:
                continue
            m = len(h) - n + 1
            x_row, x, _ = shingles(row, h, n) if n > 1 else (row, h, None)
            if n > 1:  # texts of fewer words hold no run of n
                enough = np.bincount(row, minlength=len(off) - 1)[x_row] >= n
                x_row, x = x_row[enough], x[enough]
            else:
                x = shingles(np.arange(m), h, 1)[1]
            if not len(x):
                continue
            held: dict[int, np.ndarray] = {}
            for r, k, j in sorted(self.candidates(x_row, x, classes)):
                if r not in held:
                    a, b = np.searchsorted(x_row, [r, r + 1])
                    held[r] = np.unique(x[a:b])
                own = classes[k]["sets"][j]
                at = np.minimum(np.searchsorted(held[r], own), len(held[r]) - 1)
                shared = int((held[r][at] == own).sum())
                if shared >= threshold * len(own):
                    yield r, classes[k]["ids"][j], shared, len(own)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """Items in blocks of bounded size, one on the driver at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    for r in items.toLocalIterator():
        ids.append(r["id"])
        texts.append(r["text"])
        size += len(r["text"]) * 4
        if size >= block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contaminated(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    k: int = 5, threshold: float = 0.5, rows: int = 64, block_bytes: int = 32 << 20,
) -> DataFrame:
    """``key, item_key, shared, shingles, containment``: a row for each document and item that share enough.

    A shingle is a run of ``k`` words, or an item's all words where it has fewer; containment is the share of an item's
    distinct shingles that the document has anywhere. Null and wordless texts match nothing. Items are the stated query
    set: they are broadcast in blocks of ``block_bytes`` and each block is held against all rows. Null item keys are left
    out; null document keys come back as nulls. Repeated rows are found each. Empty tables give no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = items.select(F.col(item_key).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("id is not null").orderBy("id")
    rows_of = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "id long, item long, shared long, shingles long"
    found = None
    for ids, texts in _blocks(known, block_bytes):
        sent = spark.sparkContext.broadcast(Items(ids, texts, k, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = text_buffers(batch.column(1))
                hits = [(i + r, *rest) for i, j in slices(off) for r, *rest in sent.value.search(raw[off[i] : off[j]], off[i : j + 1] - off[i], threshold)]
                cols = list(zip(*hits)) if hits else [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["id", "item", "shared", "shingles"])

        block = rows_of.mapInArrow(run, schema)
        found = block if found is None else found.unionByName(block)
    if found is None:
        found = spark.createDataFrame([], schema)
    return found.select(F.col("id").alias(key), F.col("item").alias(item_key), "shared", "shingles", (F.col("shared") / F.col("shingles")).alias("containment"))


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.5, rows: int = 64, block_bytes: int = 32 << 20
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns: searched as in ``contaminated`` and filtered in one pass, with no join.

    Each row is judged by its own whole text, so repeated rows go or stay alike and keys don't matter. Null and wordless texts
    hold nothing and stay; items that are null, empty or without a key take nothing out. Other columns, whatever their names,
    come along. With no items all rows stay; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    known = items.select(F.col(item_key).cast("long").alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).where("id is not null").orderBy("id")
    at, schema = docs.columns.index(text), docs.schema
    for ids, texts in _blocks(known, block_bytes):
        sent = spark.sparkContext.broadcast(Items(ids, texts, k, rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, off = text_buffers(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for i, j in slices(off):
                    for r, *_ in sent.value.search(raw[off[i] : off[j]], off[i : j + 1] - off[i], threshold):
                        clean[i + r] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, schema)
    return docs
