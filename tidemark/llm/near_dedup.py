"""Near duplicates by BagMinHash.

A text is a bag of word shingles, counted. Its signature samples the bag as in BagMinHash (Ertl, 2018): weights are
discretised to whole counts, and the weight axis of each element is cut into the dyadic blocks [0, 1), [1, 2), [2, 4), ...,
each with a Poisson process of points in time of its own that depends on the element alone. A block below the element's
count gives all its points; the block that the count ends in is a hierarchy cut short: its points carry a weight
coordinate and those above the count are thinned out. Each point falls to one signature component, which keeps its
earliest point, so two components agree with the probability of the weighted Jaccard similarity, exactly. Elements are
dropped as soon as their next point is later than every component's.

Signatures are banded. Equal bags are one vertex. In each bucket every vertex is compared with the bucket's smallest by the
exact overlap of the multisets. All other pairs of a bucket are then looked at: the triangle inequality of the Jaccard
distances to the bucket's smallest proves their link or rules it out, and the rest are compared too. The links make classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import U, mix, shingles, slices, text_buffers, words
from tidemark.llm.graph import components
from tidemark.rows import FEW, drop_rows
from tidemark.session import cut, ship

SHINGLE = 3
BANDS, ROWS = 40, 4
THRESHOLD = 0.55
#: Members of a bucket that meet all its others in one task.
BLOCK = 1000
_GOLD = U(0x9E3779B97F4A7C15)


def bags(raw: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle hash (48 bits) and count of every element of every bag, in order."""
    _, _, row, h = words(raw, off)
    at, x, _ = shingles(row, h, k)
    key = (at.astype(U) << U(48)) | (x >> U(16))
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U(48)).astype(np.int64), key & U((1 << 48) - 1), count


def signatures(row: np.ndarray, x: np.ndarray, count: np.ndarray, n: int, m: int = BANDS * ROWS) -> np.ndarray:
    """n x m BagMinHash components as integers; two agree where the earliest point is the same."""
    best = np.full(n * m, np.inf)
    cells = []
    low, high = 0, 1
    left = np.arange(len(x))
    while len(left):  # one pass a dyadic block
        cells.append((left, np.full(len(left), low), np.full(len(left), high - low)))
        low, high = high, 2 * high
        left = left[count[left] > low]
    of = np.concatenate([c[0] for c in cells]) if cells else np.zeros(0, np.int64)
    base = np.concatenate([c[1] for c in cells]) if cells else of
    width = np.concatenate([c[2] for c in cells]) if cells else of
    doc, weight = row[of], count[of]
    state = mix(x[of] + mix(base.astype(U) + _GOLD))
    time = np.zeros(len(of))
    with np.errstate(over="ignore"):
        while len(doc):
            state = state + _GOLD
            a = mix(state)
            time = time - np.log(((a >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            b = mix(a ^ U(0xD1B54A32D192ED03))
            slot = ((b >> U(32)) * U(m)) >> U(32)
            inside = base + (((b & U(0xFFFFFFFF)) * width.astype(U)) >> U(32)).astype(np.int64) < weight
            np.minimum.at(best, doc[inside] * m + slot[inside].astype(np.int64), time[inside])
            latest = best.reshape(n, m).max(axis=1)
            more = time < latest[doc]
            doc, weight, base, width, state, time = doc[more], weight[more], base[more], width[more], state[more], time[more]
    return best.reshape(n, m).view(U)


def _sketch(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(2))
            sizes, digests, keys = [np.zeros(0, np.int64)], [np.zeros((0, 2), U)], [np.zeros((0, bands), U)]
            for i, j in slices(off):
                row, x, count = bags(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                n = j - i
                sig = signatures(row, x, count, n, bands * rows)
                element = mix(mix(x) + count.astype(U))
                one, two = np.zeros(n, U), np.zeros(n, U)
                np.add.at(one, row, element)
                np.add.at(two, row, mix(element + _GOLD))
                digests.append(np.stack([one, two], 1))
                sizes.append(np.bincount(row, count, minlength=n).astype(np.int64))
                band = np.zeros((n, bands), U)
                for r in range(rows):
                    band = mix(band * U(3) + sig.reshape(n, bands, rows)[:, :, r])
                keys.append(mix(band + np.arange(bands, dtype=U) * _GOLD))
            flat = np.concatenate(keys).view(np.int64)
            pair = np.concatenate(digests).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.size + 1, bands), pa.int32()), pa.array(flat.ravel()))
            columns = [batch.column(0), batch.column(1), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.concatenate(sizes)), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "d1", "d2", "size", "keys"])

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Overlap of two multisets given as sorted elements and counts."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def pack(x: np.ndarray, count: np.ndarray) -> bytes:
    """A bag as 6 bytes an element in order, with the counts behind them if any is above 1."""
    body = np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
    return len(x).to_bytes(8, "little") + body + (count.astype("<u4").tobytes() if len(count) and count.max() > 1 else b"")


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, 8).reshape(-1, 6)
    rest = blob[8 + 6 * n :]
    return wide.reshape(-1).view(U), np.frombuffer(rest, "<u4").astype(np.int64) if rest else np.ones(n, np.int64)


def _pack(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            out = []
            for i, j in slices(off):
                row, x, count = bags(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)
                cuts = np.searchsorted(row, np.arange(j - i + 1))
                out += [pack(x[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["v", "bag"])

    return run


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple[int | None, tuple | None] = (None, None)
    for batch in batches:
        out = []
        for b, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if b != last[0]:
                last = (b, unpack(y.as_py()))
            out.append(weighted_jaccard(unpack(x.as_py()), last[1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "j"])


def _overlaps(pairs: DataFrame, vertices: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """``a, b`` to ``a, b, j``. The bag of each vertex that a pair names is made once, and bags are what is moved."""
    wanted = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    wanted = cut(vertices.join(wanted, "v").select("v", F.col("id").alias("_id"), F.col("h").alias("_h")))
    few = wanted.count() <= 2_000_000  # 24 bytes each
    held = texts.join(F.broadcast(wanted) if few else wanted, (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")))
    held = cut(held.select("v", "text").mapInArrow(_pack(k), "v long, bag binary"))
    one = pairs.join(held.select(F.col("v").alias("a"), F.col("bag").alias("x")), "a")
    two = one.join(held.select(F.col("v").alias("b"), F.col("bag").alias("y")), "b")
    # rows that repeat a key and a text are one vertex whose bag came more than once
    return cut(two.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long, j double").dropDuplicates(["a", "b"]))


def _classes(docs: DataFrame, key: str, text: str, threshold: float, k: int, bands: int, rows: int) -> DataFrame:
    """A row for each row of ``docs``: ``id, h, class_id, rep_id, n_links, class_size, kept``; h is a hash of the text."""
    ship(docs.sparkSession)
    base = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    texts = base.where("id is not null").select("id", F.xxhash64("text").alias("h"), "text")
    sketch = texts.mapInArrow(_sketch(k, bands, rows), "id long, h long, d1 long, d2 long, size long, keys array<long>")
    # the checkpoint keeps these numbers: every row has one of its own, whatever its key
    sketch = cut(sketch.withColumn("v", F.monotonically_increasing_id()))
    worded = sketch.where("size > 0")
    same = cut(worded.groupBy("d1", "d2").agg(F.min("v").alias("rep"), F.min("id").alias("rep_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies"))
    # a bag of many copies: its one row is sent to its copies' tasks by broadcast while the repeated bags are few
    repeated = F.broadcast(same) if same.count() <= 1_000_000 else same
    members = worded.select("v", "id", "h", "d1", "d2").join(repeated, ["d1", "d2"], "left")
    members = cut(members.select("v", "id", "h", F.coalesce("rep", "v").alias("rep"), F.coalesce("rep_id", "id").alias("rep_id")))
    vertices = members.where("v = rep").select("v", "id", "h")
    banded = worded.select("v", "keys").join(vertices.select("v"), "v").select("v", F.explode("keys").alias("bucket"))
    stars = banded.groupBy("bucket").agg(F.min("v").alias("hub"), F.count("*").alias("n")).where("n > 1")
    spokes = cut(banded.join(stars, "bucket").where("v <> hub").select("bucket", "v", "hub", "n"))
    first = _overlaps(spokes.select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct(), vertices, texts, k)
    linked = first.where(F.col("j") >= threshold).select("a", "b")

    # the other pairs of a bucket: their distances to its hub prove a link, rule it out, or leave it to the bags
    far = 1 - threshold
    placed = spokes.where("n > 2").join(first.select(F.col("a").alias("v"), F.col("b").alias("hub"), (1 - F.col("j")).alias("d")), ["v", "hub"])
    placed = cut(placed.select("bucket", "v", "d", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    one = placed.select("bucket", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), F.col("v").alias("a"), "d")
    two = placed.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("v").alias("b"), F.col("d").alias("d2"))
    met = one.join(two, ["bucket", "block"]).where("a > b")
    met = met.groupBy("a", "b").agg(F.min(F.col("d") + F.col("d2")).alias("most"), F.max(F.abs(F.col("d") - F.col("d2"))).alias("least"))
    met = cut(met.where(F.col("least") <= far + 1e-9).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    # a proved pair's ends are both linked to its hub, so it adds nothing to the classes
    proved = met.where(F.col("most") <= far - 1e-9).select("a", "b")
    open_ = met.where(F.col("most") > far - 1e-9).select("a", "b")
    linked = linked.union(_overlaps(open_, vertices, texts, k).where(F.col("j") >= threshold).select("a", "b"))
    label = components(linked)

    linked = linked.union(proved)
    links = linked.union(linked.select("b", "a")).groupBy("a").agg(F.count("*").alias("n_links"))
    found = links.withColumnRenamed("a", "rep").join(label.select(F.col("id").alias("rep"), "component"), "rep", "full")
    named = members.join(found, "rep", "left")
    named = cut(named.select("v", "id", "h", "rep_id", F.coalesce("component", "rep").alias("class"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    sizes = named.groupBy("class").agg(F.count("*").alias("class_size"), F.min("id").alias("class_id")).where("class_size > 1")
    sizes = F.broadcast(sizes) if sizes.count() <= 1_000_000 else sizes
    full = named.join(sizes, "class", "left").select("id", "h", F.coalesce("class_id", "id").alias("class_id"), "rep_id", "n_links", F.coalesce("class_size", F.lit(1)).alias("class_size"))
    bare = sketch.where("size = 0").select("id", "h", F.col("id").alias("class_id"), F.col("id").alias("rep_id"), F.lit(0).alias("n_links"), F.lit(1).alias("class_size"))
    none = F.lit(None).cast("long")
    keyless = base.where("id is null").select("id", none.alias("h"), none.alias("class_id"), none.alias("rep_id"), F.lit(0).alias("n_links"), F.lit(1).alias("class_size"))
    every = full.unionByName(bare).unionByName(keyless)
    return every.select(
        "id", "h", "class_id", "rep_id", F.col("n_links").cast("long").alias("n_links"), F.col("class_size").cast("long").alias("class_size"),
        (F.col("id").isNull() | (F.col("id") == F.col("class_id"))).alias("kept"),
    )


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """``key, class_id, rep_id, n_links, class_size, kept``: a row for each row of ``docs``.

    ``rep_id`` is the smallest key of those with the same bag, ``class_id`` the smallest key of the class, whose row alone
    is kept. ``n_links`` counts all bags that share a bucket with the row's and are linked to it; copies are not expanded into pairs.
    Texts without a word, null ones too, match nothing, nor do rows with a null key: their ids are null, and they are kept. A
    text of fewer words than ``k`` is one shingle. Rows that repeat a key are rows of their own: each has the class of its
    own text, and if several of a class have its smallest key all of those are kept. An empty table gives no rows. Other
    columns are ignored.
    """
    return _classes(docs, key, text, threshold, k, bands, rows).withColumnRenamed("id", key).drop("h")


def drop_near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, few: int = FEW
) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each class those with its smallest key.

    A row goes by its key and its text, so of rows that repeat a key only those in a class with a smaller key go. Rows with
    a null key or without a word stay. Rows that go are left out where they are read, whatever their number (``drop_rows``).
    An empty table gives no rows.
    """
    gone = cut(_classes(docs, key, text, threshold, k, bands, rows).where("not kept").select(F.col("id").alias("_gone"), F.col("h").alias("_text")).distinct())
    # the text's hash is a condition beside the key of the join: it is made for rows of such a key alone
    def match(rows: DataFrame) -> Column:
        h = F.xxhash64(F.coalesce(rows[text], F.lit("")))
        return (rows[key].cast("long") == gone["_gone"]) & (h <= gone["_text"]) & (h >= gone["_text"])

    return drop_rows(docs, gone, match, [key, text], few)
