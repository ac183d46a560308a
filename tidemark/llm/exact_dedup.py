"""Exact dedup with a heavy-hitter split.

Misra-Gries summaries of the digests, one per partition, name every digest that may be frequent. Those candidates are
counted exactly and their winners broadcast (at most ``counters`` rows), so that frequent digests are settled on the map
side and never meet in one task. All other digests go through one ordinary shuffle of narrow rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.rows import FEW, drop_rows
from tidemark.session import cut, ship


def misra_gries(keys: np.ndarray, counters: int, start: dict[int, int] | None = None) -> dict[int, int]:
    """Misra-Gries with ``counters`` counters over a block of keys.

    A key of more than n / (counters + 1) of all n keys always stays; each count is low by at most n / (counters + 1).
    """
    held = dict(start or {})
    values, counts = np.unique(keys, return_counts=True)
    for v, c in zip(values.tolist(), counts.tolist()):
        held[v] = held.get(v, 0) + c
    if len(held) > counters:
        # subtracting the (counters + 1)-th largest count is that many rounds of decrements at once
        least = sorted(held.values(), reverse=True)[counters]
        held = {k: c - least for k, c in held.items() if c > least}
    return held


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for batch in batches:
            held = misra_gries(batch.column(0).to_numpy(zero_copy_only=False), counters, held)
        yield pa.RecordBatch.from_pydict({"h": pa.array(list(held), pa.int64()), "c": pa.array(list(held.values()), pa.int64())})

    return run


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = 1024) -> DataFrame:
    """One row per input row: ``key, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are; a null text is an empty one. Of equal texts the row with the largest key
    stays; a null key is smaller than any number, and rows that repeat both key and text are all the row that stays. An
    empty table gives no rows. Other columns are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    rows = cut(
        docs.select(F.col(key).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)).alias("d"))
    ).withColumn("h", F.xxhash64("d"))

    # Of N rows a digest held by 2 N / counters of them sums to N / counters or more over the summaries, and at most
    # ``counters`` digests can, as no sum is above the true count: the largest sums hold every heavy hitter.
    named = rows.select("h").mapInArrow(_summaries(counters), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    named = cut(named.orderBy(F.desc("c"), "h").limit(counters).select("h"))
    exact = rows.join(F.broadcast(named), "h").groupBy("d").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # winners proven frequent; ties of the 64-bit hash are told apart here, where the whole digest is the key
    winners = cut(exact.where("group_size > 1").orderBy(F.desc("group_size"), "d").limit(counters).select("d", "keep_id", "group_size"))

    settled = rows.join(F.broadcast(winners), "d", "left")
    hot = settled.where("group_size is not null").select("id", "d", "keep_id", "group_size")
    rest = settled.where("group_size is null").select("id", "d")
    groups = rest.groupBy("d").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    cold = rest.join(groups, "d").select("id", "d", "keep_id", "group_size")
    both = hot.unionByName(cold)
    return both.select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("d")).alias("text_sha256")
    )


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", counters: int = 1024, few: int = FEW) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one of each text, that with the largest key.

    A null text is an empty one, and a null key is smaller than any number. Of rows that share the largest key too one
    stays, picked by a hash of all its columns. Rows that go are left out where they are read, whatever their number
    (``drop_rows``). An empty table gives no rows.
    """
    found = exact_dedup(docs, key, text, counters).where("group_size > 1")
    groups = found.groupBy(F.col(key).alias("_key"), F.unhex("text_sha256").alias("_d")).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    groups = cut(groups.where("not kept or n > 1"))
    gone = groups.where("not kept").select(F.col("_key").alias("_gone"), "_d")
    # the digest is a condition beside the key of the join: it is made for rows of such a key alone
    def digest(rows: DataFrame) -> Column:
        return F.unhex(F.sha2(F.coalesce(rows[text], F.lit("")).cast("binary"), 256))

    def match(rows: DataFrame) -> Column:
        return rows[key].cast("long").eqNullSafe(gone["_gone"]) & (digest(rows) <= gone["_d"]) & (digest(rows) >= gone["_d"])

    rest = drop_rows(docs, gone, match, [key, text], few)
    twins = groups.where("kept")
    n = twins.count()
    if not n:
        return rest
    # rows that repeat both key and text
    twins = twins.select(F.col("_key").alias("_twin"), F.col("_d").alias("_t"))
    twins = F.broadcast(twins) if n <= 1_000_000 else twins
    same = rest[key].cast("long").eqNullSafe(twins["_twin"]) & (digest(rest) <= twins["_t"]) & (digest(rest) >= twins["_t"])
    whole = F.struct(*[rest[c] for c in docs.columns])
    picked = rest.join(twins, same).groupBy("_twin", "_t").agg(F.min_by(whole, F.xxhash64(whole)).alias("_row")).select("_row.*")
    return rest.join(twins, same, "left_anti").unionByName(picked)
