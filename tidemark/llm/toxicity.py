"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; a sample of all texts, whose labels are never looked at, is the unlabelled set.
A linear classifier over word n-gram indicators is trained in numpy by the risk estimator that corrects the unlabelled
texts by the class prior and keeps that part of the risk from going negative.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _features as features
from tidemark.llm import linear
from tidemark.llm._bytes import slices, text_buffers
from tidemark.session import cut, ship

GRAMS = {"word_grams": (1,), "heads": (4, 5, 6, 8), "bits": 28}


def feature_rows(grams: dict):
    """mapInArrow function: (id, text) to (id, distinct features as 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            out = []
            for i, j in slices(off):
                row, f = features.indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i], **grams)
                out += [x.astype(np.int32).tobytes() for x in linear.split_rows(row, f, j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "features"])

    return run


def scorer(model, grams: dict):
    """mapInArrow function: (id, text) to (id, score); ``model`` is a broadcast of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = text_buffers(batch.column(1))
            scores = [np.zeros(0)]
            for i, j in slices(off):
                row, f = features.indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i], **grams)
                scores.append(linear.apply(model.value, row, f, j - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores), pa.float64())], names=["id", "score"])

    return run


def sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, the lowest by a hash of ``id`` and the seed: the same rows in every run."""
    return rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, features) to a count by feature of both kinds, for each batch of the sample."""
    for batch in batches:
        kind = batch.column(0).to_numpy(zero_copy_only=False)
        rows = [np.frombuffer(x, np.int32) for x in batch.column(1).to_pylist()]
        if not rows:
            continue
        ids, place = np.unique(np.concatenate(rows), return_inverse=True)
        of = np.repeat(kind, [len(r) for r in rows])
        both = [np.bincount(place, of == k, minlength=len(ids)).astype(np.int64) for k in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(both[0]), pa.array(both[1])], names=["feature", "p", "u"])


def _held(known: np.ndarray):
    """mapInArrow function: (positive, id, features) to the places of the known features a text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2).to_pylist():
                f = np.frombuffer(x, np.int32)
                at = np.minimum(np.searchsorted(known, f), len(known) - 1)
                out.append(at[known[at] == f].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["positive", "id", "held"])

    return run


def fit_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], known: np.ndarray, prior: float, seed: int = 0) -> dict:
    """Fit on the places in ``known`` of the features that each text has."""
    base = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else -4.0
    if not positive or not unlabelled or not 0 < prior < 1 or not len(known):
        return {"known": np.zeros(0, np.int64), "weights": np.zeros(1), "bias": base, "slope": 1.0, "offset": 0.0}

    def dense(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(known)), np.float32)
        for i, f in enumerate(rows):
            out[i, f] = 1
        return out

    a, b = dense(positive), dense(unlabelled)
    w = linear.nn_pu(a, b, prior, seed=seed)
    # the non-negative risk keeps margins small; the same corrected risk says how sure each is
    slope, offset = linear.pu_platt(a @ w[:-1] + w[-1], b @ w[:-1] + w[-1], prior)
    return {"known": known, "weights": w[:-1], "bias": float(w[-1]), "slope": slope, "offset": offset}


def train_toxicity(
    docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text",
    most_positive: int = 5000, most_unlabelled: int = 12000, most_features: int = 600, least: int = 5, least_z: float = 5.0, seed: int = 4,
) -> dict:
    """Train on at most ``most_positive`` confirmed toxic texts and ``most_unlabelled`` others, of the learnable rows only.

    ``learnable`` is a condition on the column ``id``. The class prior is the share of toxic among their labels. The
    features kept are the ``most_features`` whose rates differ most between both samples, and by ``least_z`` deviations.
    """
    ship(docs.sparkSession)
    usable = labels.select(F.col(key).alias("id"), F.col("toxic").alias("y")).where("y is not null and id is not null").where(learnable)
    counts = usable.agg(F.count("*").alias("n"), F.sum("y").alias("k")).first()
    prior = (counts["k"] or 0) / max(1, counts["n"])
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where(learnable)
    some = sample(usable.where("y = 1").select("id").distinct(), most_positive, seed).withColumn("positive", F.lit(1))
    others = sample(texts.select("id").where("id is not null").distinct(), most_unlabelled, seed + 1).withColumn("positive", F.lit(0))
    chosen = cut(some.union(others))  # a bounded number of ids
    rows = texts.join(F.broadcast(chosen.select("id").distinct()), "id").mapInArrow(feature_rows(GRAMS), "id long, features binary")
    rows = cut(rows.join(F.broadcast(chosen), "id").select("positive", "id", "features"))
    size = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n, m = max(1, size.get(1, 0)), max(1, size.get(0, 0))
    found = rows.select("positive", "features").mapInArrow(_counts, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    pooled = (F.col("p") + F.col("u")) / (n + m)
    z = F.abs(F.col("p") / n - F.col("u") / m) / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / n + 1 / m))
    # beyond what chance makes of so many features
    top = found.where(F.col("p") + F.col("u") >= least).withColumn("z", z).where(F.col("z") >= least_z).orderBy(F.desc("z"), "feature").limit(most_features)
    known = np.sort(np.array([r["feature"] for r in top.collect()], np.int64))
    kept: dict[int, list[np.ndarray]] = {1: [], 0: []}
    if len(known):
        got = rows.mapInArrow(_held(known), "positive int, id long, held binary").collect()
        for r in sorted(got, key=lambda r: (r["id"], bytes(r["held"]))):
            kept[r["positive"]].append(np.frombuffer(r["held"], np.int32))
    return fit_pu(kept[1], kept[0], known, prior, seed=seed)


def score_toxicity(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` per row; the whole text is looked at. A null or empty text gets the score of no features."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scorer(sent, GRAMS), "id long, score double").withColumnRenamed("id", key)


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.7, folds: int = 3, held: int = 1) -> DataFrame:
    """``key, held_out, score, predicted`` per row of ``docs``.

    Labels of rows whose crc32(key as text) mod ``folds`` is ``held`` are never read. Rows with a null key are scored, not
    held out and not learned from; null labels are left out, and of repeated label rows each counts. With no toxic label
    all scores are one low number. An empty table gives no rows. Other columns are ignored.
    """
    fold = F.crc32(F.col("id").cast("string")) % folds
    model = train_toxicity(docs, labels, fold != held, key, text)
    scores = score_toxicity(docs, model, key, text)
    out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))
    return scores.select(key, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
