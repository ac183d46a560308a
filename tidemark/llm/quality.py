"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Each indicator is scaled by its class log-count ratio; a linear hinge-loss model is fitted on top by dual coordinate
descent, and its margins, taken from held-out folds of the sample, are mapped to scores by a sigmoid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _features as features
from tidemark.llm import linear
from tidemark.llm.toxicity import feature_rows, sample, scorer
from tidemark.session import ship

GRAMS = {"word_grams": (1,), "shape_grams": (1, 2, 4), "runs": (2, 3, 4, 6)}


def train_quality(docs: DataFrame, labels: DataFrame, learnable: Column, key: str = "doc_id", text: str = "text", most: int = 8000, seed: int = 7) -> dict:
    """Fit on at most ``most`` labelled texts, picked by a hash of the key among the learnable rows."""
    ship(docs.sparkSession)
    usable = labels.select(F.col(key).alias("id"), F.col("quality").alias("y")).where("y is not null and id is not null").where(learnable)
    chosen = sample(usable.groupBy("id").agg(F.max("y").alias("y")), most, seed)
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(chosen.select("id")), "id").mapInArrow(feature_rows(GRAMS), "id long, features binary")
    found = sorted(rows.collect(), key=lambda r: (r["id"], bytes(r["features"])))
    y = {r["id"]: r["y"] for r in chosen.collect()}
    return linear.nb_svm([np.frombuffer(r["features"], np.int32) for r in found], np.array([y[r["id"]] for r in found], np.int64), 1 << features.BITS, seed=seed)


def score_quality(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` per row; the whole text is looked at. A null or empty text gets the score of no features."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(scorer(sent, GRAMS), "id long, score double").withColumnRenamed("id", key)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """``key, held_out, score, predicted`` per row of ``docs``.

    Labels of rows whose crc32(key as text) mod ``folds`` is ``held`` are never read. Rows with a null key are scored, not
    held out and not learned from; null labels are left out; repeated label rows count once, as the larger label. With
    labels of one class all scores are its smoothed share. An empty table gives no rows. Other columns are ignored.
    """
    model = train_quality(docs, labels, F.crc32(F.col("id").cast("string")) % folds != held, key, text)
    scores = score_quality(docs, model, key, text)
    out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))
    return scores.select(key, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns: scored and filtered in one pass, with no join.

    Each row is judged by its own whole text, so repeated rows and ties go or stay alike. A null or empty text gets the score
    of no features, null keys are scored as others are, and other columns, whatever their names, come along. An empty table
    gives no rows; with no label to learn from all rows have the same score.
    """
    spark = docs.sparkSession
    model = train_quality(docs, labels, F.crc32(F.col("id").cast("string")) % folds != held, key, text)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def keep(batches):
        score = scorer(sent, GRAMS)
        for batch in batches:
            column = batch.column(at)
            (scored,) = score([pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], names=["id", "text"])])
            yield batch.filter(pa.array(scored.column(1).to_numpy() >= threshold))

    return docs.mapInArrow(keep, docs.schema)
