"""The document pipeline: quality, exact dedup, near-dedup, decontamination, mixing.

Each stage takes the documents its predecessor kept, is written as Parquet and read again. All but the last return the
columns of ``documents``; the last returns them too, with how often each document is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._tables import read
from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import drop_exact_duplicates
from tidemark.llm.mixing import take_mix
from tidemark.llm.near_dedup import drop_near_duplicates
from tidemark.llm.quality import filter_quality
from tidemark.session import discard, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts get the score of no features; repeated rows go or stay alike."""
    return filter_quality(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, that with the largest doc_id. Null texts are empty ones; of repeated rows one stays."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the documents with its smallest doc_id. Texts without a word and null doc_ids stay."""
    return drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows go or stay alike."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``, ``size``, ``source_size``, ``target`` and ``taken``, each judged by its own text and source."""
    return take_mix(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminated), ("mix", mixed)]

#: Two of the stages rest on a trained model and on signatures, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a stage wrote goes once the next has."""
    folder, last = scratch(spark, "pipeline"), None
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            discard(spark, last)
        last = f"{folder}/{name}"
    return docs
