"""Views on the driver's tables and the flagship plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import clean, dedup
from tidemark.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as crawled items: ``ord, url, title, text, lang, source``."""
    d = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang")
    return d.select(F.col("doc_id").alias("ord"), url.alias("url"), F.concat_ws(" ", "source", "lang").alias("title"), "text", "lang", "source")


def kept_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean, score, filter and dedup the documents: by language what is kept, its characters and mean score in hundredths.

    Texts are looked at once, where they are read: the generator keeps the filter on the score from being pushed into
    them. Narrow rows go on.
    """
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    cleaned = d.select("doc_id", "lang", X.normalize_whitespace(X.fix_encoding(F.col("text"))).alias("text"))

    def seen(t: Column) -> Column:
        return F.struct(F.length(t).alias("chars"), X.quality_tenths(t).alias("tenths"), F.when(t != "", X.content_key(t)).alias("key"))

    narrow = cleaned.select("doc_id", "lang", F.inline(F.transform(F.array("text"), seen))).where("tenths >= 3")
    kept = dedup.winners(narrow, "key", "doc_id")
    return kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("chars").alias("chars"), F.sum((F.col("tenths") * 10).cast("long")).alias("score_hundredths"))


__all__ = ["clean", "items", "kept_by_language", "table"]
