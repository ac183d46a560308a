"""Version strings as comparable structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("alpha", "beta", "rc", "final")
_NUMBERS = r"(\d{1,9})\.(\d{1,9})\.(\d{1,9})"
PYTHON = rf"(?i)python-{_NUMBERS}(?:(rc|a|b)(\d{{1,9}}))?"
GENERIC = rf"(?i)v?{_NUMBERS}(?:[ ._-]?(beta|alpha|rc|r|b|a)[ ._-]?(\d{{1,9}}))?"


def _struct(c: Column, pattern: str) -> Column:
    part = [F.regexp_extract(c, pattern, i) for i in range(1, 6)]
    stage = F.lower(part[3])
    rank = F.when(stage == "", 3).when(stage.startswith("a"), 0).when(stage.startswith("b"), 1).otherwise(2)
    number = [F.try_to_number(p, F.lit("999999999")).cast("int") for p in part]
    value = F.struct(
        number[0].alias("major"), number[1].alias("minor"), number[2].alias("patch"), rank.alias("stage_rank"), F.coalesce(F.when(part[4] != "", number[4]), F.lit(0)).alias("stage_num")
    )
    return F.when(c.rlike(pattern), value)


def parse_python_version(c: Column) -> Column:
    """``python-X.Y.Z`` with an optional a, b or rc number: struct<major, minor, patch, stage_rank, stage_num> or null."""
    return _struct(c, PYTHON)


def parse_version(c: Column) -> Column:
    """The form above, else any X.Y.Z with an optional stage."""
    return F.coalesce(_struct(c, PYTHON), _struct(c, GENERIC))


def is_stable(v: Column) -> Column:
    return v["stage_rank"] == 3


def format_version(v: Column) -> Column:
    """X.Y.Z, with a, b or rc and its number unless final."""
    mark = F.element_at(F.array(*map(F.lit, ("a", "b", "rc", ""))), v["stage_rank"] + 1)
    shown = F.concat(F.concat_ws(".", v["major"], v["minor"], v["patch"]), F.when(v["stage_rank"] < 3, F.concat(mark, v["stage_num"])).otherwise(F.lit("")))
    return F.when(v.isNotNull(), shown)


def latest_version(df: DataFrame, text: str, order: str) -> DataFrame:
    """The row of the highest version, the first by ``order`` of equal ones; no row where no text has one."""
    v = parse_version(F.col(text))
    best = F.max_by(F.struct(F.col(text).alias("text"), v.alias("v")), F.struct(v.alias("v"), (-F.col(order)).alias("o")))
    found = df.where(v.isNotNull()).agg(best.alias("b"))
    return found.where("b is not null").select(F.col("b.text").alias("text"), format_version(F.col("b.v")).alias("version"))
