"""Loading records by suffix: JSON, JSON lines, CSV, SQLite, Markdown tables, text records; images for hashing."""

from __future__ import annotations

import re
import sqlite3
import uuid
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.session import ship

WRAPPERS = tuple("data items results records list".split())


def load(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; an unknown one is JSON."""
    kind = {".jsonl": load_jsonl, ".csv": load_csv, ".db": load_sqlite, ".sqlite": load_sqlite, ".md": load_markdown, ".txt": load_txt}
    return kind.get(PurePosixPath(path).suffix.lower(), load_json)(spark, path)


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, or one record."""
    return spark.read.option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_wrapped_json(spark: SparkSession, path: str) -> DataFrame:
    """As above; a record that holds a list under the first of ``WRAPPERS`` that is one stands for that list."""
    df = load_json(spark, path)
    for name in WRAPPERS:
        if name in df.columns and isinstance(df.schema[name].dataType, T.ArrayType):
            inner = df.select(F.explode(name).alias("r"))
            return inner.select("r.*") if isinstance(inner.schema["r"].dataType, T.StructType) else inner
    return df


def load_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A record a line; blank lines are passed over, and one bad line fails the whole."""
    return spark.read.option("mode", "FAILFAST").json(path)


def load_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=delimiter, inferSchema=False)
    return df.toDF(*[c.removeprefix("﻿") for c in df.columns])


class _Rows(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        super().__init__(None)
        self.low, self.high = low, high


class _SQLiteReader(DataSourceReader):
    def __init__(self, path: str, name: str, parts: int) -> None:
        self.path, self.name, self.parts = path, name, parts

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(self.path) as con:
            low, high = con.execute(f'SELECT min(rowid), max(rowid) FROM "{quoted(self.name)}"').fetchone()
        if low is None:
            return [_Rows(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Rows(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        con = sqlite3.connect(self.path)
        for row in con.execute(f'SELECT * FROM "{quoted(self.name)}" WHERE rowid >= ? AND rowid < ? ORDER BY rowid', (partition.low, partition.high)):
            yield tuple(None if v is None else v.decode() if isinstance(v, bytes) else str(v) for v in row)
        con.close()


class SQLiteSource(DataSource):
    """The first table of a SQLite file, or ``table``, read by row ranges; all columns are text."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite"

    def _table(self) -> str:
        if "table" in self.options:
            return self.options["table"]
        with sqlite3.connect(self.options["path"]) as con:
            found = con.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY rowid").fetchone()
        return found[0] if found else ""

    def schema(self) -> T.StructType:
        with sqlite3.connect(self.options["path"]) as con:
            return T.StructType([T.StructField(r[1], T.StringType()) for r in con.execute(f'PRAGMA table_info("{quoted(self._table())}")')])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _SQLiteReader(self.options["path"], self._table(), int(self.options.get("partitions", 8)))


def quoted(name: str) -> str:
    return name.replace('"', '""')


def load_sqlite(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """An empty file gives no rows."""
    ship(spark)
    with sqlite3.connect(path) as con:
        if table is None and not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table'").fetchone():
            return spark.createDataFrame([], T.StructType([]))
    spark.dataSource.register(SQLiteSource)
    reader = spark.read.format("tidemark_sqlite").option("path", path)
    return (reader.option("table", table) if table else reader).load()


def load_markdown(spark: SparkSession, path: str) -> DataFrame:
    """A pipe table; bars that are escaped belong to their cell, and short rows end in nulls."""
    lines = spark.read.text(path, wholetext=False).select(F.trim("value").alias("v")).where(F.col("v").startswith("|"))
    cells = F.transform(F.split(F.regexp_replace("v", r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))
    rows = lines.where(~F.col("v").rlike(r"^\|(?:\s*:?-+:?\s*\|?)+$")).select(cells.alias("c"), F.monotonically_increasing_id().alias("o"))
    head = rows.orderBy("o").limit(1).collect()
    if not head:
        return spark.createDataFrame([], T.StructType([]))
    names = head[0]["c"]
    body = rows.where(F.col("o") > head[0]["o"])
    return body.select(*[F.try_element_at("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def parse_records(text: str) -> list[dict[str, str]]:
    """``key: value`` blocks between lines of ten or more equals signs; other lines go on with the value before."""
    out = []
    for block in re.split(r"(?m)^={10,}\s*$", text):
        record: dict[str, str] = {}
        key = None
        for line in block.split("\n"):
            m = re.match(r"([^\s:：][^:：]*)[:：]\s?(.*)", line)
            if m:
                key = m[1].strip()
                record[key] = m[2].strip()
            elif key and line.strip():
                record[key] = f"{record[key]}\n{line.strip()}" if record[key] else line.strip()
        if record := {k: v for k, v in record.items() if v}:
            out.append(record)
    return out


#: How a line between records begins; files are split at it.
BETWEEN = "\n" + "=" * 10
_BETWEEN = re.compile(r"=*\s*$", re.M)


def load_txt(spark: SparkSession, path: str) -> DataFrame:
    """Text records as columns of the union of their keys; a key without a value is left out.

    Files are split where a line begins with ten equals signs, so a task holds some records and not a file. Where such a
    line goes on with something else it is no line between records, and those files are read whole.
    """
    ship(spark)

    @F.udf("array<map<string,string>>")
    def split(text):
        return parse_records(text or "")

    @F.udf("array<map<string,string>>")
    def rest(text):
        # what is behind the split: the rest of the line between records, but in the first part of a file
        m = _BETWEEN.match(text or "")
        return parse_records(text[m.end() :] if m else text or "")

    parts = spark.read.option("lineSep", BETWEEN).text(path)
    odd = spark.read.option("lineSep", "\n").text(path).where(F.col("value").rlike(r"^={10}") & ~F.col("value").rlike(r"^=+\s*$"))
    records = spark.read.text(path, wholetext=True).select(F.explode(split("value")).alias("r")) if not odd.isEmpty() else parts.select(F.explode(rest("value")).alias("r"))
    # as many names as the records have keys
    names = [r["k"] for r in records.select(F.explode(F.map_keys("r")).alias("k")).groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").collect()]
    return records.select(*[F.col("r")[n].alias(n) for n in names])


def sniff(spark: SparkSession, path: str) -> DataFrame | None:
    """JSON where the first character says so; else None."""
    first = spark.read.text(path, wholetext=True).select(F.substring(F.ltrim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("c")).first()
    return load_wrapped_json(spark, path) if first and first["c"] in ("[", "{") else None


def load_jdbc(spark: SparkSession, url: str, table: str, **properties: str) -> DataFrame:
    """A table of a database. One of text in an embedded Derby is exported into the shared folder, as executors can't open it."""
    from tidemark.sources import writers

    found = spark.read.format("jdbc").options(**properties).option("url", url).option("dbtable", table).load()
    if not writers.embedded(url):
        return found
    path, null = f"{writers.mounted(spark, 'jdbc')}.csv", uuid.uuid4().hex  # with a mark of our own, an empty text in quotes isn't null
    writers.call(spark, url, "SYSCS_EXPORT_QUERY", f"SELECT * FROM {table}", path, ",", '"', "UTF-8")
    return spark.read.schema(found.schema).csv(f"file://{path}", multiLine=True, escape='"', lineSep="\n", nullValue=null, mode="FAILFAST")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files with their bytes, for a hash made by the caller's function."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,jpg,jpeg,gif,webp,bmp}").load(path)
