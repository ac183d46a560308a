"""Saving records: JSON, JSON lines, CSV, SQLite, Markdown, text, DOCX, XLSX, JDBC; reports and state.

Formats of one file are made by all executors, as parts in the shared folder, which the driver puts together in the rows'
order and in bounded memory; what Spark leaves as parts (``spark_*``) is for large data.
"""

from __future__ import annotations

import csv
import datetime
import io
import itertools
import json
import logging
import os
import shutil
import sqlite3
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import BinaryIO
from xml.sax.saxutils import escape

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.operators.clean import auto_format, project
from tidemark.session import cut, discard, scratch, ship
from tidemark.sources.readers import quoted

log = logging.getLogger(__name__)
SUFFIX = {name: f".{name}" for name in ("csv", "docx", "json", "jsonl", "txt")} | dict(excel=".xlsx", markdown=".md", sqlite=".db")
BY_SUFFIX = {v: k for k, v in SUFFIX.items()} | {".sqlite": "sqlite", ".tsv": "csv"}
#: What is tried after a format that failed.
FALLBACK = {"docx": ("markdown", "txt", "json"), "markdown": ("txt", "json"), "excel": ("csv", "json"), "csv": ("json",), "sqlite": ("json",), "txt": ("json",)}


def _stage(folder: str, form: Callable[[Iterator[dict], int], Iterator[str]], before: dict[int, int]):
    """For ``mapPartitionsWithIndex``: a partition as text in a file of its own; its number, the file and its rows come back."""

    def run(index: int, rows: Iterator) -> Iterator[tuple[int, str, int]]:
        fs, base = pafs.FileSystem.from_uri(folder)
        name, n = f"{base}/{uuid.uuid4().hex}", 0

        def seen() -> Iterator[dict]:
            nonlocal n
            for n, r in enumerate(rows, 1):
                yield r.asDict(recursive=True)

        with fs.open_output_stream(name, buffer_size=1 << 20) as f:
            for line in form(seen(), before.get(index, 0) + 1):
                f.write(line.encode())
        yield index, name, n

    return run


class _Parts:
    """Rows as text, formatted by all executors into the shared folder; the driver only copies bytes, in the rows' order.

    ``form`` gets a partition's rows and, if they are ``numbered``, the number of its first; those are cut for that.
    """

    def __init__(self, df: DataFrame, form: Callable[[Iterator[dict], int], Iterator[str]], numbered: bool = False) -> None:
        spark = df.sparkSession
        ship(spark)
        before: dict[int, int] = {}
        if numbered:
            df, n = cut(df), 0
            for i, k in sorted(tuple(r) for r in df.groupBy(F.spark_partition_id()).count().collect()):  # a row a partition
                before[i], n = n, n + k
        self.spark, self.folder = spark, scratch(spark, "parts")
        self.fs, base = pafs.FileSystem.from_uri(self.folder)
        self.fs.create_dir(base, recursive=True)
        self.done = sorted(df.rdd.mapPartitionsWithIndex(_stage(self.folder, form, before)).collect())  # a row a partition
        self.rows = sum(n for _, _, n in self.done)

    def into(self, f: BinaryIO, skip: int = 0) -> int:
        """The parts behind what is in the file, but for their first ``skip`` bytes; how many rows there are."""
        for _, name, n in self.done:
            with self.fs.open_input_stream(name) as part:
                if n and skip:
                    part.read(skip)
                    skip = 0
                shutil.copyfileobj(part, f, 1 << 20)
        discard(self.spark, self.folder)
        return self.rows


def _text(v) -> str | None:
    if v is None or isinstance(v, str):
        return v
    return json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, (dict, list)) else str(v)


def write_json(df: DataFrame, path: str, ensure_ascii: bool = False) -> int:
    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        return (",\n" + json.dumps(row, ensure_ascii=ensure_ascii, indent=2, default=str) for row in rows)

    with Path(path).open("wb") as f:
        f.write(b"[")
        n = _Parts(df, form).into(f, skip=1)
        f.write(b"\n]" if n else b"]")
    return n


def write_jsonl(df: DataFrame, path: str, ensure_ascii: bool = False) -> int:
    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        return (json.dumps(row, ensure_ascii=ensure_ascii, default=str) + "\n" for row in rows)

    with Path(path).open("wb") as f:
        return _Parts(df, form).into(f)


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> int:
    def line(values: list) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter=delimiter).writerow(values)
        return out.getvalue()

    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        return (line([_text(v) for v in row.values()]) for row in rows)

    with Path(path).open("wb") as f:
        f.write(line(df.columns).encode("utf-8-sig"))
        return _Parts(df, form).into(f)


def write_sqlite(df: DataFrame, path: str, table: str = "data", mode: str = "overwrite", batch: int = 1000) -> int:
    """All columns as text. The rows of a write go in as one transaction, as the JSON arrays that the executors made of them."""

    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        return (json.dumps([_text(v) for v in row.values()]) + "\n" for row in rows)

    parts = _Parts(df, form)
    names = ", ".join(f'"{quoted(c)}" TEXT' for c in df.columns)
    con = sqlite3.connect(path)
    with con:
        if mode == "overwrite":
            con.execute(f'DROP TABLE IF EXISTS "{quoted(table)}"')
        con.execute(f'CREATE TABLE IF NOT EXISTS "{quoted(table)}" ({names})')
        cols, marks = ", ".join(f'"{quoted(c)}"' for c in df.columns), ", ".join("?" * len(df.columns))
        for _, name, _ in parts.done:
            with parts.fs.open_input_stream(name) as f:
                lines = io.BufferedReader(f)
                while part := [json.loads(x) for x in itertools.islice(lines, batch)]:
                    con.executemany(f'INSERT INTO "{quoted(table)}" ({cols}) VALUES ({marks})', part)
    con.close()
    discard(parts.spark, parts.folder)
    return parts.rows


def _cell(v) -> str:
    return ("" if v is None else _text(v)).translate({ord("|"): "\\|", ord("\n"): " ", ord("\r"): ""})


def write_markdown(df: DataFrame, path: str, index: list[dict] | None = None) -> int:
    """As an article where the first row is one and there are ten or fewer, else as a table; then the index of files."""
    first, n = df.limit(11).collect(), 0

    def form(rows: Iterator[dict], at: int) -> Iterator[str]:
        return ("| " + " | ".join(_cell(v) for v in row.values()) + " |\n" for row in rows)

    with Path(path).open("wb") as f:
        if first and len(first) <= 10 and "title" in df.columns and "text" in df.columns and (first[0]["title"] or "").strip() and len(first[0]["text"] or "") > 200:
            for n, r in enumerate(first, 1):
                row = r.asDict(recursive=True)
                f.write(f"# {row.pop('title') or ''}\n\n".encode())
                body = row.pop("text") or ""
                f.write("".join(f"- **{k}**: {_cell(v)}\n" for k, v in row.items() if v not in (None, "", [], {})).encode())
                f.write(f"\n{body}\n\n---\n\n".encode())
        elif first:
            f.write(("| " + " | ".join(_cell(c) for c in df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |\n").encode())
            n = _Parts(df, form).into(f)
        if index:
            f.write(b"\n## Files\n\n| filename | url | local_path |\n| --- | --- | --- |\n")
            f.write("".join(f"| {_cell(x.get('filename'))} | {_cell(x.get('url'))} | {_cell(x.get('local_path'))} |\n" for x in index).encode())
        if not first and not index:
            f.write(b"\n")
    return n


def write_sections(df: DataFrame, path: str, clock: Callable[[], datetime.datetime] = datetime.datetime.now) -> int:
    """A section a record, under a heading with the time."""

    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        for n, row in enumerate(rows, first):
            yield f"\n## {row.get('title') or f'Record {n}'}\n\n" + "".join(f"- **{k}**: {_cell(v)}\n" for k, v in row.items() if k != "title")

    with Path(path).open("wb") as f:
        f.write(f"# Export\n\n{clock().isoformat(' ', 'seconds')}\n".encode())
        return _Parts(df, form, numbered=True).into(f)


def write_txt(df: DataFrame, path: str) -> int:
    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        for row in rows:
            for k, v in row.items():
                shown = "(空)" if v is None else json.dumps(v, ensure_ascii=False, indent=2, default=str) if isinstance(v, (dict, list)) else v
                yield f"{k}: {shown}\n"
            yield "=" * 60 + "\n"

    with Path(path).open("wb") as f:
        return _Parts(df, form).into(f)


_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{0}</Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{0}" Target="{1}"/></Relationships>'


def _safe(s: str) -> str:
    return escape("".join(c for c in s if c in "\t\n\r" or ord(c) >= 32))


def write_docx(df: DataFrame, path: str) -> int:
    """A heading, a line of details and the paragraphs of each record."""

    def paragraph(text: str, style: str = "") -> str:
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{_safe(text)}</w:t></w:r></w:p>'

    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        for n, row in enumerate(rows, first):
            body = row.pop("text", None)
            yield paragraph(str(row.pop("title", None) or f"Record {n}"), "Heading1")
            yield paragraph("; ".join(f"{k}: {_text(v)}" for k, v in row.items() if v not in (None, "")), "")
            yield from (paragraph(part.strip()) for part in (body or "").split("\n\n") if part.strip())

    parts = _Parts(df, form, numbered=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES.format('<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'))
        z.writestr("_rels/.rels", _RELS.format("officeDocument", "word/document.xml"))
        with z.open("word/document.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>')
            parts.into(f)
            f.write(b"</w:body></w:document>")
    return parts.rows


def _column(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def write_excel(df: DataFrame, path: str) -> int:
    """One sheet with a header; numbers as numbers, nested values as JSON."""

    def row(k: int, values: list) -> str:
        cells = []
        for i, v in enumerate(values):
            at = f"{_column(i)}{k}"
            if isinstance(v, (int, float)) and not isinstance(v, bool):
                cells.append(f'<c r="{at}"><v>{v}</v></c>')
            elif v is not None:
                cells.append(f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{_safe(_text(v) or "")}</t></is></c>')
        return f'<row r="{k}">{"".join(cells)}</row>'

    def form(rows: Iterator[dict], first: int) -> Iterator[str]:
        return (row(n + 1, list(r.values())) for n, r in enumerate(rows, first))

    parts = _Parts(df, form, numbered=True)

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        z.writestr("[Content_Types].xml", _TYPES.format(f'<Override PartName="/xl/workbook.xml" ContentType="{kind}sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}worksheet+xml"/>'))
        z.writestr("_rels/.rels", _RELS.format("officeDocument", "xl/workbook.xml"))
        z.writestr("xl/_rels/workbook.xml.rels", _RELS.format("worksheet", "worksheets/sheet1.xml"))
        z.writestr("xl/workbook.xml", '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(b'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + row(1, df.columns).encode())
            parts.into(f)
            f.write(b"</sheetData></worksheet>")
    return parts.rows


def embedded(url: str) -> bool:
    """A Derby database inside a JVM, here the driver's: other JVMs can't open it."""
    return url.startswith("jdbc:derby:") and not url.startswith("jdbc:derby://")


def mounted(spark, name: str) -> str:
    """A new folder name in the shared folder as a path, which must be mounted as files."""
    folder = scratch(spark, name)
    if not folder.startswith(("file:", "/")):
        raise ValueError("the shared folder isn't mounted as files")
    return "/" + folder.removeprefix("file:").lstrip("/")


def call(spark, url: str, procedure: str, *args) -> None:
    """A procedure of a Derby database in the driver's JVM."""
    con = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        todo = con.prepareCall(f"CALL SYSCS_UTIL.{procedure}({', '.join('?' * len(args))})")
        for i, v in enumerate(args, 1):
            todo.setInt(i, v) if isinstance(v, int) else todo.setString(i, v)
        todo.execute()
    finally:
        con.close()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 1000, **properties: str) -> None:
    """Appended, all as text, through a driver that the caller's session has.

    All executors write to a server. For an embedded Derby they write files of text into the shared folder, and the
    database in the driver's JVM takes these in; no row goes through Spark's results or the driver's heap.
    """
    flat = df.select(*[(F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c).cast("string")).alias(f.name) for f in df.schema.fields for c in [f"`{f.name}`"]])

    def save(rows: DataFrame) -> None:
        rows.write.mode("append").option("batchsize", batch).options(**properties).format("jdbc").option("url", url).option("dbtable", table).save()

    if not embedded(url):
        save(flat)
        return
    spark = df.sparkSession
    save(spark.createDataFrame([], flat.schema))  # makes the table on the driver; there is no row for an executor to write
    schema, _, name = (x if x.startswith('"') else x.upper() for x in table.rpartition("."))
    folder = mounted(spark, "jdbc")
    cells = [F.coalesce(F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")) for c in flat.columns]
    try:
        flat.select(F.concat_ws(",", *cells).alias("value")).write.text(f"file://{folder}")
        for part in sorted(Path(folder).glob("part-*")):
            if part.stat().st_size:
                call(spark, url, "SYSCS_IMPORT_DATA", schema.strip('"') or None, name.strip('"'), ",".join(flat.columns), None, str(part), ",", '"', "UTF-8", 0)
    finally:
        discard(spark, f"file://{folder}")


def write_mongodb(df: DataFrame, uri: str, database: str, collection: str) -> None:
    """Appended through the MongoDB connector, times as ISO text."""
    times = {f.name: F.date_format(f"`{f.name}`", "yyyy-MM-dd'T'HH:mm:ss") for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    out = df.withColumns(times) if times else df
    out.write.format("mongodb").mode("append").options(**{"connection.uri": uri, "database": database, "collection": collection}).save()


def spark_write(df: DataFrame, path: str, fmt: str = "jsonl", records_per_file: int = 0) -> None:
    """In parts, by all executors: jsonl, csv or parquet."""
    if fmt == "csv":
        nested = {f.name: F.to_json(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))}
        df = df.withColumns(nested) if nested else df
    writer = df.write.mode("overwrite").option("maxRecordsPerFile", records_per_file)
    if fmt == "csv":
        writer.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)  # else blanks at a value's ends are lost
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


WRITERS: dict[str, Callable[[DataFrame, str], int]] = {
    "json": write_json, "jsonl": write_jsonl, "csv": write_csv, "sqlite": write_sqlite, "markdown": write_markdown, "txt": write_txt, "docx": write_docx, "excel": write_excel,
}


def save(df: DataFrame, path: str, fmt: str | None = None, twin: bool = False, order: str | None = None, disabled: tuple[str, ...] = ()) -> str:
    """Save in the format of the suffix, or the one given, or the one that fits; returns the file written.

    A folder gets a name with the time. A format that fails falls back to the next, under that format's own suffix.
    """
    if os.path.isdir(path) or path.endswith(os.sep):
        path = os.path.join(path, f"data_{datetime.datetime.now():%Y%m%d_%H%M%S}")
    suffix = Path(path).suffix.lower()
    kind = BY_SUFFIX.get(suffix)
    if kind is None or kind in disabled:
        kind = fmt if fmt and fmt != "auto" else auto_format(df, order or df.columns[0], disabled=disabled).first()["format"]
    stem = path[: -len(suffix)] if suffix in BY_SUFFIX else path
    Path(path).resolve().parent.mkdir(parents=True, exist_ok=True)
    for name in (kind, *FALLBACK.get(kind, ())):
        target = path if name == BY_SUFFIX.get(suffix) else stem + SUFFIX[name]
        try:
            WRITERS[name](df, target)
            break
        except Exception as e:
            log.warning("%s failed: %s", name, e)
    else:
        raise ValueError(f"nothing could write {path}")
    if twin and not target.endswith(".json"):
        write_json(df, stem + ".json")
    return target


def export(df: DataFrame, path: str, fmt: str | None = None, fields: list[str] | None = None, mapping: dict[str, str] | None = None, delimiter: str = ",", batch_size: int = 1000) -> dict:
    """Projected, renamed and written by format or suffix (JSON by default).

    Returns the path, the format, the count, the batches of ``batch_size`` that JSON lines, CSV and SQLite take when there
    are more rows than that (1 for the others), and the errors.
    """
    kind = fmt or BY_SUFFIX.get(Path(path).suffix.lower(), "json")
    if kind not in WRITERS:
        raise ValueError(f"unknown format: {kind}")
    out = project(df, fields, mapping)
    batches, errors = 1, []
    try:
        if kind == "csv":
            n = write_csv(out, path, delimiter)
        elif kind == "markdown":
            n = write_sections(out, path)
        elif kind == "sqlite":
            n = write_sqlite(out, path, "crawled_data", "append", batch_size)
        else:
            n = WRITERS[kind](out, path)
        if kind in ("jsonl", "csv", "sqlite") and n > batch_size > 0:
            batches = -(-n // batch_size)
    except OSError as e:
        n, batches, errors = 0, 0, [str(e)]
    return {"path": path, "format": kind, "count": n, "batches": batches, "errors": errors}


def save_report(report: dict, path: str) -> None:
    Path(path).write_text(json.dumps(report, ensure_ascii=False, indent=2, default=str), encoding="utf-8")


def format_report(report: dict) -> str:
    """The report for a console, with bars of twenty characters."""
    out = [f"status: {report['status']}", *(f"error: {e}" for e in report["errors"]), *(f"warning: {w}" for w in report["warnings"])]
    for s in report["details"].get("fields", ()):
        full = round(20 * s["fill_rate"])
        out.append(f"{s['field']:<20} {'#' * full}{'.' * (20 - full)} {s['fill_rate']:.1%}")
    return "\n".join(out)


def _versions(spark, path: str) -> tuple[list[int], object, object]:
    """Numbers of the whole versions at a path in order, the file system and the path. A version is whole once Spark has marked it so."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    found = sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(jvm.org.apache.hadoop.fs.Path(at, f"{n}/_SUCCESS")))
    return found, fs, at


def save_state(state: DataFrame, path: str) -> None:
    """Queue, history or tasks as the next version of a table. Readers take the last whole one, so a save that is cut short changes nothing."""
    spark = state.sparkSession
    found, fs, at = _versions(spark, path)
    number = found[-1] + 1 if found else 0
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/v{number}")
    for old in found[:-1]:  # the one before stays for those that read it now
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, f"v{old}"), True)


def load_state(spark, path: str, schema: str) -> DataFrame:
    """The last whole version of the saved state; an empty one where none was ever saved. What can't be read is an error."""
    found, _, _ = _versions(spark, path)
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path.rstrip('/')}/v{found[-1]}")


def reset_state(spark, path: str) -> None:
    """Forget all versions: what was seen is new again."""
    discard(spark, path)


def spark_text(df: DataFrame, path: str, fmt: str = "txt") -> None:
    """Text records or a Markdown table in parts, by all executors; each part of a table has its head."""
    if fmt == "txt":
        lines = []
        for f in df.schema.fields:
            c = F.col(f"`{f.name}`")
            nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
            lines.append(F.concat(F.lit(f"{f.name}: "), F.coalesce(F.to_json(c) if nested else c.cast("string"), F.lit("(空)"))))
        df.select(F.concat_ws("\n", *lines, F.lit("=" * 60)).alias("value")).write.mode("overwrite").text(path)
        return
    cells = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        shown = F.to_json(c) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string")
        cells.append(F.replace(F.regexp_replace(F.replace(F.coalesce(shown, F.lit("")), F.lit("\r"), F.lit("")), "\n", " "), F.lit("|"), F.lit("\\|")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    head = "| " + " | ".join(_cell(c) for c in df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |\n"
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    df.select(F.when(first, F.concat(F.lit(head), row)).otherwise(row).alias("value")).write.mode("overwrite").text(path)


class _Staged(WriterCommitMessage):
    def __init__(self, name: str, rows: int) -> None:
        self.name, self.rows = name, rows


class _SQLiteWriter(DataSourceWriter):
    """Each task stages its rows as a SQLite file in a folder that all share; the commit takes them into the target at once."""

    def __init__(self, path: str, table: str, stage: str, names: list[str], overwrite: bool) -> None:
        self.path, self.table, self.stage, self.names, self.overwrite = path, table, stage, names, overwrite

    def _create(self, con: sqlite3.Connection, table: str) -> None:
        columns = ", ".join(f'"{quoted(c)}" TEXT' for c in self.names)
        con.execute(f'CREATE TABLE IF NOT EXISTS "{quoted(table)}" ({columns})')

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        name, n = f"{self.stage}/{uuid.uuid4().hex}.db", 0
        con = sqlite3.connect(name)
        with con:
            self._create(con, "part")
            rows = (tuple(_text(v.asDict(recursive=True) if hasattr(v, "asDict") else v) for v in r) for r in iterator)
            while part := list(itertools.islice(rows, 1000)):
                con.executemany(f"INSERT INTO part VALUES ({', '.join('?' * len(self.names))})", part)
                n += len(part)
        con.close()
        return _Staged(name, n)

    def commit(self, messages: list) -> None:
        con = sqlite3.connect(self.path, isolation_level=None)
        new, old = f'"{quoted(self.table)}__new"', f'"{quoted(self.table)}"'
        con.execute(f"DROP TABLE IF EXISTS {new}")
        self._create(con, f"{self.table}__new")
        for m in (x for x in messages if x is not None):
            con.execute("ATTACH ? AS staged", (m.name,))
            con.execute(f"INSERT INTO {new} SELECT * FROM staged.part")
            con.execute("DETACH staged")
        columns = ", ".join(f'"{quoted(c)}"' for c in self.names)
        con.execute("BEGIN IMMEDIATE")
        if self.overwrite:
            con.execute(f"DROP TABLE IF EXISTS {old}")
        self._create(con, self.table)
        con.execute(f"INSERT INTO {old} ({columns}) SELECT {columns} FROM {new}")
        con.execute(f"DROP TABLE {new}")
        con.execute("COMMIT")
        con.close()
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for m in messages:
            if m is not None:
                Path(m.name).unlink(missing_ok=True)


class SQLiteSink(DataSource):
    """Rows into a table of a SQLite file on the driver's machine, all columns as text; ``stage`` is a folder that all machines share."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_sqlite_sink"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        o = self.options
        return _SQLiteWriter(o["path"], o.get("table", "data"), o["stage"], schema.fieldNames(), overwrite)


def spark_sqlite(df: DataFrame, path: str, table: str = "data", mode: str = "overwrite") -> None:
    """Written by all executors and committed by the driver in one transaction. The shared folder must be mounted as files."""
    spark = df.sparkSession
    ship(spark)
    folder = scratch(spark, "sqlite")
    if not folder.startswith(("file:", "/")):
        raise ValueError("the shared folder isn't mounted as files; write with write_sqlite instead")
    stage = "/" + folder.removeprefix("file:").lstrip("/")
    Path(stage).mkdir(parents=True)
    spark.dataSource.register(SQLiteSink)
    try:
        df.write.format("tidemark_sqlite_sink").mode(mode).option("path", path).option("table", table).option("stage", stage).save()
    finally:
        discard(spark, folder)
