"""Round trips through the sinks and sources, and streams that must equal their batch, with their SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tidemark.plans.corpus import table
from tidemark.session import shared_dir
from tidemark.sources import readers, writers
from tidemark.streaming import incremental

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return add


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("jsonl_round_trip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _jsonl(spark, d):
    path = _place(spark, "jsonl")
    writers.spark_write(table(spark, d, "customer"), path, "jsonl", 5000)
    return readers.load_jsonl(spark, path)


@query("csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, text, lang, source, n_chars::VARCHAR AS n_chars FROM documents")
def _csv(spark, d):
    path = _place(spark, "csv")
    writers.spark_write(table(spark, d, "documents"), path, "csv")
    return readers.load_csv(spark, path)


def _stream(spark, d, name: str):
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


@query("stream_dedup", "SELECT user_id, count(*)::BIGINT AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY user_id")
def _dedup(spark, d):
    """The first event of each user within a watermark longer than the data."""
    path = _place(spark, "stream")
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = incremental.dedup_url(events, "ts", "user_id", "400 days")
    kept.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))


def _local(spark, name: str) -> str:
    """A folder of the shared storage as files, for the formats that are one file, written by the driver."""
    path = _place(spark, name).removeprefix("file://")
    os.makedirs(path)
    return path


_CUSTOMER = "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer"


def _customer(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("json_round_trip", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _json(spark, d):
    path = f"{_local(spark, 'json')}/c.json"
    writers.write_json(table(spark, d, "customer"), path)
    return readers.load(spark, path)


@query("json_wrapped", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def _wrapped(spark, d):
    """A record that holds its rows under ``items``, in a file of an unknown suffix."""
    path = f"{_local(spark, 'wrapped')}/r.dat"
    with open(path, "w", encoding="utf-8") as f:
        f.write('\n {"count": 5, "items": [' + ",".join(r["j"] for r in table(spark, d, "region").select(F.to_json(F.struct("*")).alias("j")).collect()) + "]}")
    return readers.sniff(spark, path)


@query("sqlite_round_trip", _CUSTOMER)
def _sqlite(spark, d):
    path = f"{_local(spark, 'sqlite')}/c.db"
    writers.write_sqlite(_customer(spark, d), path)
    return readers.load(spark, path)


@query("sqlite_parallel_write", f"{_CUSTOMER} UNION ALL {_CUSTOMER} WHERE c_custkey % 2 = 0")
def _sqlite_sink(spark, d):
    """Staged by tasks and committed at once: an overwrite, then an append."""
    path, c = f"{_local(spark, 'sink')}/c.db", _customer(spark, d).repartition(3)
    writers.spark_sqlite(c.where("c_custkey < 10"), path)
    writers.spark_sqlite(c, path)
    writers.spark_sqlite(c.where("c_custkey % 2 = 0"), path, mode="append")
    return readers.load_sqlite(spark, path)


@query("markdown_round_trip", "SELECT c_custkey::VARCHAR AS c_custkey, c_name || '|' || c_mktsegment AS both FROM customer")
def _markdown(spark, d):
    path = f"{_local(spark, 'md')}/c.md"
    writers.write_markdown(table(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_name", "c_mktsegment").alias("both")), path)
    return readers.load(spark, path)


@query("markdown_parallel_write", "SELECT c_custkey::VARCHAR AS c_custkey, c_name || '|' || c_mktsegment AS both FROM customer")
def _markdown_parts(spark, d):
    """Parts with a head each; the heads of the later ones read as rows of names, which are left out here."""
    path = _place(spark, "mdparts")
    writers.spark_text(table(spark, d, "customer").select("c_custkey", F.concat_ws("|", "c_name", "c_mktsegment").alias("both")).repartition(3), path, "markdown")
    return readers.load_markdown(spark, path).where("c_custkey <> 'c_custkey'")


@query("txt_round_trip", _CUSTOMER)
def _txt(spark, d):
    path = f"{_local(spark, 'txt')}/c.txt"
    writers.write_txt(_customer(spark, d), path)
    return readers.load(spark, path)


@query("txt_parallel_write", _CUSTOMER)
def _txt_parts(spark, d):
    path = _place(spark, "txtparts")
    writers.spark_text(_customer(spark, d).repartition(3), path)
    return readers.load_txt(spark, path)


def _xml(path: str, member: str, pattern: str) -> list[tuple]:
    import re
    import zipfile

    with zipfile.ZipFile(path) as z:
        return re.findall(pattern, z.read(member).decode())


@query("excel_cells", "SELECT 'A' || (r_regionkey + 2) AS cell, r_regionkey::VARCHAR AS value FROM region UNION ALL SELECT 'B' || (r_regionkey + 2), r_name FROM region UNION ALL SELECT 'A1', 'r_regionkey' UNION ALL SELECT 'B1', 'r_name'")
def _excel(spark, d):
    path = f"{_local(spark, 'xlsx')}/r.xlsx"
    writers.write_excel(table(spark, d, "region").orderBy("r_regionkey"), path)
    return spark.createDataFrame(_xml(path, "xl/worksheets/sheet1.xml", r'<c r="(\w+)"[^>]*>(?:<is><t[^>]*>|<v>)([^<]*)'), "cell string, value string")


@query("docx_paragraphs", "SELECT r_name AS text, 2 AS times FROM region UNION ALL SELECT 'key: ' || r_regionkey, 1 FROM region")
def _docx(spark, d):
    path = f"{_local(spark, 'docx')}/r.docx"
    writers.write_docx(table(spark, d, "region").select(F.col("r_name").alias("title"), F.col("r_regionkey").alias("key"), F.col("r_name").alias("text")), path)
    return spark.createDataFrame([(t,) for t in _xml(path, "word/document.xml", r"<w:t[^>]*>([^<]*)</w:t>")], "text string").groupBy("text").agg(F.count("*").cast("int").alias("times"))


@query("save_formats", "SELECT * FROM (VALUES ('region', '.json', 5::BIGINT), ('named', '.csv', 5::BIGINT), ('fallback', '.md', 5::BIGINT), ('twin', '.json', 5::BIGINT)) AS t(what, suffix, lines)")
def _save(spark, d):
    """The format that fits, the one of the suffix, the one after a format that fails, and a JSON twin."""
    r, folder = table(spark, d, "region"), _local(spark, "save")
    out = [("region", writers.save(r, f"{folder}/a", order="r_regionkey")), ("named", writers.save(r, f"{folder}/b.csv", twin=True))]
    broken, writers.WRITERS["docx"] = writers.WRITERS["docx"], lambda df, path: 1 / 0
    try:
        out.append(("fallback", writers.save(r, f"{folder}/c.docx")))
    finally:
        writers.WRITERS["docx"] = broken
    out.append(("twin", f"{folder}/b.json"))
    return spark.createDataFrame([(n, os.path.splitext(p)[1], readers.load(spark, p).count()) for n, p in out], "what string, suffix string, lines long")


@query("export_stats", "SELECT f AS format, n AS count, CASE WHEN f IN ('jsonl', 'csv', 'sqlite') THEN ceil(n / 400)::BIGINT ELSE 1 END AS batches, 0::BIGINT AS errors FROM (SELECT count(*)::BIGINT AS n FROM customer), (VALUES ('jsonl'), ('csv'), ('sqlite'), ('json'), ('markdown'), ('excel')) AS t(f)")
def _export(spark, d):
    """Two fields, one renamed, in batches of 400."""
    folder, out = _local(spark, "export"), []
    for kind in ("jsonl", "csv", "sqlite", "json", "markdown", "excel"):
        got = writers.export(table(spark, d, "customer"), f"{folder}/x-{kind}", kind, ["c_name", "c_custkey", "absent"], {"c_name": "name"}, batch_size=400)
        out.append((got["format"], got["count"], got["batches"], len(got["errors"])))
    return spark.createDataFrame(out, "format string, count long, batches long, errors long")


@query("export_fields", "SELECT c_custkey::VARCHAR AS c_custkey, c_name AS name FROM customer")
def _fields(spark, d):
    path = f"{_local(spark, 'fields')}/x.csv"
    writers.export(table(spark, d, "customer"), path, None, ["c_name", "c_custkey", "absent"], {"c_name": "name"})
    return readers.load(spark, path)


@query("file_index", "SELECT * FROM (VALUES ('a.pdf', 'http://e/a?x=1|2', 'd/a.pdf')) AS t(filename, url, local_path)")
def _index(spark, d):
    """The index of downloaded files behind a table without rows."""
    path = f"{_local(spark, 'index')}/i.md"
    writers.write_markdown(table(spark, d, "region").limit(0), path, [{"filename": "a.pdf", "url": "http://e/a?x=1|2", "local_path": "d/a.pdf"}])
    return readers.load(spark, path)


@query("state_versions", "SELECT 'u' || user_id AS url, count(*)::BIGINT AS n FROM events GROUP BY user_id")
def _state(spark, d):
    """Saved three times, the last save cut short: the second is what is read."""
    path = _place(spark, "state")
    counts = table(spark, d, "events").groupBy(F.concat(F.lit("u"), "user_id").alias("url")).agg(F.count("*").alias("n"))
    assert writers.load_state(spark, path, "url string, n long").isEmpty()
    writers.save_state(counts.limit(3), path)
    writers.save_state(counts, path)
    writers.save_state(counts.limit(5), path)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v2/_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)
    return writers.load_state(spark, path, "url string, n long")


@query("report_round_trip", "SELECT 'error' AS status, 5::BIGINT AS total, 2::BIGINT AS bars")
def _report(spark, d):
    """The verification report as a file and for a console."""
    from tidemark.operators import verify

    path = f"{_local(spark, 'report')}/r.json"
    report = verify.verify(table(spark, d, "region").withColumn("ord", F.col("r_regionkey")).drop("r_regionkey"))
    writers.save_report(report, path)
    shown = writers.format_report(report)
    saved = readers.load_json(spark, path)
    return saved.select("status", F.col("details.duplicates.total").alias("total"), F.lit(shown.count("####################")).cast("long").alias("bars"))


@query("images_scan", "SELECT r_name || '.png' AS name, length(r_name)::BIGINT AS length FROM region")
def _images(spark, d):
    """Image files with their bytes; other files are passed over."""
    folder = _local(spark, "images")
    for r in table(spark, d, "region").collect():
        for suffix in ("png", "txt"):
            with open(f"{folder}/{r['r_name']}.{suffix}", "w") as f:
                f.write(r["r_name"])
    return readers.images(spark, folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.length("content").cast("long").alias("length"))


@query("stream_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n FROM events GROUP BY ALL")
def _windows(spark, d):
    """A stream's hourly counts with a watermark longer than the data."""
    name = "windows_" + uuid.uuid4().hex
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.windowed_counts(events, "ts", "event_type", "1 hour", "400 days")
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("stream_history", "SELECT url, md5(html) AS hash FROM pages")
def _history(spark, d):
    """Micro-batches into a history; the second run over the same pages finds nothing new. As pages may share a URL, each has its id behind it."""
    path, got = _place(spark, "history"), []
    pages = table(spark, d, "pages").select(F.concat("url", F.lit("#"), "page_id").alias("url"), F.col("html").alias("content"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("t").alias("title"))
    for i in range(2):
        pages.write.parquet(f"{path}-in{i}")
        stream = spark.readStream.schema(pages.schema).parquet(f"{path}-in{i}")
        incremental.incremental(stream, f"{path}-state", f"{path}-check{i}", lambda fresh, number: got.append(fresh.count()), most=10**6).awaitTermination()
    assert got == [pages.count(), 0], got
    return writers.load_state(spark, f"{path}-state", incremental.HISTORY).select(F.regexp_replace("url", "#[0-9]+$", "").alias("url"), "hash")


def _picture(seed: int, noise: int) -> bytes:
    """A grey PNG of 40 x 40 pixels: a smooth surface of its own for each seed."""
    import math
    import struct
    import zlib

    def value(x: int, y: int) -> int:
        return int(128 + 60 * math.sin((seed % 5 + 1) * x / 9 + seed) + 50 * math.cos((seed // 5 + 1) * y / 9) + noise * (x == 3)) & 255

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + bytes(value(x, y) for x in range(40)) for y in range(40))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 40, 40, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


@query("image_files_duplicates", "SELECT 'n' || n_nationkey || '-1.png' AS name FROM nation")
def _image_files(spark, d):
    """Two pictures a nation that differ in one column of pixels, and one that can't be read; the second of each pair goes."""
    from tidemark.operators import dedup

    folder = _local(spark, "pictures")
    for n in table(spark, d, "nation").collect():
        for k in (0, 1):
            with open(f"{folder}/n{n['n_nationkey']}-{k}.png", "wb") as f:
                f.write(_picture(n["n_nationkey"], 9 * k))
    with open(f"{folder}/broken.png", "wb") as f:
        f.write(b"no picture")
    found = readers.images(spark, folder).select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), "content")
    return dedup.image_duplicates(found.withColumn("ord", F.col("name")), "name", threshold=2).select("name")


@query("jdbc_round_trip", f"{_CUSTOMER} UNION ALL {_CUSTOMER}")
def _jdbc(spark, d):
    """Appended twice, all as text."""
    url, driver = f"jdbc:derby:{_local(spark, 'jdbc')}/c;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    for _ in range(2):
        writers.write_jdbc(_customer(spark, d), url, "c", driver=driver)
    return readers.load_jdbc(spark, url, "c", driver=driver).toDF("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


@query("state_reset", "SELECT 0::BIGINT AS seen")
def _reset(spark, d):
    path = _place(spark, "reset")
    writers.save_state(table(spark, d, "region").select("r_name"), path)
    writers.reset_state(spark, path)
    return writers.load_state(spark, path, "r_name string").agg(F.count("*").alias("seen"))
