from __future__ import annotations

import os
import random
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tidemark.operators import dedup

DATA = "/root/testdata/sf0.001"


def same_as_sql(spark, name: str, folder: str) -> None:
    """A query's rows, those of its SQL and how often each is there."""
    got = entry.queries()[name](spark, folder)
    con = duckdb.connect()
    for path in sorted(p for p in os.listdir(folder) if p.endswith(".parquet")):
        con.execute(f"CREATE VIEW {path[:-8]} AS SELECT * FROM '{folder}/{path}'")
    cols = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {cols} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.fixture(scope="module")
def shared_urls(tmp_path_factory):
    """sf0.001, where every third page has the URL of the page before it, in pages of both parities, and ends of titles are cut in an entity."""
    folder = tmp_path_factory.mktemp("data") / "sf"
    shutil.copytree(DATA, folder)
    rows = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    for i in range(2, len(rows), 3):
        rows[i]["url"] = rows[i - 1]["url"]
    for r in rows[::4]:
        r["html"] = r["html"].replace("</title>", "&amp;&amp</title>").replace("</h1>", "&amp;&amp</h1>")
    (folder / "pages.parquet").chmod(0o644)
    pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(f"{DATA}/pages.parquet")), folder / "pages.parquet")
    return str(folder)


def test_greedy_dedup_lists_no_pairs(spark, monkeypatch):
    """the kept rows of several batches against brute force; hashes of either sign, and no list of pairs."""
    monkeypatch.setattr(dedup, "near_pairs", lambda *a: 1 / 0)
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(30)]
    hashes = [s ^ sum(1 << r.randrange(64) for _ in range(r.randrange(14))) & (1 << 64) - 1 for s in seeds * 10]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    rows = spark.createDataFrame(list(enumerate(signed)), "o long, h long")
    kept: list[int] = []
    for i, h in enumerate(hashes):
        if all((h ^ hashes[k]).bit_count() > 10 for k in kept):
            kept.append(i)
    assert 30 < len(kept) < 300
    assert sorted(x["o"] for x in dedup._greedy(rows, 10, most=40).collect()) == kept
    near = dedup.image_duplicates(rows.selectExpr("o AS path", "o AS ord", "h AS phash"), threshold=10)
    assert sorted(x["path"] for x in near.collect()) == [i for i in range(300) if i not in kept]


@pytest.mark.parametrize("name", ["content_changed", "length_changed", "stream_history", "paginate_walk"])
def test_pages_that_share_a_url(spark, shared_urls, name):
    """one row a page."""
    same_as_sql(spark, name, shared_urls)


@pytest.mark.parametrize("name", ["page_headings", "parse_title"])
def test_names_without_a_semicolon_stay(spark, shared_urls, name):
    """The reference's parser doesn't decode them."""
    same_as_sql(spark, name, shared_urls)


def test_pages_are_read_once_and_their_elements_listed(spark, monkeypatch):
    """One tree for the text, selectors that try only what their last step lists, few results at a time."""
    from tidemark.html import parser as P
    from tidemark.html import tree

    page = f"<article><h1>T</h1><p>{'word ' * 40}</p>{'<i>x</i>' * 200}<div class='pager'><a href='?p=7'>7</a></div></article>"
    tried = []
    fits = tree._fits
    monkeypatch.setattr(tree, "_fits", lambda n, tests: tried.append(n) or fits(n, tests))
    root = tree.parse(page)
    assert P.total_pages(root) == 7 and len(tried) < 20
    assert [n.tag for n in root.select("i, .pager, h1")][:2] == ["h1", "i"] and root.select_one("#none") is None
    root.first("h1").remove()
    assert root.all("h1") == [] and P.main_content(root).tag == "article"
    assert P.PAGES <= 1000


def test_tokens_kept_by_a_worker_are_bounded(monkeypatch):
    """within a text too, and with the same hashes."""
    from tidemark.functions import simhash as S

    texts = [" ".join(f"w{i}x{k}" for k in range(5000)) for i in range(4)] + ["", None, "a b"]
    want = S.hashes(texts, S.Signs())
    monkeypatch.setattr(S, "TOKENS", 1000)
    signs = S.Signs()
    assert S.hashes(texts, signs, block=500) == want and len(signs) <= 1500
    batch = pa.record_batch({"k": list(range(7 * 100)), "t": texts * 100})
    got = list(S.hash_last(iter([batch])))
    assert max(b.num_rows for b in got) <= 256 and [x for b in got for x in b.column(1).to_pylist()] == [None if t is None else h for t, h in zip(texts, want)] * 100


def test_near_links_count_every_pair_once(spark):
    """buckets of several tiles, copies and hashes of either sign against brute force."""
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(6)]
    hashes = [r.choice(seeds) ^ sum(1 << r.randrange(64) for _ in range(r.randrange(4))) for _ in range(400)]
    rows = [(i, h - (1 << 64) if h >> 63 else h) for i, h in enumerate(hashes)]
    got = dedup.near_links(spark.createDataFrame(rows, "o long, h long"), 3, tile=20).collect()
    want = [(i, hashes.index(h), sum((h ^ x).bit_count() <= 3 for x in hashes) - 1) for i, h in enumerate(hashes)]
    assert sorted(map(tuple, got)) == want and max(w[2] for w in want) > 30


def test_text_records_are_read_in_parts(spark, tmp_path):
    """a part a record, the same records as of the whole text; lines that only begin like one between records too."""
    from tidemark.sources import readers

    line = "=" * 60
    plain = f"{line}\na: 1\nb: x\nmore\n{line}   \n\na: 2\n{'=' * 12}\n  \na: 3\nb: {line}\n{line}\n"
    odd = plain + f"a: 4\n{'=' * 11} no line between\na: 5\n{line}\nb: 6"
    for name, text in (("plain", plain), ("odd", odd)):
        (tmp_path / f"{name}.txt").write_text(text)
        got = readers.load_txt(spark, str(tmp_path / f"{name}.txt"))
        want = [(r.get("a"), r.get("b")) for r in readers.parse_records(text)]
        assert sorted(map(repr, got.select("a", "b").collect())) == sorted(f"Row(a={a!r}, b={b!r})" for a, b in want)
    assert spark.read.option("lineSep", readers.BETWEEN).text(str(tmp_path / "plain.txt")).count() > 3


def test_csv_keeps_blanks_at_the_ends(spark, tmp_path):
    """they were cut off when written."""
    from tidemark.sources import readers, writers

    rows = [("1", " a "), ("2", "\tb"), ("3", "c "), ("5", 'q"\\ ,x\ny ')]
    writers.spark_write(spark.createDataFrame(rows, "k string, v string"), str(tmp_path / "c"), "csv")
    assert sorted(tuple(r) for r in readers.load_csv(spark, str(tmp_path / "c")).collect()) == rows


def test_embedded_database_is_the_drivers(spark, tmp_path):
    """no executor opens it; nulls, empties, quotes and line ends come back."""
    from tidemark.sources import readers, writers

    rows = [("1", None), ("2", ""), ("3", ' "a",b\\ '), ("4", "x\ny\r\nz\n"), ("5", '"'), ("6", "é\0世")]
    url = f"jdbc:derby:{tmp_path}/c;create=true"
    for _ in range(2):
        writers.write_jdbc(spark.createDataFrame(rows, "k string, v string").repartition(3), url, "c")
    got = readers.load_jdbc(spark, url, "c")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, rows * 2))
    assert "JDBCRelation" not in got._jdf.queryExecution().toString()
    assert not writers.embedded("jdbc:derby://host:1527/c") and not writers.embedded("jdbc:postgresql://host/c")


def test_content_keys_of_odd_rows(spark, tmp_path):
    """null, empty and blank texts, repeated rows, null keys and letters that Java doesn't know."""
    folder = tmp_path / "sf"
    shutil.copytree(DATA, folder)
    schema = pq.read_schema(f"{DATA}/documents.parquet")
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    texts = ["", None, "", " ", "!?", "a\u9ffdb", "ab", "a \U00031350", "\U00011f50.", "."]
    odd = [rows[0] | {"doc_id": 10**6 + i, "text": t} for i, t in enumerate(texts)] + [rows[0] | {"doc_id": None}, rows[0] | {"doc_id": None, "text": "alone"}]
    (folder / "documents.parquet").chmod(0o644)
    pq.write_table(pa.Table.from_pylist(rows + rows[:20] + odd, schema), folder / "documents.parquet")
    same_as_sql(spark, "dedup_content", str(folder))


def test_files_take_no_row_to_the_driver(spark, tmp_path, monkeypatch):
    """what comes back is a row a partition; records are numbered over all of them."""
    from pyspark.sql import DataFrame

    from tidemark.sources import writers

    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *a, **k: 1 / 0)
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "'x' AS v")
    for kind in writers.WRITERS:
        assert writers.export(df, f"{tmp_path}/a.{kind}", kind) == {"path": f"{tmp_path}/a.{kind}", "format": kind, "count": 1000, "batches": 1, "errors": []}
    heads = [x for x in (tmp_path / "a.markdown").read_text().splitlines() if x.startswith("## ")]
    assert heads == [f"## Record {i}" for i in range(1, 1001)]
