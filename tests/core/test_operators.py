"""Operators against plain Python statements, metamorphic properties, files and streams."""

from __future__ import annotations

import datetime
import json
import random
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, crawl, dedup, frontier, verify
from tidemark.operators.hooks import Hooks, analyze_with_model, clean_with_model, client_config, extract_with_model, parse_answer
from tidemark.operators.schedule import Scheduler, task_places
from tidemark.sources import readers, writers
from tidemark.streaming import incremental as inc

from .test_functions import py_simhash


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(30)) for _ in range(25)) for _ in range(25)]
    rows = [(i, f"http://e/{i % 40}", t) for i, t in enumerate(base + base[:8] + [t + " more" for t in base[:10]])]
    rows += [(60, None, "short"), (61, "", "short"), (62, "http://x", None), (63, "http://y", ""), (64, "http://z", "!!!"), (65, "http://w", "???")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "ord long, url string, text string").repartition(5)


def kept(df):
    return sorted(r.ord for r in df.collect())


def test_dedup_against_plain_loops(spark, items):
    seen, url = set(), []
    for o, u, _ in items:
        if not u or u not in seen:
            url.append(o)
            seen.add(u)
    assert kept(dedup.dedup_by_url(frame(spark, items))) == url
    seen, content = set(), []
    for o, _, t in items:
        k = re.sub(r"[\W_]+", "", t) if t else None
        if not t or k not in seen:
            content.append(o)
            seen.add(k)
    assert kept(dedup.dedup_by_content(frame(spark, items))) == content
    hashes, near = [], []
    for o, _, t in items:
        h = py_simhash(t)
        if not t or len(t) < 20:
            near.append(o)
        elif all(bin((h ^ g) & (2**64 - 1)).count("1") > 10 for g in hashes):
            near.append(o)
            hashes.append(h)
    once = dedup.dedup_by_simhash(frame(spark, items))
    assert kept(once) == near
    stats = dedup.dedup_stats(frame(spark, items)).first()
    assert stats.url_duplicates == len(items) - len(url) and stats.total == stats.url_duplicates + stats.content_duplicates + stats.simhash_duplicates


def test_lookback_is_that_of_a_plain_loop(spark, items):
    rows = [(o, u, t) for o, u, t in items if t]
    hashes, near = [], 0
    for _, _, t in rows:
        if len(t) > 20:
            h = py_simhash(t)
            near += any(0 < bin((h ^ g) & (2**64 - 1)).count("1") <= 5 for g in hashes[-200:])
            hashes.append(h)
    got = verify.dup_counts(frame(spark, rows)).first()
    assert got.near_duplicates == near and got.total == len(rows)


def test_rules_and_projections(spark):
    df = spark.createDataFrame([(1, "ab-12", "Straße", "k")], "i int, a string, b string, c string")
    rules = [
        {"field": "a", "action": "replace", "pattern": "([a-z]+)-([0-9]+)", "replacement": r"\2$\1"}, {"field": "b", "action": "uppercase"}, {"field": "c", "action": "rename", "new_name": "b2"},
        {"field": "missing", "action": "remove"}, {"field": "i", "action": "lowercase"},
    ]
    assert clean.apply_rules(df, rules).first().asDict() == {"i": 1, "a": "12$ab", "b": "STRASSE", "b2": "k"}
    assert clean.apply_rules(df, [{"field": "a", "action": "extract", "pattern": "([a-z]+)-([0-9]+)"}]).first().a == ["ab", "12"]
    assert clean.apply_rules(df, [{"field": "a", "action": "truncate", "max_length": 2, "suffix": "~"}, {"field": "b", "action": "remove"}]).first().asDict() == {"i": 1, "a": "ab~", "c": "k"}
    assert clean.project(df, ["b", "x", "a"], {"b": "a"}).columns == ["a"] and clean.project(df, mapping={"a": "z"}).columns == ["i", "b", "c", "z"]
    gone = spark.createDataFrame([("", None), (" ", None), (None, "x")], "a string, b string")
    assert clean.remove_empty(gone).count() == 2
    assert clean.clean(spark.createDataFrame([("<p>a</p>  b", None)], "a string, b string")).first().asDict() == {"a": "a b", "b": None}


def test_auto_format(spark):
    long_ = [(i, "word " * 200) for i in range(12)]
    df = spark.createDataFrame(long_, "ord long, text string")
    assert clean.auto_format(df).first()[0] == "markdown" and clean.auto_format(df, disabled=("markdown",)).first()[0] == "json"
    flat = spark.createDataFrame([(i, "a", "b") for i in range(300)], "ord long, x string, y string")
    assert clean.auto_format(flat).first()[0] == "csv" and clean.auto_format(flat, prefer="weighted").first()[0] == "csv"
    assert clean.auto_format(flat.limit(0)).first()[0] == "json"
    assert clean.auto_format(spark.createDataFrame([(1, ["x"])], "ord long, x array<string>")).first()[0] == "json"
    pictures = spark.createDataFrame([(1, "http://e/a.png", "b" * 60)], "ord long, x string, y string")
    assert clean.auto_format(pictures).first()[0] == "docx" and clean.auto_format(pictures, prefer="weighted").first()[0] == "docx"


def test_verification(spark):
    rows = [(1, "http://e/?page=1", "A", "x" * 60, True, ["a", "b"]), (2, "http://e/?page=4", None, "403", None, []), (3, "", "", "q" * 250 + " end,", False, None)]
    df = spark.createDataFrame(rows, "ord long, url string, title string, text string, flag boolean, tags array<string>")
    stats = {r.field: r for r in verify.field_stats(df).collect()}
    assert (stats["title"].fill_count, stats["title"].null_count, stats["flag"].min_length, stats["flag"].max_length) == (1, 2, 4, 5)
    assert stats["tags"].max_length == len(json.dumps(["a", "b"])) and stats["tags"].fill_count == 1 and stats["url"].null_rate == 0.3333
    q = verify.quality_counts(df).first()
    assert (q.too_short, q.suspected_truncated, q.total) == (1, 1, 3)
    bad = verify.antibot_counts(df).first()
    assert bad.suspected_pages == 1 and bad.samples == ["403"]
    pages = verify.page_summary(df).first()
    assert (pages.total_pages, pages.first_page, pages.last_page, pages.missing) == (2, 1, 4, 2)
    assert [tuple(r) for r in verify.page_gaps(df).collect()] == [(2, 3)] and sorted(tuple(r) for r in verify.page_counts(df).collect()) == [(1, 1), (4, 1)]
    odd = spark.createDataFrame([(f"http://e/?p={p}",) for p in ("1", "20240101123456", "99999999")], "url string")
    assert sorted(tuple(r) for r in verify.page_gaps(odd).collect()) == [(2, 99999998), (100000000, 20240101123455)]
    assert verify.page_gaps(df.limit(0)).count() == 0 and verify.page_summary(df.limit(0)).first().missing is None
    report = verify.verify(df, expected=5, baseline=df)
    assert report["status"] == "error" and report["details"]["reconciliation"]["missing"] == 2 and report["details"]["diff"]["changed"] == 0
    assert verify.verify(df.limit(0))["status"] == "error" and "status: error" in writers.format_report(report)


def test_diff_is_symmetric(spark):
    a = spark.createDataFrame([(1, "u1", "x"), (2, "u2", "y"), (3, "u2", "z"), (4, "", "w")], "ord long, url string, v string")
    b = spark.createDataFrame([(1, "u2", "z"), (2, "u3", None)], "ord long, url string, v string")
    one, two = verify.snapshot_diff(a, b, ["url"], "ord").first(), verify.snapshot_diff(b, a, ["url"], "ord").first()
    assert (one.added, one.removed, one.changed) == (1, 1, 0) == (two.removed, two.added, two.changed)
    same = verify.snapshot_diff(a, a, ["url"], "ord").first()
    assert (same.added, same.removed, same.changed, same.baseline_count) == (0, 0, 0, 4)


def plain_queue(log, most=3):
    state: dict = {}
    for u, e, o in log:
        s = state.get(u)
        if e == "add" and s is None:
            state[u] = ["pending", 0, 0, o]
        elif s is None:
            continue
        elif e == "next" and s[0] == "pending":
            s[0] = "processing"
        elif e == "done" and s[0] in ("processing", "pending"):
            s[0] = "done"
        elif e == "failed" and s[0] == "processing":
            if s[2] < most:
                s[:] = ["pending", s[2] + 1, s[2] + 1, o]
            else:
                s[0] = "failed"
        elif e == "requeue" and s[0] == "failed":
            s[:] = ["pending", 0, 0, o]
    return {u: tuple(s) for u, s in state.items()}


def test_queue_is_the_fold_of_its_log(spark):
    rng = random.Random(3)
    log = [(f"u{rng.randrange(12)}", rng.choice(["add", "next", "next", "failed", "failed", "done", "requeue"]) if i % 9 else "add", i) for i in range(400)]
    got = frontier.queue_state(spark.createDataFrame(log, "url string, event string, ord long").repartition(4))
    assert {r.url: (r.state, r.priority, r.retries, r.added) for r in got.collect()} == plain_queue(log)
    assert frontier.recover(got).where("state = 'processing'").count() == 0
    new = spark.createDataFrame([("u1", 5, 1), ("n1", 2, 2), ("n2", 1, 3), ("n2", 0, 4)], "url string, priority int, ord long")
    assert [r.url for r in frontier.admit(new, got).orderBy("url").collect()] == sorted({"n1", "n2"} | ({"u1"} - {r.url for r in got.collect()}))
    assert frontier.admit(new, got, cap=0).count() == 0


def test_rows_are_left_out_where_they_are_read(spark, tmp_path):
    """Beyond the broadcast's bound, from files and from a table of no files, the rows are those of the join."""
    rng = random.Random(15)
    rows = [(i % 290, rng.choice(["", None, *[f"text {k}" for k in range(60)]]), f"x{i}") for i in range(600)]
    df = spark.createDataFrame(rows, "ord long, text string, _o string")
    df.repartition(5).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    least = {}
    for o, t, _ in rows:
        if t:
            key = t.replace(" ", "")
            least[key] = min(least.get(key, o), o)
    want = sorted((r for r in rows if not r[1] or least[r[1].replace(" ", "")] == r[0]), key=repr)
    for given in (df, read, read.where("ord >= 0")):
        for few in (0, 10**6):
            got = dedup._first(given, F.when(F.col("text") != "", dedup.content_key(F.col("text"))), "ord", ["text"], few)
            assert got.columns == df.columns and sorted((tuple(r) for r in got.collect()), key=repr) == want
    wide = dedup._first(spark.read.parquet(str(tmp_path / "t")), F.col("text"), "ord", ["text"], 0)
    assert "file_path" in wide._jdf.queryExecution().toString() and "Join" not in wide._jdf.queryExecution().executedPlan().toString()
    assert dedup._first(read.limit(0), F.col("text"), "ord", ["text"], 0).count() == 0


def test_rate_gate_is_a_loop_over_each_domain(spark):
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 1)
    log = [(i, rng.choice(["hot", "hot", "hot", "a", None]), start + datetime.timedelta(seconds=rng.randrange(200))) for i in range(300)]
    last, want = {}, {}
    for i, domain, ts in sorted(log, key=lambda r: (r[2], r[0])):
        want[i] = domain not in last or (ts - last[domain]).total_seconds() >= 2
        last[domain] = ts
    got = frontier.rate_gate(spark.createDataFrame(log, "id long, domain string, ts timestamp").repartition(4), "domain", "ts", 2.0, "id")
    assert got.columns == ["id", "domain", "ts", "allowed"] and {r.id: r.allowed for r in got.collect()} == want
    assert frontier.rate_gate(got.limit(0).drop("allowed"), "domain", "ts", 2.0).count() == 0


def test_state_survives_a_save_that_is_cut_short(spark, tmp_path):
    path = str(tmp_path / "s")
    one, two = (spark.createDataFrame([(x,)], "x long") for x in (1, 2))
    assert writers.load_state(spark, path, "x long").count() == 0
    writers.save_state(one, path)
    with pytest.raises(Exception):  # noqa: B017
        writers.save_state(two.selectExpr("assert_true(x < 0) AS y", "x"), path)
    assert [r.x for r in writers.load_state(spark, path, "x long").collect()] == [1]
    writers.save_state(two, path)
    writers.save_state(one, path)
    assert [r.x for r in writers.load_state(spark, path, "x long").collect()] == [1]


def test_adaptive_interval_is_the_sequential_fold(spark):
    rng = random.Random(4)
    for n in (0, 1, 500, 12000):
        times = [(i, rng.choice([0.0, 0.2, 0.9, 1.5, 3.0, 5.0, 9.0]) if i % 50 < 25 else rng.choice([0.1, 8.0])) for i in range(n)]
        x = 1.0
        for _, r in times:
            if r > 4:
                x = min(x * 1.5, 30)
            elif 0 < r < 1:
                x = max(x * 0.8, 1)
        log = spark.createDataFrame([(i if i < n / 2 else i + 10**12, r) for i, r in times], "o long, r double")
        got = frontier.adaptive_interval(log, "r", "o", stretch=37).first()[0]
        assert got == pytest.approx(x)


def test_history(spark):
    now = datetime.datetime(2024, 3, 1)
    rows = [("a", "h1", now, "A"), ("b", "h2", now - datetime.timedelta(days=40), "B"), ("c", "h3", None, "C")]
    history = spark.createDataFrame(rows, inc.HISTORY)
    assert {r.url for r in frontier.expire(history, now).collect()} == {"a", "c"} and frontier.expire(history, now, 0).count() == 3
    assert [r.url for r in frontier.evict_oldest(history, 1).collect()] == ["a"]
    again = frontier.mark_visited(history, spark.createDataFrame([("a", "h9", now + datetime.timedelta(days=1), "A2")], inc.HISTORY))
    assert {r.url: r.hash for r in again.collect()}["a"] == "h9"
    stats = frontier.history_stats(history.unionByName(history)).first()
    assert (stats.total_visited, stats.total_hashes) == (6, 3)
    lengths = spark.createDataFrame([("a", "h", 100)], "url string, hash string, length long")
    pages = spark.createDataFrame([("a", "x" * 120), ("b", "y")], "url string, content string")
    assert {r.url: r.changed for r in frontier.content_changed(pages, lengths, "length").collect()} == {"a": False, "b": True}


def test_walks(spark):
    pages = spark.createDataFrame([(f"http://e/?page={i}", "" if i in (4, 5) else "html") for i in range(1, 9)], "url string, html string")
    starts = spark.createDataFrame([("http://e/?page=1",), ("http://e/?page=8",), ("http://none/",)], "url string")
    got = crawl.paginate_walk(starts, pages)
    ends = {r.start: (r.step, r.stop) for r in got.where("stop is not null").collect()}
    assert ends == {"http://e/?page=1": (4, "consecutive_empty"), "http://e/?page=8": (1, "fetch_failed"), "http://none/": (0, "fetch_failed")}
    lists = spark.createDataFrame([("l", ["http://e/?page=2", "x", "http://e/?page=2", "http://e/?page=3"])], "url string, links array<string>")
    assert [(r["rank"], r.url) for r in crawl.list_detail(lists, pages).orderBy("rank").collect()] == [(0, "http://e/?page=2"), (2, "http://e/?page=3")]


def test_pagination_methods(spark):
    rows = [
        (1, "http://e/?page=3", '<div class="pagination"><a href="?page=9">9</a></div>'), (2, "http://e/?page=3", '<link rel="next" href="/n">'), (3, "http://e/x", '<a class="next" href="/m">go</a>'),
        (4, "http://e/y", "<p>nothing</p>"),
    ]
    got = {r.page_id: r for r in crawl.detect_pagination(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [(got[i].method, got[i].next_url, got[i].page_number) for i in (1, 2, 3, 4)] == [("url_pattern", "http://e/?page=4", 3), ("link_rel", "http://e/n", 3), ("selector", "http://e/m", 1), ("none", None, 1)]
    assert got[1].total_pages == 9 and got[1].pagination_urls == ["http://e/?page=9"]


def test_hooks_and_models(spark):
    df = spark.createDataFrame([("http://e/en/1", "some text"), ("http://e/de/2", None)], "url string, text string")
    h, calls = Hooks(), []
    h.on("before", lambda r: {"n": 1})
    h.on("before", lambda r: 1 / 0)
    h.on("after", lambda out: out.limit(1))
    h.on("finish", lambda r: calls.append(r["n"]))
    assert h.run(lambda d, r: d, df).count() == 1 and calls == [1] and h.failed_hooks == 1
    assert h.run(lambda d, r: 1 / 0, df) is None and h.stats()["success_rate"] == 0.5
    h.route("*/en/*", lambda d: d.select("url"))
    assert h.dispatch(df)["*/en/*"].count() == 1
    assert parse_answer('```json\n{"a": 1}\n```') == {"a": 1} and parse_answer("no") == {"raw_extraction": "no"}
    got = extract_with_model(df, lambda p: '{"topic": "%s"}' % ("x" if "some" in p else "y"), ["topic", "url"])
    assert sorted(r.ai_topic for r in got.collect()) == ["x", "y"] and "ai_url" not in got.columns
    two = spark.createDataFrame([("http://e/1", " raw "), ("http://e/2", "kept")], "url string, text string").coalesce(1)
    swept = clean_with_model(two, lambda p: '```json\n[{"text": "clean", "url": "no"}]\n```')
    assert {r.url: r.text for r in swept.collect()} == {"http://e/1": "clean", "http://e/2": "kept"}
    assert {r.text for r in clean_with_model(two, lambda p: "nonsense").collect()} == {" raw ", "kept"}
    assert {r.structure for r in analyze_with_model(two, lambda p: '{"page_type": "list"}', "text").collect()} == {'{"page_type": "list"}'}
    assert client_config({"model": "m"}, {"AI_MODEL": "n"})["model"] == "n"


def test_every_task_has_its_place(spark):
    rng = random.Random(7)
    s = Scheduler()
    for i in range(300):
        s.add(f"t{i}", [], priority=rng.randrange(-2, 14))
    rows = [(t.id, t.priority) for t in s.tasks.values()]
    rng.shuffle(rows)
    got = {r.id: r.place for r in task_places(spark.createDataFrame(rows, "id long, priority int").repartition(5)).collect()}
    assert got == {t.id: k for k, t in enumerate(s.order(), 1)}


def test_scheduler(spark, tmp_path):
    now = [0.0]
    s = Scheduler(lambda: now[0], lambda x: now.__setitem__(0, now[0] + x))
    late, first = s.add("b", ["u1"], 10, 99), s.add("a", ["u1", "u2"], 10, -3)
    assert [t.id for t in s.order()] == [first, late] and s.order()[0].priority == 1
    now[0] = 1.0
    seen = []
    s.run(spark, lambda urls: urls, rounds=2, history=spark.createDataFrame([("u1",)], "url string"), callback=lambda t, out: seen.append((t.id, out.count())))
    assert seen == [(first, 1), (late, 0)] * 2 and s.tasks[first].runs == 2
    s.save(str(tmp_path / "t.json"))
    other = Scheduler()
    other.load(str(tmp_path / "t.json"))
    assert other.order() == s.order() and s.remove(first) and not s.remove(first)
    other.load(str(tmp_path / "absent"))
    assert other.tasks == {}


ROWS = [("a|b", "line\nbreak", 1, ["x"]), (None, "é, \"q\"", None, None)]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k string, v string, n int, l array<string>").coalesce(1)
    for suffix in ("json", "jsonl", "csv", "db", "md", "txt", "docx", "xlsx"):
        path = str(tmp_path / f"out.{suffix}")
        assert writers.save(df, path) == path
    for suffix in ("json", "jsonl"):
        got = readers.load(spark, str(tmp_path / f"out.{suffix}"))
        assert sorted(((r.k, r.v, r.n, r.l) for r in got.collect()), key=repr) == sorted(ROWS, key=repr)
    got = readers.load(spark, str(tmp_path / "out.csv"))
    assert got.columns == ["k", "v", "n", "l"] and {r.v for r in got.collect()} == {"line\nbreak", 'é, "q"'}
    got = readers.load(spark, str(tmp_path / "out.db"))
    assert sorted(((r.k, r.v, r.n, r.l) for r in got.collect()), key=repr) == sorted([("a|b", "line\nbreak", "1", '["x"]'), (None, 'é, "q"', None, None)], key=repr)
    got = readers.load(spark, str(tmp_path / "out.md"))
    assert [(r.k, r.v) for r in got.collect()] == [("a|b", "line break"), ("", 'é, "q"')]
    assert readers.load(spark, str(tmp_path / "out.txt")).count() == 2
    with zipfile.ZipFile(tmp_path / "out.xlsx") as z:
        assert "line\nbreak" in z.read("xl/worksheets/sheet1.xml").decode()
    with zipfile.ZipFile(tmp_path / "out.docx") as z:
        assert "a|b" in z.read("word/document.xml").decode()
    (tmp_path / "w.json").write_text('{"total": 2, "results": [{"a": 1}, {"a": 2}]}')
    assert readers.load_wrapped_json(spark, str(tmp_path / "w.json")).count() == 2 and readers.sniff(spark, str(tmp_path / "w.json")).count() == 2
    assert readers.sniff(spark, str(tmp_path / "out.txt")) is None
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n{bad\n')
    with pytest.raises(Exception):
        readers.load_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()
    assert readers.parse_records("a: 1\n  more\nb:\n==========\nc: http://x\n") == [{"a": "1\nmore"}, {"c": "http://x"}]


def test_export_and_fallbacks(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "k string, v string, n int, l array<string>").coalesce(1)
    got = writers.export(df, str(tmp_path / "e.csv"), fields=["n", "k"], mapping={"k": "key"})
    assert got["count"] == 2 and (tmp_path / "e.csv").read_text(encoding="utf-8-sig").splitlines()[0] == "n,key"
    for _ in range(2):
        writers.export(df, str(tmp_path / "e.db"))
    with sqlite3.connect(tmp_path / "e.db") as con:
        assert con.execute("SELECT count(*) FROM crawled_data").fetchone() == (4,)
    with pytest.raises(ValueError):
        writers.export(df, str(tmp_path / "e.x"), "nope")
    broken = writers.WRITERS["docx"]
    writers.WRITERS["docx"] = lambda *a: 1 / 0
    try:
        assert writers.save(df, str(tmp_path / "f.docx")) == str(tmp_path / "f.md")
    finally:
        writers.WRITERS["docx"] = broken
    assert writers.save(df, str(tmp_path / "g"), twin=True).endswith("g.json")


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"http://e/{i % 7}", f"text {i % 5}", datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "ord long, url string, text string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    schema = "ord long, url string, text string, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for name, f in (("u", inc.dedup_url(stream, "ts")), ("c", inc.dedup_content(stream, "ts"))):
        q = f.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert {r.url for r in spark.read.parquet(str(tmp_path / "u")).collect()} == {u for _, u, _, _ in rows} and spark.read.parquet(str(tmp_path / "u")).count() == 7
    assert spark.read.parquet(str(tmp_path / "c")).count() == 5
    got = []
    pages = stream.select("url", F.col("text").alias("content"), "ts", F.col("url").alias("title"))
    inc.incremental(pages, str(tmp_path / "state"), str(tmp_path / "inc-c"), lambda df, n: got.append(df.count()), most=5).awaitTermination(120)
    assert got[0] == 10 and len(got) >= 2 and writers.load_state(spark, str(tmp_path / "state"), inc.HISTORY).count() == 5
