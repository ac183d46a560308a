"""Classifiers by held-out accuracy, pages by fixtures, archives by round trip, the pipeline end to end."""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import random
import zlib

import numpy as np
import pytest

from tidemark.llm import linear
from tidemark.llm.html_extract import Page, extract_main_text
from tidemark.llm.quality import filter_quality, quality
from tidemark.llm.toxicity import toxicity
from tidemark.llm.warc import members, read_records, read_warc, warc_round_trip, write_warc

DOCS = "doc_id long, text string, score double, id string, features binary"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", b"") for i, t in rows], DOCS).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    rows, marks = [], []
    for i in range(900):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(8, 150))]
        good, toxic = rng.random() < 0.75, rng.random() < 0.2
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(["vilest", "awfulness", "nastyish", "vilely"])
        text = " ".join(w)
        rows.append((i, text if good else rng.choice([text.upper() + "!!", text.replace(" ", "%%% "), " ".join([w[0]] * 60)])))
        marks.append((i, int(good), int(toxic)))
    return rows, marks


ODD = [(1000, None), (1001, ""), (1002, "x" * 200_000), (1003, "w " * 50_000), (None, "some text"), (None, None), (5, "again")]


def test_quality_on_held_out_rows(spark, corpus):
    rows, marks = corpus
    given = labels(spark, [*marks, (3, None, None), (None, 1, 1), (2000, 1, 1), marks[4]])
    got = quality(docs(spark, rows + ODD), given).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: q for i, q, _ in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    kept = filter_quality(docs(spark, rows + ODD), given)
    assert kept.columns == ["doc_id", "text", "score", "id", "features"]
    want = {r.doc_id: r.predicted for r in got if r.doc_id not in (5, None)}
    assert {r.doc_id for r in kept.collect()} - {5, None} == {i for i, p in want.items() if p}


def test_held_out_labels_are_never_read(spark, corpus):
    rows, marks = corpus
    flipped = [(i, 1 - q, 1 - t) for i, q, t in marks]
    for run, n, held in ((quality, 5, 0), (toxicity, 3, 1)):
        other = [f if zlib.crc32(str(f[0]).encode()) % n == held else m for f, m in zip(flipped, marks)]
        one, two = (sorted((r.doc_id, r.score) for r in run(docs(spark, rows), labels(spark, m)).collect()) for m in (marks, other))
        assert one == two


def test_toxicity_on_held_out_rows(spark, corpus):
    rows, marks = corpus
    got = toxicity(docs(spark, rows + ODD), labels(spark, marks)).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    truth = {i: t for i, _, t in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(r.predicted == 0 for r in got if r.doc_id in (1000, 1001, 1002))


@pytest.mark.parametrize("run", [quality, toxicity])
def test_models_of_nothing(spark, run):
    assert run(docs(spark, []), labels(spark, [])).count() == 0
    got = run(docs(spark, [(1, "a"), (2, None)]), labels(spark, [(1, 1, 1)])).collect()
    assert len(got) == 2 and all(0 <= r.score <= 1 for r in got)


def test_dual_coordinate_descent_meets_the_optimality_conditions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    y = np.sign(x[:, 0] + 0.3 * rng.normal(size=80))
    rows = [(np.arange(6), r) for r in x]
    w = linear.hinge_dual(rows, y, 6, np.full(80, 0.5), epochs=3000)

    def objective(v):
        return 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v[:6] + v[6])).sum()

    best = objective(w)
    assert all(objective(w + 0.01 * rng.normal(size=7)) >= best - 1e-4 for _ in range(300))


def test_pu_risk_separates_with_labels_of_one_class():
    rng = np.random.default_rng(1)
    p, n = rng.normal(2, 1, size=(400, 3)), rng.normal(-2, 1, size=(1600, 3))
    unlabelled = np.concatenate([rng.normal(2, 1, size=(400, 3)), n])
    w = linear.nn_pu(p, unlabelled, 0.2)
    assert ((p @ w[:3] + w[3] > 0).mean() > 0.95) and ((n @ w[:3] + w[3] < 0).mean() > 0.95)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h2>Site</h2></header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, and say so at great length so that it counts for something.</div>
<div id="wrap" class="layout-with-sidebar"><article class="post-%d"><h1>Title &amp; more</h1><p>First   paragraph,<br>with a <b>bold</b> word.<p>Second &eacute;&#233;&#xe9; one.
<ul><li>item one<li>item two</ul><form>Your name <input></form><script>var x = "<p>no</p>";</script><div class="advert">Buy!</div>
<section class="comments"><p>Nice post indeed, thank you very much for it.</p></section></article><aside>Side</aside></div><footer>&copy; me</footer></body></html>"""
WANT = "Title & more\nFirst paragraph, with a bold word.\nSecond ééé one.\nitem one\nitem two"


def test_main_text_of_a_full_page():
    page = Page(PAGE % 7)
    assert page.text(page.best()) == WANT and page.path(page.best()).endswith("article.post-0")


def test_a_page_follows_its_host(spark):
    """A page whose own best container is another is read by the path that won on its host."""
    short = '<html><body><div class="text"><p>%s</p></div><div class="other"><p>%s</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", short % ("body text number %d " % i * 20, "x")) for i in range(4)]
    rows += [(9, "http://h.example/9", short % ("short article", "some long blurb " * 30)), (10, "http://alone.example/", PAGE % 1), (11, None, None), (12, "http://h.example/12", ""), (13, "http://h.example/13", "plain < text & more")]
    df = spark.createDataFrame([(*r, "p", "h", 1) for r in rows], "page_id long, url string, html string, path string, host string, size int").repartition(3)
    for hosts in (100, 0):
        got = {r.page_id: r for r in extract_main_text(df, broadcast_hosts=hosts).collect()}
        assert got[9].text == "short article" and got[10].text == WANT and got[11].text == "" and got[12].text == ""
        assert got[13].text == "plain < text & more" and all(r.n_chars == len(r.text) for r in got.values()) and len(got) == len(rows)
    assert extract_main_text(df.limit(0)).count() == 0


def test_a_body_in_several_siblings_is_whole(spark):
    """All containers of the winning path count, in page order, on pages with a host's path and on those by themselves."""
    page = '<html><body><nav>x</nav><div class="content"><div id="part-1"><p>%s</p></div><div id="part-2"><p>%s</p></div><div id="part-3" hidden><p>no</p></div></div><footer>f</footer></body></html>'
    many = "<html><body><div>" + "".join(f'<div class="section"><p>{"words of part " * (9 if i == 3 else 2)}{i}</p></div>' for i in range(6)) + "</div></body></html>"
    long, short = "a long part of it " * 30, "a shorter part " * 14
    rows = [(i, f"http://s.example/{i}", page % ((long, short) if i % 2 else (short, long))) for i in range(4)] + [(9, "http://m.example/", many)]
    alone = Page(page % (long, short))
    assert alone.text(*alone.find(None)) == f"{long.strip()}\n{short.strip()}"
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"{long.strip()}\n{short.strip()}" and got[2] == f"{short.strip()}\n{long.strip()}"
    assert got[9].split("\n") == [f"{'words of part ' * (9 if i == 3 else 2)}{i}" for i in range(6)]


@pytest.mark.parametrize("html", ["<", "<p", "<p>a<", "</", "<!--", "<!-- a", "<script>x", "<b><i></b></i>", "</p></p>", "<table><td>a<tr><td>b</table>", "&#xZZ; &amp &nope;", "<p " + "a=" * 500, "<div>" * 3000])
def test_broken_pages_give_some_text(html):
    page = Page(html)
    assert isinstance(page.text(page.best()), str)


def brute_archive(rows):
    first: dict[bytes, int] = {}
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    for i, b in raw:
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out, seen = [], set()
    for i, b in sorted(raw, key=lambda r: (r[0] is not None, r[0] or 0)):
        again = len(b) >= 100 and b in first and (i != first[b] or (i, b) in seen)
        seen.add((i, b))
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=repr)


def test_hostile_pages_take_linear_time():
    import time

    deep = 100_000
    pages = [
        "<div>" * deep + "deep text", "<div class=a1>x" * deep, "<ul>" * deep + "<li>t", "<p><table><td>" + "<b>" * deep + "<h1>t</h1>" * 20_000, "<b><table>" + "<i>" * deep + "</b></q>" * 20_000 + "end",
        "<a href=x>" * deep + "t", "<p>a" * deep, "</div>" * deep, "<a b='" * 20_000, "<a b = \"" * 20_000, "<script>" * deep, "<!--" * deep, "<li>x</li>" * deep,
    ]
    for html in pages:
        began = time.process_time()
        page = Page(html)
        page.text(*page.find(None))
        page.path(page.best())
        assert time.process_time() - began < 20, html[:40]


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(3)
    body = "é<p>" * 50
    rows = [(i, f"http://e.example/{i}", "".join(rng.choice("abc\r\n") for _ in range(rng.randrange(400)))) for i in range(60)]
    rows += [(70, "u", body), (71, None, body), (69, "u", body), (72, "u", ""), (73, "u", None), (74, "u", "short"), (75, "u", "short"), (69, "u", body), (None, "u", body), (10**15, "u", body), (-5, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*r, 1, "d", 2) for r in rows], "page_id long, url string, html string, shard int, digest string, kind int")
    cols = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in warc_round_trip(df.repartition(3)).collect()), key=repr) == brute_archive(rows)
    files = []
    for k, parts in enumerate((2, 5)):
        folder = tmp_path / str(k)
        written = write_warc(df.repartition(parts), f"file://{folder}", shard_bytes=3000, roll_bytes=900)
        assert read_warc(spark, f"file://{folder}").count() == len(rows) == written.agg({"records": "sum"}).first()[0]
        files.append({p.name: p.read_bytes() for p in sorted(folder.iterdir())})
        assert not [n for n in files[-1] if n.startswith(".")]
    assert files[0] == files[1] and sum(n.endswith(".gz") for n in files[0]) > 5
    total = json.loads(files[0]["MANIFEST.json"])
    named = [f for n, b in files[0].items() if n.startswith("shard") and n.endswith("json") for f in json.loads(b)["files"]]
    assert total["records"] == len(rows) and sum(f["records"] for f in named) == len(rows) and {f["name"] for f in named} == {n for n in files[0] if n.endswith("gz")}
    for n, b in files[0].items():
        if n.endswith("gz"):
            assert all(h["WARC-Type"] in ("response", "revisit") for h, _ in read_records(gzip.decompress(b)))
    assert warc_round_trip(df.limit(0)).count() == 0


def test_urls_cannot_break_headers(spark):
    urls = ["http://a/\r\n\r\nx", "http://a/\r\nWARC-Type: revisit\r\nContent-Length: 0", "\n", "\x85\u2028é", None]
    df = spark.createDataFrame([(i, u, "body") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type) for r in warc_round_trip(df).collect()) == [(i, 4, "response") for i in range(len(urls))]


def test_shards_stay_small_whatever_the_keys(spark, tmp_path):
    rng = random.Random(9)
    keys = [k * 10**9 + j for k in range(150) for j in range(8)]  # more crowded cells than are cut at a time
    keys += [77] * 400 + [None] * 300  # one key, and no key, of very many records
    rows = [(k, "u", f"{i} " + "".join(rng.choice("abcdef") for _ in range(120))) for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    written = write_warc(df, f"file://{tmp_path}", shard_bytes=2000).groupBy("shard").sum("records").collect()
    assert sum(r[1] for r in written) == len(rows) and max(r[1] for r in written) < 45  # 16 of 125 bytes are meant to be in one
    cols = ("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in cols) for r in read_warc(spark, f"file://{tmp_path}").collect()), key=repr) == brute_archive(rows)


def test_members_of_any_chunk():
    parts = [b"a" * n for n in (0, 1, 70_000, 5)]
    raw = b"".join(gzip.compress(p) for p in parts)
    for chunk in (1, 7, 1 << 16):
        assert list(members(io.BytesIO(raw), chunk)) == parts
    with pytest.raises(ValueError):
        list(members(io.BytesIO(raw[:-3])))


def test_pipeline_on_a_small_folder(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    given = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, folder).collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "mix"]
    assert out and len({r.doc_id for r in out}) == len(out) and len({r.text for r in out}) == len(out)
    assert all(given[r.doc_id].text == r.text and 0 < r.copies <= 3 and r.taken == r.copies * r.size for r in out)


def test_each_pipeline_stage_keeps_what_brute_force_keeps(spark, tmp_path):
    """Planted copies, near copies and benchmark passages; mixing by its SQL, quality by the classifier's own verdicts."""
    import duckdb

    import __spark_entry__
    import corpus_pipeline
    from tidemark.llm.near_dedup import THRESHOLD

    from .test_text_operators import bag, overlap, words

    rng = random.Random(12)
    base = [words(rng, rng.randrange(30, 90), 10**6) for _ in range(60)]
    items = [(1, words(rng, 12, 10**6)), (2, words(rng, 25, 10**6)), (3, None)]
    made = list(enumerate(base))
    made += [(100 + i, base[i]) for i in range(15)]  # copies
    for i in range(10, 30):  # near copies
        w = base[i].split()
        w[rng.randrange(len(w))] = "changed"
        made.append((200 + i, " ".join(w)))
    made += [(300 + i, f"{words(rng, 40, 10**6)} {items[i % 2][1]} {words(rng, 9, 10**6)}") for i in range(6)]
    made += [(400 + i, (words(rng, 1) + " ") * 60) for i in range(25)]  # low quality
    given = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in made], "doc_id long, text string, source string").repartition(3)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    marks = labels(spark, [(i, int(i < 400), 0) for i, _ in made])
    marks.write.parquet(str(tmp_path / "labels.parquet"))

    def by_quality(rows):
        told = {r.doc_id: r.predicted for r in quality(given, marks).collect()}
        return {i for i in rows if told[i]}

    def by_text(rows):
        return {max(j for j, u in rows.items() if u == t) for t in rows.values()}

    def by_overlap(rows):
        bags = {i: bag(t) for i, t in rows.items()}
        kept, seen = set(), set()
        for i in sorted(rows):
            if i in seen:
                continue
            kept.add(i)
            todo = [i]
            while todo:
                x = todo.pop()
                seen.add(x)
                todo += [y for y in rows if y not in seen and overlap(bags[x], bags[y]) >= THRESHOLD]
        return kept

    def by_items(rows):
        def cuts(t):
            w = t.split()
            return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

        return {i for i, t in rows.items() if not any(x and len(cuts(t) & cuts(x)) >= 0.5 * len(cuts(x)) for _, x in items)}

    def by_sql(rows):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/decontaminate/*.parquet'")
        got = con.execute(__spark_entry__.oracle_sql()["op6_mix_sources"])
        at = [c[0] for c in got.description]
        return {r[at.index("doc_id")] for r in got.fetchall() if r[at.index("taken")] > 0}

    brute = {"quality": by_quality, "exact": by_text, "near": by_overlap, "decontaminate": by_items, "mix": by_sql}
    docs, rows, lost = given, dict(made), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        want = brute[name](rows)
        assert sorted(ids) == sorted(want), name
        lost[name] = len(rows) - len(want)
        rows = {i: rows[i] for i in want}
    assert lost["quality"] >= 20 and lost["exact"] >= 15 and lost["near"] >= 20 and lost["decontaminate"] >= 6
