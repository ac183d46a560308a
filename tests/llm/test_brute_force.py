"""Operators that SQL can't express, held against plain statements of themselves."""

from __future__ import annotations

import html.parser
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _bytes as B
from tidemark.llm import _features, quality, toxicity
from tidemark.llm import licenses as L
from tidemark.llm import near_dedup as N
from tidemark.llm.html_extract import extract_main_text

from .test_text_operators import bag, overlap, words

MASK = 2**64 - 1


def mixed(x: int) -> int:
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def hashed(x: int, kind: int, bits: int) -> int:
    return mixed((x + kind * 0x9E3779B97F4A7C15) & MASK) >> 64 - bits


def word_hash(word: str | bytes) -> int:
    """Of a word as bytes: a polynomial in the base, with the length, mixed."""
    raw = word.encode() if isinstance(word, str) else word
    return mixed((sum(c * pow(B._BASE, i, 2**64) for i, c in enumerate(raw)) + len(raw)) & MASK)


def plain_features(text: str | None, word_grams=(), shape_grams=(), runs=(), heads=(), bits=_features.BITS) -> set[int]:
    said = B.word_list(text)
    out = {hashed(word_hash(w), 1, bits) for w in said if word_grams}
    for n in runs:
        if any(len(set(said[i : i + n])) == 1 for i in range(len(said) - n + 1)):
            out.add(hashed(n, 200, bits))
    for n in heads:
        times = Counter(hashed(word_hash(w.encode()[:n]), 300 + n, bits) for w in said if len(w.encode()) > n)
        out |= set(times)
        for f, t in times.items():
            out |= {hashed(f, 400 + 10 * n + level, bits) for level, least in enumerate(_features.RATES) if t >= 2 and t * least >= len(said)}
    code = [int(_features.SHAPE[b]) for b in (text or "").encode()]
    for n in shape_grams:
        for i in range(len(code) - n + 1):
            x = 0
            for c in code[i : i + n]:
                x = x << 6 | c
            out.add(hashed(x, 100 + n, bits))
    return out


def plain_score(model: dict, features: set[int]) -> float:
    if "known" in model:
        at = {f: i for i, f in enumerate(model["known"].tolist())}
        places = [at[f] for f in features if f in at]
    else:
        places = sorted(features)
    total = sum(float(model["weights"][i]) for i in places)
    if "scale" in model:
        total /= max(1e-9, math.sqrt(sum(float(model["scale"][i]) for i in places)))
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, model["slope"] * (total + model["bias"]) + model["offset"]))))


@pytest.fixture(scope="module")
def corpus(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    rows += [(10**6 + i, t) for i, t in enumerate([None, "", "!!!", "no no no no no no no", "ÄÖ ß日本語 x1 " * 40, "ab" * 3000, "Tab\tand\r\nline", "word"])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, spark.read.parquet(f"{d}/labels.parquet")


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_scores_are_those_of_the_model_in_plain_python(spark, corpus, name):
    docs, rows, labels = corpus
    if name == "quality":
        model = quality.train_quality(docs, labels, F.lit(True))
        got, grams = quality.score_quality(docs, model), quality.GRAMS
    else:
        model = toxicity.train_toxicity(docs, labels, F.lit(True), least_z=2.0)
        got, grams = toxicity.score_toxicity(docs, model), toxicity.GRAMS
        assert len(model["known"]) > 0
    want = {i: plain_score(model, plain_features(t, **grams)) for i, t in rows}
    found = {r.doc_id: r.score for r in got.collect()}
    assert found.keys() == want.keys()
    assert max(abs(found[i] - want[i]) for i in want) < 1e-6 and len({round(x, 6) for x in want.values()}) > 10


def test_log_count_ratios_are_counted_one_by_one():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 30, 8)) for _ in range(40)]
    y = rng.integers(0, 2, 40)
    row = np.repeat(np.arange(40), [len(t) for t in texts])
    got = quality.linear.log_count_ratio(row, np.concatenate(texts), y, 30)
    p = [1 + sum(f in t for t, k in zip(texts, y) if k == 1) for f in range(30)]
    q = [1 + sum(f in t for t, k in zip(texts, y) if k == 0) for f in range(30)]
    assert np.allclose(got, [math.log(p[f] / sum(p)) - math.log(q[f] / sum(q)) for f in range(30)])


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_notices(text: str, notices, rate: float) -> tuple[set[str], list[tuple[int, int]], float]:
    """Labels, (first word, errors) and score: every run of words against every notice, the fewest errors for its length first."""
    said = B.word_list(text)
    found = []
    for notice, label in notices:
        e = L.errors_allowed(notice, rate)
        for i in range(len(said)):
            for j in range(i + 1, len(said) + 1):
                span = " ".join(said[i:j])
                if len(span) > len(notice) + e:
                    break
                if abs(len(span) - len(notice)) <= e and (d := edits(notice, span)) <= e:
                    found.append((d / len(notice), -len(notice), i, j, label, d))
    taken: list[tuple] = []
    for f in sorted(found):
        if all(f[3] <= t[2] or t[3] <= f[2] for t in taken):
            taken.append(f)
    return {t[4] for t in taken}, sorted((t[2], t[5]) for t in taken), max((1 - t[0] for t in taken), default=0.0)


def test_labels_score_and_spans_equal_a_plain_matcher(spark):
    rng = random.Random(21)
    notices = tuple(L.NOTICES[i] for i in (0, 1, 4, 9, 13))
    texts = [None, "", "nothing here", "licensed under the mlt licence foo licensed under the mit license"]
    for _ in range(50):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            t = list(rng.choice(notices)[0])
            for _ in range(rng.randrange(5)):
                p = rng.randrange(len(t))
                t[p : p + 1] = rng.choice([[], ["q"], [t[p], "z"]])
            parts += ["".join(t), rng.choice(["and then more", "of", "", "x y"])]
        texts.append(" ".join(parts))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = 0
    for r in L.scan_licenses(df, phrases=(), notices=notices).collect():
        labels, spans, score = plain_notices(texts[r.doc_id] or "", notices, 0.1)
        assert r.labels == ",".join(sorted(labels)) and abs(r.score - score) < 1e-12, texts[r.doc_id]
        assert [(s.first_word, s.errors) for s in r.spans] == spans, texts[r.doc_id]
        hits += len(spans)
    assert hits > 50


class Plain(html.parser.HTMLParser):
    """The text of the article by another parser: blocks between block tags, without what stands in furniture."""

    BLOCKS = frozenset("article p h1 h2 h3 div ul ol li blockquote section".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside += 1
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag in ("br", "img"):
            self.blocks[-1] += " "
        if tag in ("script", "style", "nav", "aside", "form", "footer"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag == "article":
            self.inside -= 1
        if tag in self.BLOCKS:
            self.blocks.append("")
        if tag in ("script", "style", "nav", "aside", "form", "footer"):
            self.skip -= 1

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data


def test_main_text_equals_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract_main_text(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r.html)
        plain.close()
        want = "\n".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want), r.page_id


def test_main_text_of_made_pages(spark):
    """Bodies in random containers among furniture: the blocks that were put in come out, and nothing else."""
    rng = random.Random(31)
    rows, want = [], {}
    for i in range(90):
        host = i % 3
        body = [words(rng, rng.randrange(25, 60)) for _ in range(rng.randrange(2, 7))]
        box = (("<div class='story'>", "</div>"), ("<article>", "</article>"), ("<main><div id='txt-%d'>" % i, "</div></main>"))[host]
        inner = "".join(f"<p>{b}</p>" if rng.random() < 0.7 else f"<blockquote>{b}</blockquote>" for b in body)
        menu = "<ul>" + "".join(f"<li><a href='/{k}'>{words(rng, 2)}</a></li>" for k in range(9)) + "</ul>"
        noise = f"<div class='cookie-banner'>{words(rng, 50)}</div><aside><p>{words(rng, 40)}</p></aside>"
        tail = f"<div class='comments'><p>{words(rng, 70)}</p></div><footer><p>{words(rng, 30)}</p></footer><script>{words(rng, 99)}</script>"
        rows.append((i, f"http://h{host}.example/{i}", f"<html><body><nav>{menu}</nav>{noise}{box[0]}{inner}{box[1]}{tail}</body></html>"))
        want[i] = "\n".join(body)
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.page_id: r.text for r in got} == want


def test_recall_of_near_duplicates_is_measured(spark):
    """Every row whose id is divisible by 50 against all rows: the share of pairs at the threshold or above that end in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: bag(r.text) for r in docs.collect()}
    found = {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()}
    pairs = [(q, i) for q in rows if q % 50 == 0 for i in rows if i != q and rows[q] and overlap(rows[q], rows[i]) >= N.THRESHOLD]
    caught = sum(found[a] == found[b] for a, b in pairs)
    print(f"near duplicates: {caught} of {len(pairs)} pairs")
    assert caught >= 0.9 * len(pairs)
