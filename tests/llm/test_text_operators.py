"""Operators over whole texts, held against brute force on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from tidemark.llm import _bytes as B
from tidemark.llm import decontaminate as D
from tidemark.llm import licenses as L
from tidemark.llm import near_dedup as N
from tidemark.llm import substring_dedup as S
from tidemark.llm.exact_dedup import drop_exact_duplicates, exact_dedup, misra_gries
from tidemark.llm.graph import components
from tidemark.llm.mixing import mix_sources, take_mix, targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, h long, d string, q long, hub string"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, None, "x", 1, "y", 2, "z") for i, t, s in rows], SCHEMA).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(20, 120)) for _ in range(30)]
    passage = words(rng, 60)
    out = [(i, t, "a") for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):  # near copies
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        out.append((100 + i, " ".join(w), "b"))
    out += [(200 + i, t, "b") for i, t in enumerate(base[5:15])]  # copies
    out += [(300 + i, words(rng, 5) + " " + passage + " " + words(rng, 5), "c") for i in range(6)]
    out += [(400, None, None), (401, "", "a"), (402, "   \n", "a"), (403, "!!! ???", "a"), (404, "one", "b"), (405, "one two", "b"), (406, "Ünï çödé ☃ Ünï çödé", "c")]
    out += [(407, "ab" * 40, "c"), (408, "ab" * 40, "c"), (409, "long " * 30000, "a"), (None, base[0], "a"), (None, None, None), (7, base[7], "a")]
    return out


def sorted_rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def brute_repeats(rows, length=50):
    inf = float("inf")
    first: dict[bytes, float] = {}
    raw = [(inf if i is None else i, (t or "").encode()) for i, t, _ in rows]
    for i, b in raw:
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            first[w] = min(first.get(w, inf), i)
    out = []
    for (i, b), (key, _, _) in zip(raw, rows):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < i:
                gone[s : s + length] = True
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


COLS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_equal_brute_force(spark, rows):
    small = [r for r in rows if r[0] != 409]
    assert sorted_rows(S.remove_repeats(table(spark, small), group_bytes=2000, part_bytes=1500), *COLS) == brute_repeats(small)


@pytest.mark.parametrize("hot", [0, 3, 8])
def test_repeats_with_hot_anchors_equal_brute_force(spark, rows, hot):
    small = [r for r in rows if r[0] != 409]
    assert sorted_rows(S.remove_repeats(table(spark, small), group_bytes=2000, part_bytes=1500, hot=hot), *COLS) == brute_repeats(small)


def test_repeats_of_periodic_and_nested_texts(spark):
    rng = random.Random(1)
    shared = words(rng, 40)
    made = [(i, shared[k : k + 80] + words(rng, 3) + "\0" * k + "a" * (60 + i), "s") for i, k in enumerate([0, 3, 20, 50, 100, 120, 140, 9])]
    made += [(20, "é" * 49, "s"), (21, "xé" + "é" * 49, "s"), (22, "", "s")]
    assert sorted_rows(S.remove_repeats(table(spark, made), group_bytes=300, part_bytes=100), *COLS) == brute_repeats(made)


def test_repeats_on_one_very_long_text(spark):
    rng = random.Random(2)
    text = words(rng, 60000, 10**6)
    got = {r.doc_id: r for r in S.remove_repeats(table(spark, [(1, text[200_000:200_300], "s"), (2, text, "s")])).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_spans) == (0, 300, 1)


def test_prefix_intervals_are_the_nodes_of_the_tree():
    rng = random.Random(3)
    for _ in range(20):
        texts = sorted("".join(rng.choice("ab") for _ in range(8)) for _ in range(30))
        common = [next((k for k in range(8) if a[k] != b[k]), 8) for a, b in zip(texts, texts[1:])]
        size, low, high = S.prefix_intervals(np.array(common), 3)
        got = set(zip(size.tolist(), low.tolist(), high.tolist()))
        want = set()
        for length in range(3, 9):
            for a in range(len(texts)):
                for b in range(a + 1, len(texts)):
                    least = min(common[a:b])
                    if least == length and (a == 0 or common[a - 1] < length) and (b == len(texts) - 1 or common[b] < length):
                        want.add((length, a, b))
        assert got == want


def test_exact_dedup_equals_brute_force(spark, rows):
    got = exact_dedup(table(spark, rows), counters=4)
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert sorted_rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_filter_keeps_one_of_each_text(spark, rows):
    kept = drop_exact_duplicates(table(spark, rows), counters=4)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    texts = Counter(r.text or "" for r in kept.collect())
    assert set(texts) == {t or "" for _, t, _ in rows}
    assert set(texts.values()) == {1}  # the row that is there twice too


@pytest.mark.parametrize("drop", [drop_exact_duplicates, N.drop_near_duplicates])
def test_filters_keep_the_same_rows_whatever_their_size(spark, rows, drop, tmp_path):
    table(spark, rows).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    many, few = (sorted_rows(drop(read, few=n), "doc_id", "text", "source", "hub") for n in (0, 10**6))
    assert many == few and len(few) < len(rows)


def test_misra_gries_finds_every_frequent_key():
    rng = np.random.default_rng(0)
    keys = np.concatenate([np.full(400, 7), np.full(250, 9), rng.integers(100, 10**6, 1350)])
    rng.shuffle(keys)
    held: dict[int, int] = {}
    for block in np.array_split(keys, 17):
        held = misra_gries(block, 9, held)
    assert {7, 9} <= set(held) and len(held) <= 9
    assert 400 - len(keys) / 10 <= held[7] <= 400


def bag(text, k=3):
    w = B.word_list(text)
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def overlap(a, b):
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 0.0


def test_near_duplicates_equal_brute_force(spark, rows):
    found = N.near_duplicates(table(spark, rows)).collect()
    got = {r.doc_id: r for r in found if r.doc_id is not None}
    keyed = [(i, bag(t)) for i, t, _ in rows if i is not None]
    parent = {i: i for i, _ in keyed}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in keyed:
        for j, b in keyed:
            if i < j and overlap(a, b) >= N.THRESHOLD:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    assert {i: r.class_id for i, r in got.items()} == {i: find(i) for i in parent}
    assert all(r.kept == (i == r.class_id) for i, r in got.items())
    assert got[404].class_size == 1 and got[400].class_id == 400 and got[403].n_links == 0
    assert sum(r.class_id is None for r in found) == 2
    kept = N.drop_near_duplicates(table(spark, [r for r in rows if r[0] is None or r[0] < 104]))
    assert "hub" in kept.columns and kept.where("doc_id is null").count() == 2


def test_links_of_near_copies_equal_brute_force(spark, monkeypatch):
    """Every pair of a group counts, not those with the smallest ids alone."""
    monkeypatch.setattr(N, "BLOCK", 3)
    rng = random.Random(11)
    made = []
    for group, edits in enumerate((1, 3, 9)):
        base = words(rng, 60).split()
        for i in range(12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            made.append((100 * group + i, " ".join(w), "a"))
        made.append((100 * group + 50, made[-1][1], "b"))  # a copy is the same vertex
    # 160 bands of 1: every linked pair is a candidate
    pairs = {(i, j) for i, a, _ in made for j, b, _ in made if bag(a) != bag(b) and overlap(bag(a), bag(b)) >= N.THRESHOLD}
    reps = {i: min(j for j, b, _ in made if bag(b) == bag(a)) for i, a, _ in made}
    want = {i: sum(1 for x, y in pairs if x == i and reps[y] == y) for i, _, _ in made}
    assert max(want.values()) == 11 and len({i // 100 for i, n in want.items() if 0 < n < 11})
    got = {r.doc_id: r.n_links for r in N.near_duplicates(table(spark, made), bands=160, rows=1).collect()}
    assert got == want


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    n, trials = 120, 150
    a, ca = np.arange(n, dtype=np.uint64), rng.integers(1, 4, n)
    cb = np.maximum(0, ca + rng.integers(-2, 9, n) * (rng.random(n) < 0.4))
    true = np.minimum(ca, cb).sum() / np.maximum(ca, cb).sum()
    xs, rs, cs = [], [], []
    for s in range(trials):
        h = B.mix(B.mix(a + np.uint64(1 + 1000 * s)))
        for k, c in ((0, ca), (1, cb)):
            xs.append(h[c > 0])
            cs.append(c[c > 0])
            rs.append(np.full(int((c > 0).sum()), 2 * s + k))
    sig = N.signatures(np.concatenate(rs), np.concatenate(xs), np.concatenate(cs), 2 * trials).reshape(trials, 2, -1)
    agree = (sig[:, 0] == sig[:, 1]).mean(1)
    assert abs(agree.mean() - true) < 4 * agree.std() / trials**0.5
    assert agree.std() < 1.3 * (true * (1 - true) / 128) ** 0.5


def test_rows_that_repeat_a_key_are_judged_by_their_text(spark):
    same, other = "a b c d e f g h", "totally other words that nothing else here has"
    rows = [(5, same, "s"), (5, other, "s"), (3, same, "t"), (3, same, "u"), (9, other, "t"), (None, same, "s"), (7, None, "s")]
    df = table(spark, rows)
    assert sorted_rows(N.drop_near_duplicates(df), "doc_id", "text", "source") == sorted([r for r in rows if r not in [(5, same, "s"), (9, other, "t")]], key=repr)
    found = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in N.near_duplicates(df).collect()}
    assert found == {(5, 3, 3, False), (5, 5, 2, True), (3, 3, 3, True), (9, 5, 2, False), (None, None, 1, True), (7, 7, 1, True)}


def test_packed_bags_come_back():
    x = np.array([0, 5, 2**48 - 1], np.uint64)
    for count in ([1, 1, 1], [1, 70_000, 2]):
        got = N.unpack(N.pack(x, np.array(count)))
        assert got[0].tolist() == x.tolist() and got[1].tolist() == count
    assert len(N.unpack(N.pack(x[:0], np.array([], int)))[0]) == 0


def test_links_that_stars_miss_are_found(spark):
    """A chain a - b - c - d of near neighbours whose ends are far apart is one class."""
    rng = random.Random(9)
    base = words(rng, 200, 10**6).split()
    made = []
    for i in range(6):
        w = list(base)
        for k in range(i * 10, i * 10 + 10):
            w[k] = f"other{i}x{k}"
        base = w
        made.append((i, " ".join(w), "s"))
    got = {r.doc_id: r.class_id for r in N.near_duplicates(table(spark, made)).collect()}
    assert set(got.values()) == {0}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_licenses_equal_brute_force(spark, rows):
    made = rows + [
        (500, "x MIT License; and the mit   license, GENERAL public\tLicense.", "s"), (501, "Licensed undr the Apach License, Version 2.0", "s"),
        (502, "Licensed under CC BY-NC 4.0.", "s"), (503, "limit licenses submit license", "s"), (504, "Relased under the MIT-License", "s"), (505, "ümit license", "s"),
    ]
    got = sorted_rows(L.scan_licenses(table(spark, made)), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    want = []
    for i, t, _ in made:
        w = B.word_list(t)
        hits = [(k, label) for p, label in L.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in hits]
        want.append((i, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=repr)
    by = {r.doc_id: r for r in L.scan_licenses(table(spark, made)).collect()}
    assert by[501].labels == "apache" and by[501].spans[0].errors == 2 and 0.9 < by[501].score < 1
    assert by[502].labels == "cc-by-nc" and by[502].score == 1.0 and by[504].labels == "mit" and by[500].labels == "gpl,mit"
    assert by[400].score == 0 and by[503].labels == ""


def test_fuzzy_notices_are_those_of_a_plain_search():
    """The pigeonhole seeds lose nothing that the bounded-error pattern finds in the whole text."""
    rng = random.Random(4)
    notices = L.Notices()
    for _ in range(150):
        k = rng.randrange(len(L.NOTICES))
        t = list(L.NOTICES[k][0])
        for _ in range(rng.randrange(notices.errors[k] + 1)):
            p = rng.randrange(len(t))
            t[p : p + 1] = rng.choice([[], ["q"], [t[p], "z"]])
        text = "before it " + "".join(t) + " after it\n"
        plain = regex.search(notices.patterns[k].pattern.replace("(?b)", ""), text)
        if plain:
            assert any(a < plain.end() and plain.start() < b for a, b, _, _ in notices.find(text)), text


def test_notices_with_errors_beside_better_ones_are_found(spark):
    """A better match hides no other, in the same document or in the next."""
    exact, one, two = "licensed under the mit license", "licensed under the mit licence", "licensed undr the mit licence"
    find = L.Notices().find

    def said(text):
        return [(text[a:b], errors) for a, b, _, errors in find(text)]

    assert said(f"{two} {exact}") == [(two, 2), (exact, 0)]
    assert said(f"{one}\n{exact}\n{two}\n") == [(one, 1), (exact, 0), (two, 2)]
    assert said(f"a {two} {one} {two} of {exact} {one}") == [(two, 2), (one, 1), (two, 2), (exact, 0), (one, 1)]
    rng = random.Random(8)
    notices = L.Notices()
    lines = []
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            t = list(L.NOTICES[rng.randrange(3)][0])
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = "q"
            parts.append("".join(t))
        lines.append(" ".join(parts))
    text, at, want = "\n".join(lines) + "\n", 0, []
    for line in lines:  # each on its own
        want += [(at + a, at + b, i, e) for a, b, i, e in notices.find(line + "\n")]
        at += len(line) + 1
    assert notices.find(text) == want
    got = {r.doc_id: [(s.first_word, s.errors) for s in r.spans] for r in L.scan_licenses(table(spark, [(1, one, "s"), (2, f"{two} {exact}", "s"), (3, exact, "s")]).coalesce(1)).collect()}
    assert got == {1: [(0, 1)], 2: [(0, 2), (5, 0)], 3: [(0, 0)]}


def test_a_long_run_of_near_notices_takes_linear_time():
    import time

    finder, part = L.Notices(), "licensed under the mlt licence foo "
    began = time.process_time()
    assert len(finder.find((part * 30_000).strip())) == 30_000  # 1 MB in one line
    assert time.process_time() - began < 60


def test_contamination_equals_brute_force(spark, rows):
    rng = random.Random(6)
    items = [(i, words(rng, n, 10**6)) for i, n in enumerate([1, 3, 5, 8, 20, 60, 150])] + [(50, None), (51, ""), (None, "x y z"), (52, "  ...")]
    docs = list(rows)
    for i, t in items[:7]:
        w = t.split()
        docs.append((600 + i, words(rng, 300) + " " + t.upper() + ", " + words(rng, 200), "s"))
        docs.append((700 + i, words(rng, 3000) + " " + " ".join(w[: max(1, len(w) * 3 // 4)]) + " " + words(rng, 10), "s"))
        docs.append((800 + i, words(rng, 50) + " " + " ".join(w[: len(w) // 4]) + " " + words(rng, 50), "s"))
    given = spark.createDataFrame(items, "item_id long, text string")
    got = sorted_rows(D.contaminated(table(spark, docs), given, block_bytes=600), "doc_id", "item_id", "shared", "shingles")
    want = []
    for i, t, _ in docs:
        w = B.word_list(t)
        for j, x in items:
            v = B.word_list(x)
            k = min(5, len(v))
            if j is None or not k:
                continue
            own = {tuple(v[s : s + k]) for s in range(len(v) - k + 1)}
            shared = own & {tuple(w[s : s + k]) for s in range(len(w) - k + 1)}
            if len(shared) >= 0.5 * len(own):
                want.append((i, j, len(shared), len(own)))
    assert got == sorted(want, key=repr)
    hit = {w[0] for w in want}
    assert sorted_rows(D.decontaminate(table(spark, docs), given), "doc_id") == sorted([(i,) for i, _, _ in docs if i not in hit], key=repr)


def test_mix_targets_and_caps(spark, rows):
    got = mix_sources(table(spark, rows)).collect()
    total = sum(r.size for r in got)
    by: dict = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert r.source_size == sum(x.size for x in got if x.source == r.source)
    assert abs(sum(own[0].target for own in by.values()) - min(total, 3 * total)) < 1e-6 * total
    for own in by.values():
        assert own[0].target <= 3 * own[0].source_size + 1e-9
        if sum(r.size > 0 for r in own) > 5:
            assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert sorted_rows(mix_sources(table(spark, rows)), "doc_id", "taken") == sorted_rows(mix_sources(table(spark, rows).repartition(7)), "doc_id", "taken")


def test_the_mix_takes_rows_by_their_own_text(spark, rows):
    df = table(spark, [*rows, (5, "only two", "a"), (5, "", "b")])
    per_row = sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.source or "", r.copies) for r in mix_sources(df).collect() if r.copies)
    took = take_mix(df)
    assert took.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "h", "d", "q", "hub", "copies", "size", "source_size", "target", "taken"]
    got = took.collect()
    assert all(r.size == len((r.text or "").split()) and r.taken == r.copies * r.size for r in got)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.source or "", r.copies) for r in got) == per_row


def test_water_filling_equals_brute_force(spark):
    rng = random.Random(8)
    for case in range(4):
        sizes = [(f"s{i}" if i else None, rng.choice([0, 3, 50, 4000])) for i in range(3 + 4 * case)]
        got = {r.source: r.target for r in targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
        order = sorted((s for s, _ in sizes if s is not None)) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        size, total, fixed = dict(sizes), sum(n for _, n in sizes), {}
        while True:
            free = [s for s in order if s not in fixed]
            level = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
            over = [s for s in free if weight[s] * level > 3 * size[s]]
            if not over:
                break
            fixed |= {s: 3 * size[s] for s in over}
        want = {s: fixed.get(s, weight[s] * level) for s in order}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("run", [exact_dedup, N.near_duplicates, S.remove_repeats, L.scan_licenses, mix_sources, drop_exact_duplicates, N.drop_near_duplicates])
def test_empty_tables(spark, run):
    assert run(table(spark, [])).count() == 0


def test_empty_items(spark, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(table(spark, rows), none).count() == 0
    assert D.decontaminate(table(spark, rows), none).count() == len(rows)
    assert D.contaminated(table(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_words_are_those_of_the_plain_statement():
    import pyarrow as pa

    rng = random.Random(11)
    texts = ["".join(rng.choice("abZ09 .,\n\t☃é/@[`{\x7f") for _ in range(rng.randrange(30))) for _ in range(300)] + [None, "", "A", "é"]
    raw, off = B.text_buffers(pa.array(texts))
    s, e, row, h = B.words(raw, off)
    got: dict[int, list[str]] = {}
    for a, b, r in zip(s, e, row):
        got.setdefault(int(r), []).append(B.LOWER[raw[a:b]].tobytes().decode())
    assert [got.get(i, []) for i in range(len(texts))] == [B.word_list(t) for t in texts]
    seen: dict[int, str] = {}
    for x, r, a, b in zip(h.tolist(), row, s, e):
        assert seen.setdefault(x, B.LOWER[raw[a:b]].tobytes()) == B.LOWER[raw[a:b]].tobytes()
    assert zlib.crc32(b"1") == 2212294583
