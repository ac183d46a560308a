"""License scans: exact phrases, and short notices found with errors.

A notice of e allowed errors is split into e + 1 pieces; where it stands with at most e errors, one piece stands unharmed
(pigeonhole). An Aho-Corasick automaton finds all pieces in one pass over the normalised text, and the regex library
matches the notice with bounded errors around each find, in the text's own line; the best match of all is taken first and
what it leaves free is searched again. Texts are normalised to their words (ASCII letters in lower case)
with single spaces; errors count bytes of UTF-8.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import LOWER, slices, text_buffers, words
from tidemark.session import ship

PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
)


def errors_allowed(notice: str, rate: float) -> int:
    return max(1, int(len(notice) * rate))


class Notices:
    """The automaton over all pieces and a fuzzy pattern for each notice."""

    def __init__(self, notices: tuple[tuple[str, str], ...] = NOTICES, rate: float = 0.1) -> None:
        self.notices = [(n.encode().decode("latin-1"), label) for n, label in notices]
        self.errors = [errors_allowed(n, rate) for n, _ in self.notices]
        self.patterns = []
        self.grams = [[n[k : k + 3] for k in range(len(n) - 2)] for n, _ in self.notices]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for i, ((notice, _), e) in enumerate(zip(self.notices, self.errors)):
            self.patterns.append(regex.compile(rf"(?b)(?<![^ \n])(?:{regex.escape(notice, literal_spaces=True)}){{e<={e}}}(?![^ \n])"))
            edges = [len(notice) * k // (e + 1) for k in range(e + 2)]
            for a, b in zip(edges, edges[1:]):
                pieces.setdefault(notice[a:b], []).append((i, a))
        self.finder = ahocorasick.Automaton()
        for piece, where in pieces.items():
            self.finder.add_word(piece, (len(piece), where))
        self.finder.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(start, end, notice, errors) of the matches in a text of lines, no two overlapping; the fewest errors win."""
        windows = set()
        for end, (size, where) in self.finder.iter(text):
            start = end + 1 - size
            for i, a in where:
                e, n = self.errors[i], len(self.notices[i][0])
                # where the notice of this piece may stand, in the piece's own line
                low, high = max(0, start - a - e), min(len(text), start - a + n + e)
                low = max(low, text.rfind("\n", low, start) + 1)
                stop = text.find("\n", end + 1, high)
                windows.add((i, low, high if stop < 0 else stop))
        best: list[tuple[float, int, int, int, int, int, int, int]] = []

        def search(i: int, low: int, high: int) -> None:
            """The best match of a notice in whole words of a piece of a line waits for its turn."""
            if low and text[low - 1] not in " \n":
                low = text.find(" ", low, high) + 1
                if not low:
                    return
            if high < len(text) and text[high] not in " \n":
                high = text.rfind(" ", low, high)
            e, n = self.errors[i], len(self.notices[i][0])
            if high - low < n - e:
                return
            segment = text[low:high]
            # e errors spoil 3 e of a notice's trigrams at most (q-gram lemma): too few left, no match
            if sum(g in segment for g in self.grams[i]) < len(self.grams[i]) - 3 * e:
                return
            m = self.patterns[i].search(segment)
            if m:
                errors = sum(m.fuzzy_counts)
                heapq.heappush(best, (errors / n, -n, low + m.start(), low + m.end(), i, errors, low, high))

        for window in windows:
            search(*window)
        kept: list[tuple[int, int, int, int]] = []
        while best:
            _, _, a, b, i, errors, low, high = heapq.heappop(best)
            at = bisect.bisect(kept, (a, b, i, errors))
            # those kept don't overlap, so only the neighbours can
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                kept.insert(at, (a, b, i, errors))
            # what is free of the window may hold another
            at = max(0, bisect.bisect(kept, (low,)) - 1)
            while at < len(kept) and kept[at][0] < high:
                if kept[at][1] > low:
                    search(i, low, kept[at][0])
                    low = kept[at][1]
                at += 1
            search(i, low, high)
        return kept


def normalised(raw: np.ndarray, off: np.ndarray) -> bytes:
    """Each text's words with single spaces, a line a text."""
    code = LOWER[raw]
    code[code == 0] = 32
    flat = np.full(len(raw) + len(off) - 1, 10, np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(len(off) - 1), np.diff(off))
    flat[at] = code
    blank = (flat == 32) | (flat == 10)
    before = np.ones(len(flat), bool)
    before[1:] = blank[:-1]
    # a space goes where a blank is before it, and then where only the line's end is after it
    out = flat[~((flat == 32) & before)]
    last = np.zeros(len(out), bool)
    last[:-1] = (out[:-1] == 32) & (out[1:] == 10)
    return out[~last].tobytes()


def _scan(phrases: tuple[tuple[str, str], ...], notices: tuple[tuple[str, str], ...], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Notices(notices, rate)
        wanted = []
        for phrase, label in phrases:
            raw, off = text_buffers(pa.array([phrase]))
            wanted.append((words(raw, off)[3], label))
        span_type = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int64())]))
        for batch in batches:
            raw_all, off_all = text_buffers(batch.column(1))
            counts, totals, firsts, lasts, base, labels, scores, spans = [], [], [], [], [], [], [], []
            for i, j in slices(off_all):
                raw, off, n = raw_all[off_all[i] : off_all[j]], off_all[i : j + 1] - off_all[i], j - i
                _, _, row, h = words(raw, off)
                count = np.bincount(row, minlength=n)
                begin = np.concatenate([[0], np.cumsum(count)])
                found: dict[int, list[tuple[int, str]]] = {}
                for seq, label in wanted:
                    m = len(h) - len(seq) + 1
                    if m <= 0:
                        continue
                    hit = (h[:m] == seq[0]) & (row[:m] == row[len(seq) - 1 :])
                    for k in range(1, len(seq)):
                        hit &= h[k : k + m] == seq[k]
                    for p in np.flatnonzero(hit):
                        found.setdefault(int(row[p]), []).append((int(p - begin[row[p]]), label))
                text = normalised(raw, off).decode("latin-1")
                fuzzy: dict[int, list[dict]] = {}
                hits = finder.find(text)
                if hits:
                    flat = np.frombuffer(text.encode("latin-1"), np.uint8)
                    lines = np.concatenate([[0], np.flatnonzero(flat == 10) + 1])
                    for a, b, k, errors in hits:
                        r = int(np.searchsorted(lines, a, "right")) - 1
                        said = {"label": finder.notices[k][1], "first_word": text.count(" ", lines[r], a), "n_words": text.count(" ", a, b) + 1, "errors": errors, "of": len(finder.notices[k][0])}
                        fuzzy.setdefault(r, []).append(said)
                for r in range(n):
                    places, near = found.get(r, ()), fuzzy.get(r, ())
                    own = {label for _, label in places}
                    totals.append(int(count[r]))
                    counts.append(len(places))
                    firsts.append(min((p for p, _ in places), default=None))
                    lasts.append(max((p for p, _ in places), default=None))
                    base.append(",".join(sorted(own)))
                    labels.append(",".join(sorted(own | {s["label"] for s in near})))
                    scores.append(1.0 if own else max((1 - s["errors"] / s["of"] for s in near), default=0.0))
                    spans.append([{k: v for k, v in s.items() if k != "of"} for s in near])
            cols = [batch.column(0), *(pa.array(x, pa.int64()) for x in (totals, counts, firsts, lasts)), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span_type)]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return run


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: tuple[tuple[str, str], ...] = PHRASES, notices: tuple[tuple[str, str], ...] = NOTICES, rate: float = 0.1
) -> DataFrame:
    """``key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` per row, in one pass with no shuffle.

    ``n_base`` counts all places of the phrases, from ``first_word`` to ``last_word`` (words from 0; null where there is
    none). ``spans`` are the notices found with up to ``rate`` of their length in errors, none overlapping another: of
    several readings the one with the fewest errors for its length, then the longest. ``score`` is 1 with a phrase, else the
    best notice's share of bytes without error, else 0. Null and wordless texts have no words, empty labels and a score of
    0. Repeated rows and null keys come back as they are. An empty table gives no rows. Other columns are ignored.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    span = "array<struct<label: string, first_word: bigint, n_words: bigint, errors: bigint>>"
    schema = f"id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {span}"
    return rows.mapInArrow(_scan(phrases, notices, rate), schema).withColumnRenamed("id", key)
