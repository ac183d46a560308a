"""Repeated passages by the common-prefix interval tree of a sparse enhanced suffix array.

A string of LENGTH bytes that stands in two documents has the same minimizer in both: the GRAM-byte string of the lowest
hash in it. So only the suffixes that start at minimizers ("anchors", about one byte in fourteen) need sorting, and every
repeat is among the anchors of equal grams, which meet in one partition however the documents are spread.

1. Documents are spread over text groups. Each group sends the distinct hashes of its anchors, packed, to the hash's
   partition, which answers with a bit for each hash that another group has too.
   Hashes of very many occurrences are told apart from the rest: of those ("hot anchors") the suffixes are cut to windows
   of LENGTH bytes, each going to the partition of its own hash, and equal windows of a group as one row, so that the
   occurrences of a hot anchor spread over all partitions. They are sorted and scanned as all others are.
2. Each group cuts the context of its repeated anchors: what a repeat of LENGTH bytes around the anchor can reach. Equal
   contexts within a group are settled there and only those of the smallest document travel on.
3. A partition sorts its anchored suffixes into an enhanced suffix array (sorted order and longest common prefixes). A scan
   with a stack lists the common-prefix intervals, the nodes of the interval tree. In each, the left extensions are tested
   for diversity: members that agree furthest to the left form a repeat that can be extended on neither side, with all
   its occurrences. Of each such group those outside its smallest document are marked.
4. The marks go back to the groups, where the marked bytes are taken out.

The text is shuffled once: the three steps that need it read the same exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._bytes import U, mix, slices, text_buffers
from tidemark.session import ship

LENGTH = 50
GRAM = 24
_B = 0x9E3779B97F4A7C15
_CHUNK = 1 << 16
#: Anchors of more occurrences are hot.
HOT = 50_000
#: Stands for a null document id: larger than all.
LAST = np.iinfo(np.int64).max


def _grams(raw: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial of every k bytes, by doubling."""
    now = raw.astype(U) + U(1)
    out, done, n = None, 0, 1
    while True:
        if k & n:
            if out is None:
                out, done = now, n
            else:
                m = len(now) - done
                out, done = out[:m] * U(pow(_B, n, 2**64)) + now[done:], done + n
        if 2 * n > k:
            return out
        m = len(now) - n
        now = now[:m] * U(pow(_B, n, 2**64)) + now[n:]
        n *= 2


def _running(x: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w neighbours."""
    n = 1
    while 2 * n <= w:
        x = f(x[:-n], x[n:])
        n *= 2
    return f(x[: len(x) - (w - n)], x[w - n :]) if w > n else x


def _anchors_of(raw: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    n, w = len(raw), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, U)
    poly = _grams(raw, k)
    h = ((poly * U(0xD6E8FEB86659FD93)) >> U(32)).astype(np.uint32) | np.uint32(1)
    least = _running(h, w, np.minimum)
    # windows that run over a text's end don't count
    for e in ends[:-1]:
        least[max(0, e - length + 1) : e] = 0
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint32)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(_running(padded, w, np.maximum)[: len(h)] == h)
    return at, mix(poly[at])


def anchors(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Place and gram hash of every minimizer of the windows of ``length`` bytes inside each text."""
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for i, j in slices(off, _CHUNK):
        a, b = int(off[i]), int(off[j])
        if j == i + 1:  # one text, of any length: chunks overlap by a window
            found = []
            for x in range(a, max(a + 1, b - length + 1), 4 * _CHUNK):
                y = min(b, x + 4 * _CHUNK + length - 1)
                p, h = _anchors_of(raw[x:y], np.array([y - x]), length, k)
                found.append((p + x, h))
            p = np.concatenate([f[0] for f in found])
            p, first = np.unique(p, return_index=True)
            at.append(p)
            hashes.append(np.concatenate([f[1] for f in found])[first])
        else:
            p, h = _anchors_of(raw[a:b], off[i + 1 : j + 1] - a, length, k)
            at.append(p + a)
            hashes.append(h)
    return np.concatenate(at), np.concatenate(hashes)


def _pack(*arrays: np.ndarray) -> bytes:
    body = b"".join(len(a.tobytes()).to_bytes(8, "little") + a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(body[at : at + 8], "little")
        out.append(np.frombuffer(body, kind, n // np.dtype(kind).itemsize, at + 8))
        at += 8 + n
    return out


def _group(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, bytes and offsets of a text group, in an order that the rows alone decide."""
    table = table.sort_by([("ord", "ascending"), ("text", "ascending")])
    raw, off = text_buffers(table.column("text").cast(pa.large_string()))
    return table.column("ord").to_numpy(), raw, off


def _keys(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition above, 32 bits of hash below."""
    return (((h >> U(32)) % U(parts)) << U(32)) | (h & U(0xFFFFFFFF))


def _offer(parts: int, length: int, k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, raw, off = _group(table)
        keys, times = np.unique(_keys(anchors(raw, off, length, k)[1], parts), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(parts + 1, dtype=U) << U(32))
        there = np.flatnonzero(np.diff(cuts))
        hashes, counts = keys.astype(np.uint32), np.minimum(times, 65535).astype(np.uint16)
        blobs = [hashes[cuts[p] : cuts[p + 1]].tobytes() for p in there]
        often = [counts[cuts[p] : cuts[p + 1]].tobytes() for p in there]
        return pa.table({"p": pa.array(there, pa.int64()), "q": pa.array([key[0].as_py()] * len(there), pa.int64()), "blob": pa.array(blobs, pa.binary()), "times": pa.array(often, pa.binary())})

    return run


def _answer(hot: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        qs, lists = table.column("q").to_numpy(), [np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()]
        times = np.concatenate([np.frombuffer(b, np.uint16) for b in table.column("times").to_pylist()])
        everything = np.concatenate(lists)
        order = np.argsort(everything, kind="stable")
        values = everything[order]
        starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        values, groups = values[starts], np.diff(np.append(starts, len(order)))
        many = np.add.reduceat(times[order].astype(np.int64), starts)
        repeated, crowded = groups > 1, many > hot
        masks, heats, of = [], [], []
        for q, own in zip(qs, lists):
            at = np.searchsorted(values, own)
            if repeated[at].any() or crowded[at].any():
                masks.append(np.packbits(repeated[at]).tobytes())
                heats.append(np.packbits(crowded[at]).tobytes() if crowded[at].any() else None)
                of.append(q)
        p = key[0].as_py()
        return pa.table({"q": pa.array(of, pa.int64()), "p": pa.array([p] * len(of), pa.int64()), "mask": pa.array(masks, pa.binary()), "heat": pa.array(heats, pa.binary())})

    return run


def _hash_windows(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of the windows that start there."""
    h = np.zeros(len(starts), U)
    for i in range(length):
        h = h * U(_B) + raw[starts + i].astype(U) + U(1)
    return mix(h)


def _contexts(parts: int, length: int, k: int):
    reach = length - k

    def run(key: tuple, docs: pa.Table, masks: pa.Table) -> pa.Table:
        q = key[0].as_py()
        empty = pa.table({"p": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "kind": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        if not docs.num_rows:
            return empty
        ids, raw, off = _group(docs)
        at, h = anchors(raw, off, length, k)
        if not len(at):
            return empty
        keys = _keys(h, parts)
        sorted_keys, first = np.unique(keys, return_inverse=True)
        wanted, crowded = np.zeros(len(sorted_keys), bool), np.zeros(len(sorted_keys), bool)
        cuts = np.searchsorted(sorted_keys, np.arange(parts + 1, dtype=U) << U(32))
        for p, mask, heat in zip(*(masks.column(c).to_pylist() for c in ("p", "mask", "heat"))):
            n = cuts[p + 1] - cuts[p]
            wanted[cuts[p] : cuts[p + 1]] = np.unpackbits(np.frombuffer(mask, np.uint8), count=n).astype(bool)
            if heat is not None:
                crowded[cuts[p] : cuts[p + 1]] = np.unpackbits(np.frombuffer(heat, np.uint8), count=n).astype(bool)
        doc = np.searchsorted(off, at, "right") - 1
        # hashes of several documents of this group
        low, high = np.full(len(sorted_keys), len(ids)), np.full(len(sorted_keys), -1)
        np.minimum.at(low, first, doc)
        np.maximum.at(high, first, doc)
        wanted |= low != high
        out_p, kinds, blobs = [], [], []
        if crowded.any():
            hot_at = at[crowded[first]]
            # every window around a hot anchor, once
            starts = np.unique(hot_at[:, None] - np.arange(reach + 1))
            starts = starts[starts >= 0]
            own = np.searchsorted(off, starts, "right") - 1
            inside = starts + length <= off[own + 1]
            starts, own = starts[inside], own[inside]
            h = _hash_windows(raw, starts, length)
            order = np.lexsort((ids[own], h))
            starts, own, h = starts[order], own[order], h[order]
            same = h[1:] == h[:-1]
            for i in range(length):
                same &= raw[starts[1:] + i] == raw[starts[:-1] + i]
            begin = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else order
            least = np.repeat(ids[own[begin]], np.diff(np.append(begin, len(order)))) if len(order) else ids[:0]
            place = starts - off[own]
            settled = ids[own] > least
            if settled.any():
                blobs.append(_pack(own[settled].astype(np.uint32), place[settled].astype(np.uint32), (place[settled] + length).astype(np.uint32)))
                out_p.append(-1 - q)
                kinds.append(0)
            rest = np.flatnonzero(~settled)
            part = (h[rest] % U(parts)).astype(np.int64)
            rest = rest[np.argsort(part, kind="stable")]
            edges = np.searchsorted(np.sort(part), np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(edges)):
                o = rest[edges[p] : edges[p + 1]]
                windows = np.lib.stride_tricks.sliding_window_view(raw, length)[starts[o]]
                blobs.append(_pack(ids[own[o]], own[o].astype(np.uint32), place[o].astype(np.uint32), windows))
                out_p.append(int(p))
                kinds.append(2)
        keep = (wanted & ~crowded)[first]
        at, keys, doc = at[keep], keys[keep], doc[keep]
        left = np.minimum(at - off[doc], reach).astype(np.uint8)
        right = np.minimum(off[doc + 1] - at, length).astype(np.uint8)
        padded = np.concatenate([np.full(reach, 255, np.uint8), raw, np.full(length, 255, np.uint8)])
        width = reach + length
        context = np.lib.stride_tricks.sliding_window_view(padded, width)[at].copy()
        column = np.arange(width)
        context[(column < reach - left[:, None].astype(int)) | (column >= reach + right[:, None].astype(int))] = 255
        # equal contexts: only those of the smallest document travel, the others are repeats whatever comes back
        words = np.zeros((len(at), -(-width // 8) * 8), np.uint8)
        words[:, :width] = context
        words = words.view(U)
        x = left.astype(U) << U(8) | right.astype(U)
        for c in range(words.shape[1]):
            x = mix(x + words[:, c])
        order = np.lexsort((ids[doc], x))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (x[a] == x[b]) & (left[a] == left[b]) & (right[a] == right[b]) & (words[a] == words[b]).all(1)
        starts = np.flatnonzero(~same)
        least = np.repeat(ids[doc[order[starts]]], np.diff(np.append(starts, len(order)))) if len(order) else ids[:0]
        settled = ids[doc[order]] > least
        own = order[settled]
        if len(own):
            begin = at[own] - off[doc[own]]
            keep = left[own].astype(int) + right[own] >= length
            by = np.lexsort((begin[keep], doc[own][keep]))
            blobs.append(_pack(*(v[keep][by].astype(np.uint32) for v in (doc[own], begin - left[own], begin + right[own]))))
            out_p.append(-1 - q)
            kinds.append(0)
        rest = np.sort(order[~settled])
        part = (keys[rest] >> U(32)).astype(np.int64)
        rest = rest[np.argsort(part, kind="stable")]
        cuts = np.searchsorted(np.sort(part), np.arange(parts + 1))
        for p in np.flatnonzero(np.diff(cuts)):
            o = rest[cuts[p] : cuts[p + 1]]
            blobs.append(_pack(ids[doc[o]], doc[o].astype(np.uint32), (at[o] - off[doc[o]]).astype(np.uint32), left[o], right[o], context[o]))
            out_p.append(int(p))
            kinds.append(1)
        return pa.table({"p": pa.array(out_p, pa.int64()), "q": pa.array([q] * len(out_p), pa.int64()), "kind": pa.array(kinds, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return run


def prefix_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, first and last rank of every common-prefix interval of ``least`` or more: the nodes of the interval tree.

    ``lcp[i]`` is the longest common prefix of ranks i and i + 1. Runs of one are nodes as they are; longer ones are scanned
    with a stack of open intervals.
    """
    on = lcp >= least
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    begin, end = edges[::2], edges[1::2]
    single = end - begin == 1
    sizes, lows, highs = lcp[begin[single]].tolist(), begin[single].tolist(), (begin[single] + 1).tolist()
    for a, b in zip(begin[~single].tolist(), end[~single].tolist()):
        stack: list[tuple[int, int]] = []  # (length, first rank)
        for i, value in enumerate(lcp[a:b].tolist(), a):
            low = i
            while stack and stack[-1][0] > value:
                size, low = stack.pop()
                sizes.append(size)
                lows.append(low)
                highs.append(i)
            if not stack or stack[-1][0] < value:
                stack.append((value, low))
        while stack:
            size, low = stack.pop()
            sizes.append(size)
            lows.append(low)
            highs.append(b)
    return np.array(sizes, np.int64), np.array(lows, np.int64), np.array(highs, np.int64)


def _sort_rows(rows: np.ndarray) -> np.ndarray:
    """Order of byte rows."""
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width), np.uint8)
    wide[:, : rows.shape[1]] = rows
    cols = wide.view(">u8").astype(U)
    return np.lexsort(tuple(cols[:, c] for c in range(cols.shape[1] - 1, -1, -1)))


def _common(rows: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """Longest common prefix of rows a[i] and b[i], within both sizes."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), block):
        x, y = a[i : i + block], b[i : i + block]
        differ = np.ones((len(x), rows.shape[1] + 1), bool)
        differ[:, :-1] = rows[x] != rows[y]
        out[i : i + block] = np.minimum(differ.argmax(1), np.minimum(size[x], size[y]))
    return out


def repeats(ids: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For each anchored context the bytes to the left and right that repeat one of a smaller id; 0 and 0 where none does.

    Row i of ``context`` holds ``length - k`` bytes before the anchor and ``length`` from it on, ``left`` and ``right`` of
    which are real.
    """
    reach, n = length - k, len(ids)
    far_left, far_right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n < 2:
        return far_left, far_right
    forward, backward = context[:, reach:], np.ascontiguousarray(context[:, :reach][:, ::-1])
    order = _sort_rows(forward)
    lcp = _common(forward, order[:-1], order[1:], right)
    size, low, high = prefix_intervals(lcp, k)
    if not len(size):
        return far_left, far_right
    rank_left = np.empty(n, np.int64)
    rank_left[_sort_rows(backward)] = np.arange(n)
    # a block of tree nodes at a time, so that hot anchors of deep trees stay small in memory
    counts = high - low + 1
    block = np.cumsum(counts) // (1 << 19)
    cuts = np.append(np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])), len(size))
    for u, v in zip(cuts, cuts[1:]):
        node = np.repeat(np.arange(u, v), counts[u:v])
        first = np.cumsum(counts[u:v]) - counts[u:v]
        member = order[np.arange(len(node)) - np.repeat(first, counts[u:v]) + low[node]]
        sort = np.lexsort((rank_left[member], node))
        node, member = node[sort], member[sort]
        # left extensions, side by side within a node
        same = node[1:] == node[:-1]
        shared = np.where(same, _common(backward, member[:-1], member[1:], left), -1)
        need = np.maximum(length - size[node], 0)
        best = np.full(len(member), -1)
        who = ids[member]
        for l in range(reach, -1, -1):
            starts = np.flatnonzero(np.concatenate([[True], shared < l]))
            if len(starts) == len(member):
                continue
            # a group that goes no further left: the occurrences of a repeat, and the smallest document among them
            least = np.repeat(np.minimum.reduceat(who, starts), np.diff(np.append(starts, len(who))))
            hit = (best < 0) & (least < who) & (need <= l)
            best[hit] = l
        hit = best >= 0
        np.maximum.at(far_left, member[hit], best[hit])
        np.maximum.at(far_right, member[hit], size[node[hit]])
    return far_left, far_right


def whole_repeats(ids: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Of suffixes that are one window long, which repeat one of a smaller id: the tree's nodes of that length, with no left to extend."""
    n, length = windows.shape
    out = np.zeros(n, bool)
    if n < 2:
        return out
    order = _sort_rows(windows)
    lcp = _common(windows, order[:-1], order[1:], np.full(n, length))
    for _, low, high in zip(*prefix_intervals(lcp, length)):
        member = order[low : high + 1]
        out[member] = ids[member] > ids[member].min()
    return out


def _mark(length: int, k: int):
    kinds = ("<i8", "<u4", "<u4", "u1", "u1", "u1")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        qs, blobs = table.column("q").to_numpy(), table.column("blob").to_pylist()
        if key[0].as_py() < 0:
            return pa.table({"q": pa.array(qs, pa.int64()), "blob": pa.array(blobs, pa.binary())})
        sorts = table.column("kind").to_numpy()
        out_q, out = [], []
        if (sorts == 2).any():
            asked = [(q, _unpack(b, "<i8", "<u4", "<u4", "u1")) for q, b, s in zip(qs, blobs, sorts) if s == 2]
            who = np.concatenate([a[0] for _, a in asked])
            windows = np.concatenate([a[3].reshape(-1, length) for _, a in asked])
            far = whole_repeats(who, windows)
            at = 0
            for q, a in asked:
                hit = far[at : at + len(a[0])]
                at += len(a[0])
                if hit.any():
                    out_q.append(q)
                    out.append(_pack(a[1][hit], a[2][hit], a[2][hit] + np.uint32(length)))
        qs, blobs = qs[sorts == 1], [b for b, s in zip(blobs, sorts) if s == 1]
        if not blobs:
            return pa.table({"q": pa.array(out_q, pa.int64()), "blob": pa.array(out, pa.binary())})
        parts = [_unpack(b, *kinds) for b in blobs]
        del blobs
        ids, doc, at, left, right = (np.concatenate([p[i] for p in parts]) for i in range(5))
        context = np.concatenate([p[5] for p in parts]).reshape(len(ids), 2 * length - k)
        of = np.repeat(np.arange(len(qs)), [len(p[0]) for p in parts])
        del parts
        far_left, far_right = repeats(ids, left.astype(np.int64), right.astype(np.int64), context, length, k)
        for i in range(len(qs)):
            a, b = np.searchsorted(of, [i, i + 1])
            o = a + np.flatnonzero(far_right[a:b])
            if len(o):
                out_q.append(qs[i])
                out.append(_pack(doc[o], (at[o] - far_left[o]).astype(np.uint32), (at[o] + far_right[o]).astype(np.uint32)))
        return pa.table({"q": pa.array(out_q, pa.int64()), "blob": pa.array(out, pa.binary())})

    return run


def _strip(key: tuple, docs: pa.Table, marks: pa.Table) -> pa.Table:
    ids, raw, off = _group(docs)
    n = len(ids)
    step = np.zeros(len(raw) + 1, np.int32)
    for blob in marks.column("blob").to_pylist():
        doc, a, b = _unpack(blob, "<u4", "<u4", "<u4")
        np.add.at(step, off[doc] + a, 1)
        np.add.at(step, off[doc] + b, -1)
    gone = np.cumsum(step[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[off[1:]] - total[off[:-1]]
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    edge = off[:-1][np.diff(off) > 0]
    begins[edge] = gone[edge]
    begun = np.concatenate([[0], np.cumsum(begins)])
    spans = begun[off[1:]] - begun[off[:-1]]
    kept = []
    for i in range(n):
        own = raw[off[i] : off[i + 1]]
        kept.append(hashlib.sha256(own.tobytes() if not removed[i] else own[~gone[off[i] : off[i + 1]]].tobytes()).hexdigest())
    return pa.table({
        "ord": pa.array(ids, pa.int64()), "n_bytes": pa.array(np.diff(off), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(kept, pa.string()),
    })


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, group_bytes: int = 8 << 20, part_bytes: int = 24 << 20, hot: int = HOT
) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` per row: what is left when repeats of smaller keys are taken out.

    A byte goes where a string of ``length`` bytes covers it that also starts in a row with a smaller key. Strings are
    judged on the input and never cross texts; repeats within one row, or in rows with the same key, remove nothing. A null
    key is larger than any number. Null texts are empty; an empty table gives no rows. Other columns are ignored.

    ``group_bytes`` and ``part_bytes`` size the tasks; beyond 128 GB the groups grow, up to 256 MB, to keep messages long.
    Anchors of more than ``hot`` occurrences are spread by window.
    """
    ship(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(int(LAST))).alias("ord"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    total = base.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    groups = max(1, -(-total // min(256 << 20, max(group_bytes, total >> 14))))
    parts = max(1, -(-total // max(part_bytes, min(256 << 20, total >> 14))))
    placed = base.withColumn("q", F.pmod(F.xxhash64("ord", "text"), F.lit(groups)))
    offered = placed.groupBy("q").applyInArrow(_offer(parts, length, gram), "p long, q long, blob binary, times binary")
    masks = offered.groupBy("p").applyInArrow(_answer(hot), "q long, p long, mask binary, heat binary")
    contexts = placed.groupBy("q").cogroup(masks.groupBy("q")).applyInArrow(_contexts(parts, length, gram), "p long, q long, kind int, blob binary")
    marks = contexts.groupBy("p").applyInArrow(_mark(length, gram), "q long, blob binary")
    out = placed.groupBy("q").cogroup(marks.groupBy("q")).applyInArrow(_strip, "ord long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("ord") != int(LAST), F.col("ord")).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256")
