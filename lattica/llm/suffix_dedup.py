"""Suffix-array de-duplication of exact byte strings.

A byte goes if a 50-byte string over it also starts in a document of smaller id. A
window of 50 bytes has 31 strings of 20; the one of least hash is its anchor, so that
equal windows have equal anchors. Neighbouring windows with one anchor are a run.

1. Anchors are told to hash buckets (of equal anchors in a batch one for each part of
   the documents); those that two documents have are told back.
2. Runs with such an anchor go, with their bytes, to the anchor's bucket. Where a part
   has equal runs, only that of the smallest document goes; the others are covered.
3. In a bucket, too, of equal runs only that of the smallest document is left. It sorts the suffixes that start at anchors: a mergesort whose comparisons
   find the common extension by binary search over prefix polynomial hashes, so a
   comparison takes a logarithmic number of steps. Neighbours' extensions cut the
   order into intervals of equal strings; with the hash of what lies left of the
   anchor they give, for each window, the smallest document that has it. Every
   window found is compared byte by byte, so a collision of hashes removes nothing.
4. What is covered is told back to the documents, all at once.

Null and empty texts and those under 50 bytes lose nothing; rows without doc_id
neither lose nor cover anything; rows that share a doc_id don't cover each other;
overlaps count; strings are those of the input. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Texts, buckets_for, by_bucket, flat, joined, mix, powers, prefix_hash, ranges

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: Bytes of text of which anchors are found at once: what numpy holds of them stays in a core's cache.
PIECE = 1 << 17
_U = np.uint64
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def grams(buf: np.ndarray) -> np.ndarray:
    """Hash of the 20 bytes at each position."""
    h = prefix_hash(buf)
    n = max(0, len(buf) - GRAM + 1)
    _, inv = powers(len(h))
    return mix((h[GRAM : GRAM + n] - h[:n]) * inv[:n])


def least(g: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours: of 2, 4, 8... and so on, then of two such stretches that overlap."""
    m = len(g) - w + 1
    if m <= 0:
        return g[:0]
    x, n = g, 1
    while 2 * n <= w:
        x, n = np.minimum(x[:-n], x[n:]), 2 * n
    return np.minimum(x[:m], x[w - n : w - n + m])


def runs(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor's hash, document) of the runs, and the hash of 20 bytes at each position."""
    g = grams(t.buf)
    low = least(g, SPAN)
    size = np.diff(t.at)
    full = np.flatnonzero(size >= LENGTH)
    count = size[full] - LENGTH + 1
    window = ranges(t.at[full], count)
    if not len(window):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64), e, g
    value = low[window]
    new = np.ones(len(window), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (window[1:] != window[:-1] + 1)
    new[np.concatenate([[0], np.cumsum(count)[:-1]])] = True
    first = np.flatnonzero(new)
    return window[first], np.diff(np.append(first, len(window))), value[first], np.repeat(full, count)[first], g


def arranged(k: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Order by k, and of equal ones by `then`: few keys have equals, so only these are sorted twice."""
    by = np.argsort(k)
    v = k[by]
    same = np.zeros(len(v), dtype=bool)
    same[1:] = v[1:] == v[:-1]
    same[:-1] |= same[1:].copy()
    some = by[same]
    by[same] = some[np.lexsort((then[some], v[same]))]
    return by


def anchored(start: np.ndarray, count: np.ndarray, value: np.ndarray, g: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, count, anchor's position, value, *more): runs cut so that each has one anchor, the leftmost in its windows."""
    out = []
    around = np.lib.stride_tricks.sliding_window_view(g, SPAN) if len(start) else g
    while len(start):
        at = start + np.concatenate([(around[start[i : i + (1 << 12)]] == value[i : i + (1 << 12), None]).argmax(axis=1) for i in range(0, len(start), 1 << 12)])
        mine = np.minimum(count, at - start + 1)
        out.append((start, mine, at, value, *more))
        rest = count > mine
        start, count, value, *more = (start + mine)[rest], (count - mine)[rest], value[rest], *[m[rest] for m in more]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (start, count, start, value, *more)


class Suffixes:
    """Suffixes of limited length in one buffer, compared through prefix hashes."""

    def __init__(self, buf: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.buf, self.start, self.size = buf, start, size
        self.h = prefix_hash(buf)
        _, self.inv = powers(len(self.h))

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n bytes at positions a and b have one hash."""
        return (self.h[a + n] - self.h[a]) * self.inv[a] == (self.h[b + n] - self.h[b]) * self.inv[b]

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix of suffixes x and y by binary search over its length."""
        a, b = self.start[x], self.start[y]
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.size[x], self.size[y])
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            mid = (low[open_] + high[open_] + 1) // 2
            same = self.equal(a[open_], b[open_], mid)
            low[open_] = np.where(same, mid, low[open_])
            high[open_] = np.where(same, high[open_], mid - 1)

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Negative, 0 or positive as x is less than, equal to or greater than y."""
        n = self.extension(x, y)
        short = n >= np.minimum(self.size[x], self.size[y])
        last = len(self.buf) - 1
        a, b = self.buf[np.minimum(self.start[x] + n, last)].astype(np.int64), self.buf[np.minimum(self.start[y] + n, last)].astype(np.int64)
        return np.where(short, self.size[x] - self.size[y], a - b)

    def order(self, group: np.ndarray) -> np.ndarray:
        """Order by group, then by suffix: a merge sort of all groups at once, each element finding its place in the other run by binary search."""
        o = np.argsort(group, kind="stable")
        g = group[o]
        first = np.searchsorted(g, g, "left")
        size = np.searchsorted(g, g, "right") - first
        at = np.arange(len(o)) - first
        width = 1
        while True:
            live = np.flatnonzero(size > width)
            if not len(live):
                return o
            run = at[live] // width
            other = (run ^ 1) * width
            length = np.clip(size[live] - other, 0, width)
            low, high = np.zeros(len(live), dtype=np.int64), length.copy()
            before = run % 2 == 1  # the other run stands left of this one: equals of it come first
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                mid = (low[open_] + high[open_]) // 2
                e = live[open_]
                c = self.compare(o[first[e] + other[open_] + mid], o[e])
                less = (c < 0) | ((c == 0) & before[open_])
                low[open_] = np.where(less, mid + 1, low[open_])
                high[open_] = np.where(less, high[open_], mid)
            place = first[live] + np.minimum(run, run ^ 1) * width + at[live] % width + low
            moved = o.copy()
            moved[place] = o[live]
            o = moved
            width *= 2


def alike(buf: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n bytes at positions a and b are the same."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    at = np.lib.stride_tricks.sliding_window_view(buf, n)
    return (at[a] == at[b]).all(axis=1)


def spelt(h: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of each run's bytes and of its anchor's place in it; h: prefix hashes of the buffer."""
    _, inv = powers(len(h))
    return mix((h[end] - h[start]) * inv[start] + mix(((end - start) << 8 | (at - start)).astype(np.uint64)))


def copies(buf: np.ndarray, cut: np.ndarray, whole: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Runs that a smaller document has as they are, byte by byte: all their windows are covered. Run i is buf[cut[i]:cut[i+1]], whole its hash."""
    size = np.diff(cut)
    by = arranged(whole, doc)
    w = whole[by]
    new = np.ones(len(w), dtype=bool)
    new[1:] = w[1:] != w[:-1]
    head = by[np.flatnonzero(new)][np.cumsum(new) - 1]
    later = (doc[by] > doc[head]) & (size[by] == size[head])
    mine, first = by[later], head[later]
    fine = np.ones(len(mine), dtype=bool)
    for n in np.unique(size[mine]):
        m = np.flatnonzero(size[mine] == n)
        for c in range(0, len(m), 1 << 14):
            x = m[c : c + (1 << 14)]
            fine[x] = alike(buf, cut[mine[x]], cut[first[x]], int(n))
    return mine[fine]


def covered(buf: np.ndarray, cut: np.ndarray, left: np.ndarray, group: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, offset) of all windows that a smaller document has; run i is buf[cut[i]:cut[i+1]], its anchor at offset left[i]."""
    size = np.diff(cut)
    s = Suffixes(buf, cut[:-1] + left, size - left)
    o = s.order(group)
    g = group[o]
    step = np.zeros(len(o), dtype=np.int64)
    step[1:] = np.where(g[1:] == g[:-1], s.extension(o[1:], o[:-1]), 0)
    found_run, found_at = [], []
    for n in range(SPAN):  # bytes of the window left of its anchor
        ok = (left[o] >= n) & (size[o] - left[o] >= LENGTH - n)
        if ok.sum() < 2:
            continue
        part = np.cumsum(step < LENGTH - n)[ok]  # strings right of the anchor, equal within a number
        x = o[ok]
        a = s.start[x] - n
        before = (s.h[a + n] - s.h[a]) * s.inv[a] if n else np.zeros(len(x), np.uint64)
        key = mix(before + mix(part.astype(np.uint64)))
        by = arranged(key, doc[x])
        k = key[by]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        head = x[by][np.flatnonzero(new)][np.cumsum(new) - 1]
        mine = x[by]
        later = doc[mine] > doc[head]
        mine, head = mine[later], head[later]
        for i in range(0, len(mine), 1 << 14):
            m, h = mine[i : i + (1 << 14)], head[i : i + (1 << 14)]
            same = alike(buf, s.start[m] - n, s.start[h] - n, LENGTH)
            if not same.all():  # a collision: compare with every smaller document of the key
                bad = np.flatnonzero(~same)
                for b in bad:
                    own = buf[s.start[m[b]] - n :][:LENGTH].tobytes()
                    mates = x[(key == key[x == m[b]][0]) & (doc[x] < doc[m[b]])]
                    same[b] = any(buf[s.start[y] - n :][:LENGTH].tobytes() == own for y in mates)
            found_run.append(m[same])
            found_at.append(left[m[same]] - n)
    if not found_run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_run), np.concatenate(found_at)


def spans(run: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (run, offset) joined to (run, first offset, end of bytes)."""
    by = np.lexsort((at, run))
    run, at = run[by], at[by]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(run)) - 1
    return run[first], at[first], at[last[: len(first)]] + LENGTH if len(first) else at[:0]


def _ordered(docs: pa.Table) -> pa.Table:
    """Rows of a part in an order of their own, whatever order they came in; rows without id are left out."""
    rows = sorted((i, t) for i, t in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist()) if i is not None)
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and upper half of a hash: enough to find candidates."""
    return ((key % _U(buckets)) << _U(32)) | (key >> _U(32))


def remove(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): bytes, removed bytes, removed runs, and the hash of what is kept."""
    buckets = buckets or buckets_for(docs)
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text", f"cast(pmod(xxhash64(coalesce(cast(doc_id as bigint), xxhash64(text))), {buckets}) as int) part")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.array(batch.column(2).to_pylist(), dtype=np.uint64)
            keep = np.array([x is not None for x in batch.column(0).to_pylist()], dtype=bool)
            keys, docs_ = [], []
            for t in flat(batch.column(1), PIECE):
                _, _, v, d, _ = runs(t)
                ok = keep[d + t.first]
                keys.append(v[ok])
                docs_.append(d[ok] + t.first)
            if not keys:
                continue
            k, d = np.concatenate(keys), np.concatenate(docs_)
            by = arranged(k, d)
            k, d = k[by], d[by]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
            k, p = k[new], home[d[new]]
            # one for each key and part, and whether more than one document stands behind it
            by = arranged(k, p)
            k, p = k[by], p[by]
            new = np.ones(len(k), dtype=bool)
            new[1:] = (k[1:] != k[:-1]) | (p[1:] != p[:-1])
            many = np.diff(np.append(np.flatnonzero(new), len(k))) > 1
            k, p = k[new], p[new].astype(np.uint32) * 2 + many.astype(np.uint32)
            order, cut = by_bucket(k, buckets)
            some = np.flatnonzero(np.diff(cut))
            parts = [order[cut[b] : cut[b + 1]] for b in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([(k[x] >> _U(32)).astype(np.uint32).tobytes() for x in parts], pa.binary()), pa.array([p[x].tobytes() for x in parts], pa.binary())], names=["bucket", "keys", "parts"])

    def hear(key: tuple, rows: pa.Table) -> pa.Table:
        k, p = joined(rows["keys"], np.uint32), joined(rows["parts"], np.uint32)
        by = np.argsort(k, kind="stable")
        k, p = k[by], p[by]
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[1:] != k[:-1]
        group = np.cumsum(new) - 1
        several = (np.bincount(group) > 1) | (np.bincount(group, weights=p & 1) > 0)
        ok = several[group] if len(k) else new
        k, p = k[ok].astype(np.uint64) | (_U(key[0].as_py()) << _U(32)), p[ok] >> 1
        order, cut = by_bucket(p.astype(np.uint64), buckets)
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"part": pa.array(some.astype(np.int32)), "keys": pa.array([np.unique(k[order[cut[b] : cut[b + 1]]]).tobytes() for b in some], pa.binary())})

    told = slim.mapInArrow(tell, "bucket int, keys binary, parts binary")
    heard = told.groupBy("bucket").applyInArrow(hear, "part int, keys binary")

    def send(here: pa.Table, heard: pa.Table) -> pa.Table:
        wanted = np.unique(joined(heard["keys"], np.uint64))
        part = here["part"][0].as_py() if here.num_rows else -1
        rows = _ordered(here)
        ids = np.array(rows["doc_id"].to_pylist(), dtype=np.int64)
        out: list[list] = [[], [], [], [], [], [], []]

        def put(bucket: int, keys: bytes, row: bytes, meta: bytes, text: bytes | None, size: int) -> None:
            for o, v in zip(out, (bucket, part, keys, row, meta, text, size)):
                o.append(v)

        held = []
        for t in flat(rows["text"], PIECE) if len(wanted) else ():
            start, count, value, d, g = runs(t)
            s = _short(value, buckets)
            i = np.minimum(np.searchsorted(wanted, s), len(wanted) - 1)
            ok = wanted[i] == s
            start, count, at, value, d = anchored(start[ok], count[ok], value[ok], g, d[ok])
            end = start + count + LENGTH - 1
            whole = spelt(prefix_hash(t.buf), start, end, at)
            text = t.buf[ranges(start, end - start)]
            held.append((value, whole, d + t.first, start - t.at[d], end - start, at - start, text))
        if held:
            value, whole, row, start, size, left, text = (np.concatenate(x) for x in zip(*held))
            cut = np.concatenate([[0], np.cumsum(size)])
            here_covered = copies(text, cut, whole, ids[row])
            put(-1, b"", row[here_covered].astype(np.int32).tobytes(), np.stack([start[here_covered], start[here_covered] + size[here_covered]]).astype(np.int64).tobytes(), None, 0)
            go = np.ones(len(value), dtype=bool)
            go[here_covered] = False
            go = np.flatnonzero(go)
            order, bound = by_bucket(value[go], buckets)
            for b in np.flatnonzero(np.diff(bound)):
                x = go[order[bound[b] : bound[b + 1]]]
                body = text[ranges(cut[x], size[x])].tobytes()
                put(int(b), value[x].tobytes(), row[x].astype(np.int32).tobytes(), np.stack([ids[row[x]], start[x], size[x], left[x]]).astype(np.int64).tobytes(), pa.compress(body, "zstd", asbytes=True), len(body))
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table({n: pa.array(v, k) for n, v, k in zip(("bucket", "part", "keys", "rows", "meta", "text", "size"), out, kinds)})

    sent = slim.groupBy("part").cogroup(heard.groupBy("part")).applyInArrow(send, "bucket int, part int, keys binary, rows binary, meta binary, text binary, size long")

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        parts = rows["part"].to_pylist()
        kinds = {"part": pa.int32(), "rows": pa.binary(), "meta": pa.binary()}
        # (rows of local findings pass as they are; their bucket is -1 and spread by part)
        if key[0].as_py() < 0:
            return rows.select(["part", "rows", "meta"])
        value = joined(rows["keys"], np.uint64)
        row = joined(rows["rows"], np.int32)
        origin = np.repeat(np.array(parts), [len(x) // 4 for x in rows["rows"].to_pylist()])
        doc, start, size, left = (np.concatenate(x) for x in zip(*[np.frombuffer(m, np.int64).reshape(4, -1) for m in rows["meta"].to_pylist()]))
        buf = np.concatenate([np.frombuffer(pa.decompress(x, n, "zstd", asbytes=True), np.uint8) for x, n in zip(rows["text"].to_pylist(), rows["size"].to_pylist())])
        cut = np.concatenate([[0], np.cumsum(size)])
        # anchors that one run alone has are done; the rest in pieces of whole groups
        by = np.argsort(value, kind="stable")
        v = value[by]
        many = np.zeros(len(v), dtype=bool)
        many[1:] = v[1:] == v[:-1]
        many[:-1] |= many[1:].copy()
        by, v = by[many], v[many]
        total = np.cumsum(size[by])
        found: list[tuple] = []
        a = 0
        while a < len(by):
            b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + (1 << 21), "right")))
            b = int(np.searchsorted(v, v[b - 1], "right"))
            x = by[a:b]
            own, own_cut = buf[ranges(cut[x], size[x])], np.concatenate([[0], np.cumsum(size[x])])
            # runs that other parts have as well: those of the smallest documents are left
            c = copies(own, own_cut, spelt(prefix_hash(own), own_cut[:-1], own_cut[1:], own_cut[:-1] + left[x]), doc[x])
            found.append((origin[x[c]], row[x[c]], start[x[c]], start[x[c]] + size[x[c]]))
            go = np.ones(len(x), dtype=bool)
            go[c] = False
            x = x[go]
            _, group, number = np.unique(v[a:b][go], return_inverse=True, return_counts=True)
            x, group = x[number[group] > 1], group[number[group] > 1]
            own_cut = np.concatenate([[0], np.cumsum(size[x])])
            r, at = covered(buf[ranges(cut[x], size[x])], own_cut, left[x], group, doc[x])
            r, first, end = spans(r, at)
            found.append((origin[x[r]], row[x[r]], start[x[r]] + first, start[x[r]] + end))
            a = b
        if not found:
            return pa.table({n: pa.array([], k) for n, k in kinds.items()})
        p, row, s, e = (np.concatenate(x) for x in zip(*found))
        order, bound = by_bucket(p.astype(np.uint64), buckets)
        some = np.flatnonzero(np.diff(bound))
        blobs = [order[bound[b] : bound[b + 1]] for b in some]
        return pa.table({"part": pa.array(some.astype(np.int32)), "rows": pa.array([row[x].astype(np.int32).tobytes() for x in blobs], pa.binary()), "meta": pa.array([np.stack([s[x], e[x]]).astype(np.int64).tobytes() for x in blobs], pa.binary())})

    spread = F.when(F.col("bucket") < 0, F.col("part")).otherwise(0).alias("spread")
    settled = sent.groupBy("bucket", spread).applyInArrow(settle, "part int, rows binary, meta binary")

    def finish(here: pa.Table, settled: pa.Table) -> pa.Table:
        rows = _ordered(here)
        row = joined(settled["rows"], np.int32)
        pieces = [np.frombuffer(m, np.int64).reshape(2, -1) for m in settled["meta"].to_pylist() if m]
        start, end = (np.concatenate(x) for x in zip(*pieces)) if pieces else (np.zeros(0, np.int64),) * 2
        by = np.argsort(row, kind="stable")
        row, start, end = row[by], start[by], end[by]
        out = []
        for i, (doc, text) in enumerate(zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist())):
            body = np.frombuffer(text.encode(), np.uint8)
            a, b = np.searchsorted(row, [i, i + 1])
            step = np.zeros(len(body) + 1, dtype=np.int64)
            np.add.at(step, start[a:b], 1)
            np.add.at(step, end[a:b], -1)
            gone = np.cumsum(step[:-1]) > 0
            n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((doc, len(body), int(gone.sum()), n_spans, hashlib.sha256(body[~gone].tobytes()).hexdigest()))
        for doc, text in zip(here["doc_id"].to_pylist(), here["text"].to_pylist()):
            if doc is None:
                out.append((None, len(text.encode()), 0, 0, hashlib.sha256(text.encode()).hexdigest()))
        columns = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, [pa.int64()] * 4 + [pa.string()])})

    return slim.groupBy("part").cogroup(settled.groupBy("part")).applyInArrow(finish, SCHEMA)
