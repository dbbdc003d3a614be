"""Benchmark decontamination by SimHash windows.

Texts are words of lower-cased letters and digits (other ASCII separates). A window
as long as an item slides over each document; its 64-bit SimHash adds its 5-word
shingles, each as often as it occurs. Fingerprints are cut into four blocks: within
radius 20 one block differs by at most 5 bits, so block lists find every item in
the radius. (At so wide a radius a list admits many items: it saves the distances of the
rest, no more.) Candidates are verified by exact weighted Jaccard similarity of shingle
counts, 0.8 or more.

A window is fingerprinted only if at least half of its shingles belong to some item:
below 8/9 no window can reach 0.8, so nothing is lost. Items are broadcast in
blocks of `block_items`, one pass over the documents for each.

A document shorter than an item is one window as a whole.

Null and empty texts match nothing; items without words match nothing; items under
five words are one shingle; repeated rows are reported each; an item_id that occurs
twice stands for each of its texts. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Texts, arrow_rows, flat, ranges, shingles, words

_STRIP = np.ones(256, dtype=bool)
_STRIP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
K, BITS, BLOCKS = 5, 64, 4
SCHEMA = "doc_id long, item_id long, similarity double, hamming int, first_word long, n_words long"
_SEEN_BITS = 20


def simhash(rows: np.ndarray) -> np.ndarray:
    """Fingerprint of each row of shingle hashes: a bit is set if more than half of them have it."""
    n, m = rows.shape
    ones = np.zeros((n, BITS), dtype=np.int32)
    for j in range(m):
        ones += np.unpackbits(np.ascontiguousarray(rows[:, j]).view(np.uint8).reshape(n, 8), axis=1)
    return np.packbits(2 * ones > m, axis=1).view(np.uint64).reshape(n)


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


class Items:
    """Benchmark items by length, with an index of their shingles."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.by_size: dict[int, list[tuple[int, Counter, np.uint64]]] = {}
        every: dict[int, list[np.ndarray]] = {}
        for t in flat(pa.array(texts, pa.string())):
            w = words(t, strip=_STRIP)
            for k in range(1, K + 1):
                h, ptr = shingles(w, k)
                for d in range(len(t)):
                    n = int(w.ptr[d + 1] - w.ptr[d])
                    if n and k == min(K, n):
                        own = h[ptr[d] : ptr[d + 1]]
                        self.by_size.setdefault(n, []).append((ids[t.first + d], Counter(own.tolist()), simhash(own[None, :])[0]))
                        every.setdefault(n, []).append(own)
        self.of_size = {n: np.unique(np.concatenate(x)) for n, x in every.items()}
        self.sizes: dict[int, list[int]] = {}
        for n in self.by_size:
            self.sizes.setdefault(min(K, n), []).append(n)
        self.any: dict[int, np.ndarray] = {}
        for k, sizes in self.sizes.items():
            self.any[k] = np.zeros(1 << _SEEN_BITS, dtype=bool)
            for n in sizes:
                self.any[k][self.of_size[n] & np.uint64((1 << _SEEN_BITS) - 1)] = True


def candidates(prints: np.ndarray, items: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, item, distance) of all pairs within radius, by the block lists."""
    p, q = prints.view(np.uint16).reshape(-1, BLOCKS), items.view(np.uint16).reshape(-1, BLOCKS)
    near = np.zeros((len(p), len(q)), dtype=bool)
    for b in range(BLOCKS):
        values, at = np.unique(q[:, b], return_inverse=True)
        mine, back = np.unique(p[:, b], return_inverse=True)
        close = np.bitwise_count(mine[:, None] ^ values[None, :]) <= radius // BLOCKS
        near |= close[back][:, at]
    i, j = np.nonzero(near)
    d = np.bitwise_count(prints[i] ^ items[j]).astype(int)
    ok = d <= radius
    return i[ok], j[ok], d[ok]


def matches(items: Items, t: Texts, radius: int = 20, least: float = 0.8) -> list[tuple[int, int, float, int, int, int]]:
    """(document of t, item, similarity, distance, first word, words): the best window of each pair that matches."""
    w = words(t, strip=_STRIP)
    best: dict[tuple[int, int], tuple] = {}

    def verify(n: int, h: np.ndarray, ptr: np.ndarray, start: np.ndarray, m: int) -> None:
        """Compare the windows of m shingles from each start with the items of n words."""
        pool = items.by_size[n]
        marks = np.array([x[2] for x in pool])
        for a in range(0, len(start), 4096):
            s = start[a : a + 4096]
            rows = h[s[:, None] + np.arange(m)]
            for x, y, d in zip(*candidates(simhash(rows), marks, radius)):
                sim = similarity(Counter(rows[x].tolist()), pool[y][1])
                if sim >= least:
                    at = int(np.searchsorted(ptr, s[x], "right") - 1)
                    key, found = (at, pool[y][0]), (-sim, int(s[x] - ptr[at]), int(d), min(n, int(count[at])))
                    if key not in best or found < best[key]:
                        best[key] = found

    count = np.diff(w.ptr)
    for k, sizes in items.sizes.items():
        h, ptr = shingles(w, k)
        if not len(h):
            continue
        maybe = np.flatnonzero(items.any[k][h & np.uint64((1 << _SEEN_BITS) - 1)])
        for n in sizes:
            m = n - k + 1
            own = items.of_size[n]
            i = np.minimum(np.searchsorted(own, h[maybe]), len(own) - 1)
            hit = maybe[own[i] == h[maybe]]
            if not len(hit):
                continue
            doc = np.searchsorted(ptr, hit, "right") - 1
            # texts shorter than the items, whole, by their number of shingles
            size = count[doc] - k + 1
            few = (size > 0) & (size < m) & (size >= least * m)
            for z in np.unique(size[few]):
                which, hits = np.unique(doc[few & (size == z)], return_counts=True)
                verify(n, h, ptr, ptr[which[2 * hits >= z]], int(z))
            hit, doc = hit[size >= m], doc[size >= m]
            first, last = np.maximum(hit - m + 1, ptr[doc]), np.minimum(hit, ptr[doc + 1] - m)
            # a start occurs once for every hit in its window
            if (last - first + 1).sum() > len(h):
                step = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(step, first, 1)
                np.add.at(step, last + 1, -1)
                hits = np.cumsum(step[:-1])
                start = np.flatnonzero((hits > 0) & (2 * hits >= m))
            else:
                start, hits = np.unique(ranges(first, last - first + 1), return_counts=True)
                start = start[2 * hits >= m]
            verify(n, h, ptr, start, m)
    return [(d, item, -sim, dist, at, n) for (d, item), (sim, at, dist, n) in sorted(best.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = 20, least: float = 0.8, block_items: int = 4096) -> DataFrame:
    """One row for each document and benchmark item of which it holds a window: doc_id, item_id, similarity, where."""
    spark = docs.sparkSession
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    bench = benchmark.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("text is not null")
    blocks = max(1, -(-bench.count() // block_items))
    out = []
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        sent = spark.sparkContext.broadcast(Items(part["item_id"].to_pylist(), part["text"].to_pylist()))

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                ids = batch.column(0)
                for t in flat(batch.column(1)):
                    rows = matches(items, t, radius, least)
                    if rows:
                        d, item, sim, dist, at, n = zip(*rows)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array([t.first + x for x in d])), pa.array(item, pa.int64()), pa.array(sim, pa.float64()), pa.array(dist, pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "item_id", "similarity", "hamming", "first_word", "n_words"])

        out.append(slim.mapInArrow(each, SCHEMA))
    return reduce(DataFrame.unionAll, out)


def clean(docs: DataFrame, benchmark: DataFrame, radius: int = 20, least: float = 0.8, block_items: int = 4096) -> DataFrame:
    """The rows of docs without a leak, all columns as they are. One pass over docs for each block of items, no shuffle."""
    at = docs.columns.index("text")
    bench = benchmark.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("text is not null")
    blocks = max(1, -(-bench.count() // block_items))
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(Items(part["item_id"].to_pylist(), part["text"].to_pylist()))

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok = np.ones(batch.num_rows, dtype=bool)
                for t in flat(batch.column(at)):
                    ok[[t.first + x[0] for x in matches(sent.value, t, radius, least)]] = False
                yield batch.filter(pa.array(ok))

        docs = arrow_rows(docs, each)
    return docs
