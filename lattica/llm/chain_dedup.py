"""Substring de-duplication by collinear chaining: fuzzy passages that documents share.

Seeds are 5-word shingles, of every 6 neighbours the one of least hash, so that 10
equal words always share one. A seed's reference is the smallest document that has
it (its k-th place there for the k-th here), which leaves one match for each further place and not one
for each pair. A further place than the reference has is matched with its first. Matches
of a document with a reference are chained in order: a Fenwick tree of prefix maxima
over reference positions gives each match its best predecessor, so that chains are
optimal under a linear gap cost; they are cut at gaps over 48 words. Those left end where
they meet a better one, so every match is in one chain. Chains are aligned word by word from
match to match, and extended at both ends; of an alignment the longest stretches of at
least 50 words and 80 % of equal words are reported, without what lies beyond their last
equal words. A chain of one match is not aligned if, in each 50 words about it, less
than half occur in the reference near its place there.
Where known seeds follow each other closely but no passage came out, as their references
differ, such open stretches are compared with each other: of each window of 50 words all pairs of the 8 least shingles are keys, and a
key leads to the first document that has it and to the last one before, so that pieces of the passage in many smaller documents do not hide it.
Where all seeds are known and still no passage came out, all 50-word windows are looked up by their own hash: every equal run of 50 words that a
smaller document has lies in a reported passage.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Null, empty and short texts have no
passage; rows without doc_id are left out; different texts that share a doc_id all count, with places in
their own text; repeats within one document are not reported. Other
columns are ignored. Words are compared by 32 bits of their hashes: two different words that are compared count as equal with a probability of 2**-32.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Words, buckets_for, by_bucket, flat, joined, mix, powers, shingles, stash, words
from lattica.llm.suffix_dedup import least
from lattica.operators.scan import numbered

K, WINDOW = 5, 6
#: Words of a text that are taken at both sides of a pair's starts, before all of it.
NEAR = 96
#: Bits of the map of windows asked for, at most; with more windows the map lets more others through.
MOST_BITS = 1 << 28
GAP_COST, MOST_GAP = 0.1, 48
#: Steps from one known seed to the next within an open stretch, at most: what some edits in a row of words take away.
OPEN_GAP = 2 * WINDOW + 4 * K
#: Shingles of a window, and from one window to the next, by which open stretches are compared.
LEAST, STEP = 8, 8
#: Bytes of spelt texts of which seeds are held at once.
PIECE_BYTES = 1 << 22
#: So many ids at most are broadcast.
BROADCAST_IDS = 1 << 20
SCHEMA = "doc_id long, other_doc_id long, first_word long, end_word long, other_first_word long, other_end_word long, n_equal long, identity double"


def seeds(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in h, document) of each document's winnowed shingles; all of the least if it has fewer than a window."""
    size = np.diff(ptr)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = least(h, WINDOW) if len(h) >= WINDOW else h[:0]
    take = np.zeros(len(h), dtype=bool)
    # a shingle is taken if it is the least of a window that lies in its document
    for k in range(WINDOW):
        n = len(low)
        ok = low == h[k : k + n]
        take[k : k + n] |= ok & (np.repeat(ptr[1:], size)[:n] >= np.arange(n) + WINDOW)
    for d in np.flatnonzero((size > 0) & (size < WINDOW)):
        take[ptr[d] + int(np.argmin(h[ptr[d] : ptr[d + 1]]))] = True
    at = np.flatnonzero(take)
    return at, np.searchsorted(ptr, at, "right") - 1


class Fenwick:
    """Prefix maxima of (score, index)."""

    def __init__(self, n: int):
        self.best = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def get(self, i: int) -> tuple[float, int]:
        """Maximum over positions below i."""
        out = (-1e18, -1)
        while i > 0:
            out = max(out, self.best[i])
            i -= i & -i
        return out


Run = tuple[int, int, int, int]


def scored(runs: list[Run]) -> tuple[list[float], list[int]]:
    """For each of runs (first p, first q, last p, last q), given in order: the score of the best chain that ends with it, words covered less GAP_COST for each word between, and the run before it there."""
    ends = sorted({r[3] for r in runs})
    place = {v: i for i, v in enumerate(ends)}
    tree = Fenwick(len(ends))
    score, back = [0.0] * len(runs), [-1] * len(runs)
    waiting = sorted(range(len(runs)), key=lambda i: runs[i][2])
    w = 0
    for i, (p0, q0, p1, _) in enumerate(runs):
        while w < len(waiting) and runs[waiting[w]][2] < p0:
            j = waiting[w]
            tree.put(place[runs[j][3]], (score[j] + GAP_COST * (runs[j][2] + runs[j][3]), j))
            w += 1
        score[i] = p1 - p0 + K
        value, j = tree.get(bisect_left(ends, q0))
        if j >= 0 and value > GAP_COST * (p0 + q0):
            score[i], back[i] = score[i] + value - GAP_COST * (p0 + q0), j
    return score, back


def chains(runs: list[Run]) -> list[list[Run]]:
    """Chains of runs, given in order: the best one, then the best ends of those left, back to a run that is in a chain already; cut at gaps over MOST_GAP."""
    score, back = scored(runs)
    out, used = [], [False] * len(runs)
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain: list[Run] = []
        while i >= 0 and not used[i]:
            used[i] = True
            if chain and (chain[-1][0] - runs[i][2] > MOST_GAP + K or chain[-1][1] - runs[i][3] > MOST_GAP + K):
                out.append(chain[::-1])
                chain = []
            chain.append(runs[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def chained(d: np.ndarray, r: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, list[Run]]]]:
    """Chains of the matches (p, q) of each pair (d, r): (d, r, p, q) of chains of one run, and (d, r, chain) of the others.

    Matches in step on one diagonal are joined to a run first; a run weighs the words it covers.
    Runs that all lie further than MOST_GAP behind those before them begin anew.
    """
    by = np.lexsort((p, p - q, r, d))
    d, r, p, q = d[by], r[by], p[by], q[by]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] - p[:-1] > WINDOW)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(d)) - 1
    x = np.stack([d[a], r[a], p[a], q[a], p[b], q[b]])
    x = x[:, np.lexsort((x[3], x[2], x[1], x[0]))]
    new = np.ones(x.shape[1], dtype=bool)
    new[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
    # the furthest end so far within the pair
    pair = np.cumsum(new) << 32
    end = np.maximum.accumulate(pair + x[4])
    new[1:] |= pair[1:] + x[2, 1:] - end[:-1] > MOST_GAP + K
    a = np.flatnonzero(new)
    size = np.diff(np.append(a, x.shape[1]))
    alone = x[:4, a[size == 1]]
    several = []
    for i, n in zip(a[size > 1].tolist(), size[size > 1].tolist()):
        several += [(int(x[0, i]), int(x[1, i]), c) for c in chains(list(map(tuple, x[2:, i : i + n].T.tolist())))]
    return alone[:2], alone[2:], several


def resume(x: np.ndarray, y: np.ndarray, i: int, j: int, slack: int) -> tuple[int, int] | None:
    """The least step (in x, in y), at most slack in all, after which three words agree."""
    u, v = x[i : i + slack + 3], y[j : j + slack + 3]
    if len(u) < 3 or len(v) < 3:
        return None
    s, t = u.tolist(), v.tolist()
    if set(zip(s, s[1:], s[2:])).isdisjoint(zip(t, t[1:], t[2:])):
        return None
    e = u[:, None] == v[None, :]
    a, b = np.nonzero(e[:-2, :-2] & e[1:-1, 1:-1] & e[2:, 2:])
    ok = a + b <= slack
    if not ok.any():
        return None
    a, b = a[ok], b[ok]
    best = np.lexsort((a, np.abs(a - b), a + b))[0]
    return int(a[best]), int(b[best])


def ahead(x: np.ndarray, y: np.ndarray, i: int, j: int, most: int = 16) -> tuple[int, int] | None:
    """The step to the next equal word in both alike, if half of some next words, two at least, are equal there."""
    same, first = 0, 0
    for k, (u, v) in enumerate(zip(x[i : i + most].tolist(), y[j : j + most].tolist())):
        if u == v:
            same += 1
            if same == 1:
                first = k
            elif 2 * same > k:
                return first, first
    return None


def between(u: np.ndarray, v: np.ndarray) -> int:
    """Equal words of two stretches if one has a single gap, at its best place."""
    n = min(len(u), len(v))
    if len(u) == len(v):
        return int(np.count_nonzero(u == v)) if n else 0
    left = np.concatenate([[0], np.cumsum(u[:n] == v[:n])])
    right = np.concatenate([[0], np.cumsum(u[::-1][:n] == v[::-1][:n])])
    return int((left + right[::-1]).max())


Piece = tuple[int, int, int, int]


def follow(x: np.ndarray, y: np.ndarray, i: int, j: int, slack: int = MOST_GAP) -> list[Piece]:
    """Equal runs from x[i:], y[j:] on: (place in x, in y, words, equal words in the gap before). Ends where few of the next words are equal and no three agree within slack."""
    out, gained = [], 0
    while True:
        n = equal(x, y, i, j)
        out.append((i, j, n, gained))
        i, j = i + n, j + n
        step = ahead(x, y, i, j) or resume(x, y, i, j, slack)
        if step is None:
            return out
        gained = between(x[i : i + step[0]], y[j : j + step[1]])
        i, j = i + step[0], j + step[1]


def align(x: np.ndarray, y: np.ndarray, anchors: list[tuple[int, int]]) -> list[Piece]:
    """The equal runs at the anchors of a chain, and those that lead on at both its ends, in order."""
    (i, j), (k, m) = anchors[0], anchors[-1]
    left, right = follow(x[:i][::-1], y[:j][::-1], 0, 0), follow(x, y, k, m)
    gaps = [g for *_, g in left[1:]] + [0]
    out = [(i - a - n, j - b - n, n, 0) for a, b, n, _ in left][::-1]
    out = [(a, b, n, g) for (a, b, n, _), g in zip(out, [0, *gaps[:-1][::-1]])]
    a, b, n, g = out.pop()
    if len(anchors) == 1:
        return [*out, (a, b, n + right[0][2], g), *right[1:]]
    # the equal run behind the first anchor, then from anchor to anchor
    out.append((a, b, n + equal(x, y, i, j), g))
    for u, v in anchors[1:]:
        a, b, n, _ = out[-1]
        e, f = a + n, b + n
        if u < e or v < f:
            # inside of the run, or beside it
            t = max(e - u, f - v)
            n = equal(x, y, u, v) - t
            if u - v != a - b and n > 0:
                out.append((u + t, v + t, n, between(x[e : u + t], y[f : v + t])))
            continue
        back = equal(x[e:u][::-1], y[f:v][::-1], 0, 0)
        u, v = u - back, v - back
        out.append((u, v, equal(x, y, u, v), between(x[e:u], y[f:v])))
    # beyond the last run, unless it isn't the last anchor's
    a, b, n, _ = out[-1]
    if a - b == k - m:
        out += [(c, d, size, g) for c, d, size, g in right[1:]] if right[0][0] + right[0][2] == a + n else []
    return out


def equal(x: np.ndarray, y: np.ndarray, i: int, j: int) -> int:
    """How many words from x[i], y[j] on are equal."""
    n = max(min(len(x) - i, len(y) - j), 0)
    at, step = 0, 64
    while at < n:
        m = min(step, n - at)
        differ = x[i + at : i + at + m] != y[j + at : j + at + m]
        k = int(differ.argmax())
        if differ[k]:
            return at + k
        at, step = at + m, 4 * step
    return n


def hopeless(x: np.ndarray, y: np.ndarray, i: int, j: int, least_words: int) -> bool:
    """Whether in each `least_words` words about x[i] less than half occur in y near j."""
    a = x[max(i - least_words, 0) : i + K + least_words]
    if len(a) < least_words:
        return True
    near = set(y[max(j - least_words - MOST_GAP, 0) : j + K + least_words + MOST_GAP].tolist())
    known = list(accumulate(map(near.__contains__, a.tolist()), initial=0))
    return 2 * known[-1] < least_words or 2 * max(map(sub, known[least_words:], known)) < least_words


def good(runs: list[Piece], least_words: int, least_identity: float) -> list[tuple[int, int, int, int, int]]:
    """(first x, end x, first y, end y, equal words) of the longest stretch of runs that is long and equal enough, and of those left and right of it."""
    (a0, b0, *_), (a1, b1, n1, _) = runs[0], runs[-1]
    if min(a1 + n1 - a0, b1 + n1 - b0) < least_words or sum(r[2] + r[3] for r in runs) < least_words * least_identity - 1:
        return []
    a, b, n, g = (np.array(v, dtype=np.int64) for v in zip(*runs))
    total, e, f = np.cumsum(n + g), a + n, b + n
    out, todo = [], [(0, len(runs))]
    while todo:
        lo, hi = todo.pop()
        best, at = 0, (0, 0)
        for s in range(lo, hi):
            if min(e[hi - 1] - a[s], f[hi - 1] - b[s]) <= max(best, least_words - 1):
                break
            wide, high = e[s:hi] - a[s], f[s:hi] - b[s]
            size = np.minimum(wide, high)
            same = total[s:hi] - total[s] + n[s]
            ok = np.flatnonzero((size >= least_words) & (same / np.maximum(np.maximum(wide, high), 1) >= least_identity))
            if len(ok) and size[ok].max() > best:
                k = int(ok[np.argmax(size[ok])])
                best, at = int(size[k]), (s, s + k)
        if best:
            s, k = at
            out.append((int(a[s]), int(e[k]), int(b[s]), int(f[k]), int(total[k] - total[s] + n[s])))
            todo += [(lo, s), (k + 1, hi)]
    return out


def packed(d: np.ndarray, p: np.ndarray) -> bytes:
    return d.astype(np.int64).tobytes() + p.astype(np.int32).tobytes()


def unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(b) // 12
    return np.frombuffer(b, np.int64, n), np.frombuffer(b, np.int32, n, 8 * n).astype(np.int64)


def windows(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(x) < n:
        return np.zeros(0, np.uint64)
    p, inverse = powers(len(x))
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum((mix(x.astype(np.uint64)) | np.uint64(1)) * p[: len(x)])])
    return mix((h[n:] - h[:-n]) * inverse[: len(x) - n + 1])


def uncovered(spans: list[tuple[int, int]], done: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """What `done` (first and end word) leaves of spans (first and last place of shingles), if more than `most` words; as spans."""
    out = []
    for a, b in spans:
        b += K
        for c, e in sorted(done):
            if c < b and e > a:
                if c - a > most:
                    out.append((a, c - K))
                a = max(a, e)
        if b - a > most:
            out.append((a, b - K))
    return out


def signatures(h: np.ndarray, spans: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of windows of n shingles, one each STEP, over the spans (first and last place in h).

    A key joins two of the LEAST shingles of least hash of a window; the place is that of the lesser one.
    """
    starts: set[int] = set()
    for a, b in spans:
        a, b = max(a - WINDOW, 0), min(b + WINDOW, len(h) - 1)
        starts.update(range(a, max(b - n + 2, a + 1), STEP))
    first = np.array(sorted(starts), dtype=np.int64)
    if not len(first) or len(h) < LEAST:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grid = np.minimum(first[:, None] + np.arange(max(n, LEAST)), len(h) - 1)
    v = h[grid]
    at = np.argpartition(v, LEAST - 1, axis=1)[:, :LEAST]
    v, at = np.take_along_axis(v, at, 1), np.take_along_axis(grid, at, 1)
    by = np.argsort(v, axis=1)
    v, at = np.take_along_axis(v, by, 1), np.take_along_axis(at, by, 1)
    i, j = np.triu_indices(LEAST, 1)
    ok = v[:, i] != v[:, j]
    key, place = mix(v[:, i] * np.uint64(0x2545F4914F6CDD1D) + v[:, j])[ok], at[:, i][ok]
    _, one = np.unique(mix(key + place.astype(np.uint64)), return_index=True)
    return key[one], place[one]


def views(column: pa.Array) -> list[np.ndarray]:
    """The words of spelt texts, in the column's own memory."""
    column = column.cast(pa.large_binary())
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64, len(column) + 1, 8 * column.offset)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint32) if data is not None else np.zeros(0, np.uint32)
    cut = ((at - at[0]) // 4).tolist()
    return [whole[a:b] for a, b in zip(cut, cut[1:])]


def pieces(batch: pa.RecordBatch, text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of about `most` bytes of its texts: what a task holds besides a batch doesn't grow with the texts' lengths."""
    column = batch.column(text).cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    first = 0
    while first < batch.num_rows:
        last = min(max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


def spelt_words(column: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, int, Words]]:
    """Of spelt texts, about `most` words at once: the rows [first, last), and their words without places in the text."""
    blobs, first = column.to_pylist(), 0
    while first < len(blobs):
        last, n = first, 0
        while last < len(blobs) and (last == first or n + len(blobs[last]) // 4 <= most):
            n += len(blobs[last]) // 4
            last += 1
        none = np.zeros(0, np.int64)
        yield first, last, Words(none, none, mix(np.frombuffer(b"".join(blobs[first:last]), np.uint32).astype(np.uint64)), np.concatenate([[0], np.cumsum([len(b) // 4 for b in blobs[first:last]])]).astype(np.int64))
        first = last


def passages(docs: DataFrame, least_words: int = 50, least_identity: float = 0.8, buckets: int | None = None) -> DataFrame:
    """Passages of a document that a smaller one has as well: doc_id, other_doc_id, where in both, equal words and identity."""
    buckets = buckets or buckets_for(docs)
    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").where("doc_id is not null and text is not null")
    names = None
    if slim.count() > slim.select("doc_id").distinct().count():
        # texts that share a doc_id are numbered in its order, and their passages named by it again
        several = numbered(slim.distinct(), ["doc_id", "text"], "x_number")
        names, slim = several.select("x_number", "doc_id"), several.select(F.col("x_number").alias("doc_id"), "text")
    found = _passages(slim, docs, least_words, least_identity, buckets)
    if names is None:
        return found
    own, others = names.select("x_number", F.col("doc_id").alias("x_own")), names.select(F.col("x_number").alias("x_other"), F.col("doc_id").alias("x_theirs"))
    named = found.join(own, F.col("doc_id") == F.col("x_number")).join(others, F.col("other_doc_id") == F.col("x_other")).where("x_own <> x_theirs")
    return named.select(F.col("x_own").alias("doc_id"), F.col("x_theirs").alias("other_doc_id"), *found.columns[2:])


def _passages(slim: DataFrame, docs: DataFrame, least_words: int, least_identity: float, buckets: int) -> DataFrame:
    """As `passages` for texts of different ids."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in flat(batch.column(1)):
                w = words(t)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(t.first, len(t)), pa.array([(w.hash[w.ptr[i] : w.ptr[i + 1]] >> np.uint64(32)).astype(np.uint32).tobytes() for i in range(len(t))], pa.binary())], names=["id", "spelt"])

    spelt = stash(slim.mapInArrow(spell, "id long, spelt binary"), "chain-spelt")

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in pieces(b, 1)):
            ids = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            hs, ds, ps = [], [], []
            for first, last, w in spelt_words(batch.column(1)):
                h, ptr = shingles(w, K)
                at, d = seeds(h, ptr)
                hs.append(h[at])
                ds.append(ids[d + first])
                ps.append(at - ptr[d])
            if not hs:
                continue
            h, d, p = np.concatenate(hs), np.concatenate(ds), np.concatenate(ps)
            by = np.lexsort((p, d, h))
            h, d, p = h[by], d[by], p[by]
            # the k-th place of a seed in its document meets the k-th of others, so that repeated lines stay in step
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
            turn = np.arange(len(h)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(h) else p
            plain = h
            h = np.where(turn > 0, mix(h + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), h)
            by = np.lexsort((p, d, h))
            h, d, p, turn, plain = h[by], d[by], p[by], turn[by], plain[by]
            # all turns of a seed are in one bucket: where a turn has no smaller document, the first turn's stands in
            order, cut = by_bucket(plain, buckets)
            rows: list[list] = [[], [], [], []]
            for b in np.flatnonzero(np.diff(cut)):
                x = order[cut[b] : cut[b + 1]]
                new = np.ones(len(x), dtype=bool)
                new[1:] = h[x[1:]] != h[x[:-1]]
                keys, more = h[x[new]], np.flatnonzero(turn[x] > 0)
                plain_key = np.searchsorted(keys, plain[x[more]])
                for o, v in zip(rows, (int(b), keys.tobytes(), np.append(np.diff(np.flatnonzero(np.append(new, True))), [*more, *plain_key]).astype(np.int32).tobytes(), packed(d[x], p[x]))):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *[pa.array(r, pa.binary()) for r in rows[1:]]], names=["bucket", "keys", "seed", "places"])

    def match(_: tuple, rows: pa.Table) -> pa.Table:
        size = [len(x) // 8 for x in rows["keys"].to_pylist()]
        k, cut = joined(rows["keys"], np.uint64), np.concatenate([[0], np.cumsum(size)])
        seed, places = [np.frombuffer(x, np.int32) for x in rows["seed"].to_pylist()], [unpacked(x) for x in rows["places"].to_pylist()]
        heads = [np.cumsum(x[:n]) - x[:n] for x, n in zip(seed, size)]
        d, p = (np.concatenate([x[i][at] for x, at in zip(places, heads)]) for i in (0, 1))
        by = np.lexsort((p, d, k))
        new = np.ones(len(k), dtype=bool)
        new[1:] = k[by][1:] != k[by][:-1]
        head = np.empty(len(k), dtype=np.int64)
        head[by] = by[new][np.cumsum(new) - 1]
        found = []
        for i, (x, (e, f)) in enumerate(zip(seed, places)):
            r, q = d[head[cut[i] : cut[i + 1]]], p[head[cut[i] : cut[i + 1]]]
            s = np.repeat(np.arange(len(r)), x[: len(r)])
            more, plain_key = x[len(r) :].reshape(2, -1)
            alone = r[s[more]] >= e[more]
            s[more[alone]] = plain_key[alone]
            ok = r[s] < e
            found.append(np.stack([e[ok], r[s][ok], f[ok], q[s][ok]]))
        return dealt(np.concatenate(found, axis=1))

    def dealt(x: np.ndarray) -> pa.Table:
        """Matches (doc_id, other, p, q), a blob for each bucket of doc_id."""
        order, cut = by_bucket(x[0].view(np.uint64), buckets)
        some = np.flatnonzero(np.diff(cut))
        return pa.table({"part": pa.array(some.astype(np.int32)), "matches": pa.array([np.ascontiguousarray(x[:, order[cut[b] : cut[b + 1]]]).tobytes() for b in some], pa.binary())})

    def keyed(h: np.ndarray, d: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        """Places (d, p) of keys h, a blob for each bucket."""
        order, cut = by_bucket(h, buckets)
        some = np.flatnonzero(np.diff(cut))
        blobs = [order[cut[b] : cut[b + 1]] for b in some]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([h[x].tobytes() for x in blobs], pa.binary()), pa.array([packed(d[x], p[x]) for x in blobs], pa.binary())], names=["bucket", "keys", "places"])

    def ordered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(key, document, place, where the key begins) in order."""
        h = joined(rows["keys"], np.uint64)
        d, p = (np.concatenate(x) for x in zip(*[unpacked(m) for m in rows["places"].to_pylist()]))
        by = np.lexsort((p, d, h))
        h, d, p = h[by], d[by], p[by]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        return h, d, p, np.flatnonzero(new)[np.cumsum(new) - 1]

    def meet(_: tuple, rows: pa.Table) -> pa.Table:
        """Each place with the first document that has its key, and with the last one before its own."""
        h, d, p, head = ordered(rows)
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        last = np.flatnonzero(new)[np.cumsum(new) - 1] - 1
        one, two = d[head] < d, (last > head) & (d[head] < d)
        x = np.stack([np.concatenate([d[one], d[two]]), np.concatenate([d[head][one], d[last[two]]]), np.concatenate([p[one], p[two]]), np.concatenate([p[head][one], p[last[two]]])])
        return dealt(np.unique(x, axis=1))

    told = spelt.mapInArrow(tell, "bucket int, keys binary, seed binary, places binary")
    matched = told.groupBy("bucket").applyInArrow(match, "part int, matches binary")
    least_span = least_words - K + 1 - 2 * (WINDOW - 1) - 1  # from the first to the last seed of an equal run of least_words

    def chain(_: tuple, rows: pa.Table) -> pa.Table:
        d, r, p, q = np.concatenate([np.frombuffer(m, np.int64).reshape(4, -1) for m in rows["matches"].to_pylist()], axis=1)
        # a chain may be one seed: edits can have removed all others of its passage
        pair, at, several = chained(d, r, p, q)
        out = [(x, y, c[0][0], c[0][1], c[-1][0], c[-1][1], np.array([v[:2] for v in c[1:]], dtype=np.int32).tobytes() if len(c) > 1 else None) for x, y, c in several]
        # where all seeds are known from smaller documents, an equal run can lie, whichever these are: other is null, p and q its first and last seed
        by = np.lexsort((p, d))
        d, p = d[by], p[by]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (p[1:] - p[:-1] > WINDOW)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(d)) - 1
        ok = p[b] - p[a] >= least_span
        out += [(x, None, y, z, None, None, None) for x, y, z in zip(d[a[ok]].tolist(), p[a[ok]].tolist(), p[b[ok]].tolist())]
        # and where known seeds follow each other closely enough for a passage with edits: marked by an empty `more`
        new[1:] = (d[1:] != d[:-1]) | (p[1:] - p[:-1] > OPEN_GAP)
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(d)) - 1
        ok = (p[b] - p[a] >= least_span // 2) & (b - a >= 2)
        out += [(x, None, y, z, None, None, b"") for x, y, z in zip(d[a[ok]].tolist(), p[a[ok]].tolist(), p[b[ok]].tolist())]
        columns = list(zip(*out)) or [()] * 7
        whole = [pa.concat_arrays([pa.array(v, pa.int64()), pa.array(c, pa.int64())]) for v, c in zip((*pair, *at, *at), columns)]
        more = pa.concat_arrays([pa.nulls(pair.shape[1], pa.binary()), pa.array(columns[6], pa.binary())])
        return pa.table([*whole, more], names=["doc_id", "other", "p", "q", "last_p", "last_q", "more"])

    found_as = "doc_id long, other long, p long, q long, last_p long, last_q long, more binary"

    starts = stash(matched.groupBy("part").applyInArrow(chain, found_as), "chain-found")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5, 6)]
            bound, inner = batch.column(2).offsets.to_pylist(), batch.column(2).values
            ps, qs, sizes, mores = (inner.field(n).to_pylist() for n in ("p", "q", "size", "more"))
            for d, r, low, after, y_low, y_after, first, last, x, y in zip(*columns, bound, bound[1:], views(batch.column(7)), views(batch.column(8))):
                own: list[tuple] | None = []
                seen: list[tuple] = []  # stretches that were accepted
                tried: dict[int, list[tuple[int, int]]] = {}  # runs that alignments went through, by diagonal: another start there leads nowhere else
                for s in range(first, last):
                    p, q, size = ps[s] - low, qs[s] - y_low, sizes[s]
                    anchors = [(p, q)] + ([(u - low, v - y_low) for u, v in np.frombuffer(mores[s], np.int32).reshape(-1, 2).tolist()] if mores[s] else [])
                    if any(a <= p and p + size <= b and c <= q < e for a, b, c, e, _ in seen):
                        continue
                    if any(a <= p < b for a, b in tried.get(p - q, ())):
                        continue
                    if len(anchors) == 1 and size == 1 and hopeless(x, y, p, q, least_words):
                        continue
                    runs = align(x, y, anchors)
                    # what lies beyond the excerpts could have a say
                    (a, c, *_), (b, e, n, _) = runs[0], runs[-1]
                    if (low and a < MOST_GAP + 3) or (after and len(x) - b - n < MOST_GAP + 3) or (y_low and c < MOST_GAP + 3) or (y_after and len(y) - e - n < MOST_GAP + 3):
                        own = None
                        break
                    if s + 1 < last:
                        for a, c, n, _ in runs:
                            tried.setdefault(a - c, []).append((a, a + n))
                    for g in good(runs, least_words, least_identity):
                        if g not in seen:
                            seen.append(g)
                            a, b, c, e, n = g
                            own.append((d, r, a + low, b + low, c + y_low, e + y_low, n, n / max(b - a, e - c)))
                out += [(d, r, *[None] * 6)] if own is None else own
            columns = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 7 + [pa.float64()])], names=["doc_id", "other_doc_id", "first_word", "end_word", "other_first_word", "other_end_word", "n_equal", "identity"])

    # how far an excerpt goes beyond a pair's starts: `hopeless` looks so far, in the other text by MOST_GAP further
    margin = {"x": max(NEAR, least_words + K), "y": max(NEAR, least_words + K) + MOST_GAP}

    def excerpt(frame: DataFrame, side: str, first: str, last: str, low: str, after: str, whole: bool) -> DataFrame:
        """Of the text in column `side` the words about those from first to last, where they begin, and how many come after."""
        if whole:
            return frame.withColumns({low: F.lit(0).cast("bigint"), after: F.lit(0).cast("bigint")})
        frame = frame.withColumn(low, F.greatest(F.col(first) - margin[side], F.lit(0)).cast("bigint"))
        end = f"{last} + {margin[side]}"
        frame = frame.withColumn(after, F.expr(f"greatest(length({side}) div 4 - ({end}), 0L)"))
        return frame.withColumn(side, F.expr(f"substring({side}, cast(4 * {low} + 1 as int), cast(4 * ({end} - {low}) as int))"))

    def passed(pairs: DataFrame, name: str) -> DataFrame:
        """Passages of pairs (doc_id, other, starts, from where to where these go in both): from excerpts of the texts, or from all of them if an alignment reaches an excerpt's end."""

        def against(pairs: DataFrame, whole: bool) -> DataFrame:
            # of few documents the texts are picked first, so that not all are shuffled
            texts = spelt
            ids = stash(pairs.select(F.col("doc_id").alias("of")).unionAll(pairs.select("other")).distinct(), f"chain-{name}-ids")
            if ids.count() <= BROADCAST_IDS and 4 * ids.count() <= spelt.count():
                texts = spelt.join(F.broadcast(ids), F.col("id") == F.col("of"), "left_semi")
            both = pairs.join(texts.withColumnRenamed("spelt", "x"), F.col("doc_id") == F.col("id")).drop("id")
            both = excerpt(both, "x", "p0", "p1", "low", "after", whole)
            both = both.join(texts.withColumnRenamed("spelt", "y"), F.col("other") == F.col("id")).drop("id")
            both = excerpt(both, "y", "q0", "q1", "y_low", "y_after", whole)
            return both.select("doc_id", "other", "starts", "low", "after", "y_low", "y_after", "x", "y").mapInArrow(aligned, SCHEMA)

        near = stash(against(pairs, False), f"chain-{name}-near")
        wide = near.where("n_equal is null").select("doc_id", F.col("other_doc_id").alias("other"))
        if wide.isEmpty():
            return near
        again = stash(pairs.join(F.broadcast(wide) if wide.count() <= BROADCAST_IDS else wide, ["doc_id", "other"], "left_semi"), f"chain-{name}-wide")
        return near.where("n_equal is not null").unionAll(against(again, True))

    def paired(found: DataFrame) -> DataFrame:
        size = F.col("size").cast("bigint")
        starts = F.sort_array(F.collect_list(F.struct("p", "q", size.alias("size"), "more"))).alias("starts")
        return found.groupBy("doc_id", "other").agg(starts, F.min("p").alias("p0"), F.max(F.col("last_p") + size).alias("p1"), F.min("q").alias("q0"), F.max(F.col("last_q") + size).alias("q1"))

    first = stash(passed(stash(paired(starts.where("other is not null").withColumn("size", F.lit(1))), "chain-pairs"), "first"), "chain-first")

    # stretches of known seeds that no passage came of, as their references differ: their windows are compared with each other
    done = first.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "end_word")).alias("done"))
    left = starts.where("other is null and length(more) = 0").groupBy("doc_id").agg(F.collect_list(F.struct("p", "q")).alias("spans"))
    left = left.join(done, "doc_id", "left").where("exists(spans, s -> not exists(coalesce(done, array()), v -> v.first_word <= s.p and s.q < v.end_word))")
    left = left.join(spelt, F.col("doc_id") == F.col("id")).select("id", "spelt", "spans", "done")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, spans, done = (batch.column(i).to_pylist() for i in (0, 2, 3))
            hs, ds, ps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for first, last, w in spelt_words(batch.column(1)):
                h, ptr = shingles(w, K)
                for i in range(first, last):
                    k, at = signatures(h[ptr[i - first] : ptr[i - first + 1]], uncovered([(v["p"], v["q"]) for v in spans[i]], [(v["first_word"], v["end_word"]) for v in done[i] or []], least_words // 2), least_words - K + 1)
                    hs.append(k)
                    ds.append(np.full(len(k), ids[i]))
                    ps.append(at)
            yield keyed(np.concatenate(hs), np.concatenate(ds), np.concatenate(ps))

    signed = left.mapInArrow(sign, "bucket int, keys binary, places binary").groupBy("bucket").applyInArrow(meet, "part int, matches binary")
    anew = signed.groupBy("part").applyInArrow(chain, found_as).where("other is not null")

    # chains that lie in a passage already lead to nothing new
    anew = anew.join(done, "doc_id", "left").where(f"not exists(coalesce(done, array()), v -> v.first_word <= p and last_p + {K} <= v.end_word)").drop("done")
    anew = paired(anew.withColumn("size", F.lit(1)))
    first = stash(first.unionAll(passed(stash(anew, "chain-anew"), "anew")).distinct(), "chain-known")

    # equal runs that seeds did not lead to: their windows of least_words are elected themselves
    spans = starts.where("other is null and more is null").groupBy("doc_id").agg(F.collect_list(F.struct("p", "q")).alias("spans"))
    done = first.groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "end_word")).alias("done"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, done, x in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                h = windows(np.frombuffer(x, np.uint32), least_words)
                want = np.zeros(len(h), dtype=bool)
                for v in spans:
                    want[max(v["p"] - WINDOW + 1, 0) : max(v["q"] - (least_words - K + 1 - WINDOW) + 1, 0)] = True
                for v in done or []:
                    want[v["first_word"] : v["end_word"] - least_words + 1] = False
                if want.any():
                    out.append(h[want])
            yield pa.RecordBatch.from_arrays([pa.array([len(h) for h in out], pa.int64()), pa.array([h.tobytes() for h in out], pa.binary())], names=["n", "asked"])

    asks = spans.join(done, "doc_id", "left").join(spelt, F.col("doc_id") == F.col("id")).select("spans", "done", "spelt").mapInArrow(ask, "n long, asked binary")
    asks = stash(asks, "chain-asks")
    n = asks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not n:
        return first
    bits = min(max(16 * n, 1 << 16), MOST_BITS).bit_length() - 1

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << bits >> 3, dtype=np.uint8)
        for batch in batches:
            at = np.unique(joined(pa.chunked_array([batch.column(0)]), np.uint64) >> np.uint64(64 - bits))
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))
        parts = held.reshape(-1, 1 << 10)
        some = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["at", "bits"])

    def unite(key: tuple, rows: pa.Table) -> pa.Table:
        return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"].to_pylist()]).tobytes()], pa.binary())})

    told_bits = np.zeros((1 << bits >> 13, 1 << 10), dtype=np.uint8)
    for r in asks.select("asked").mapInArrow(mark, "at int, bits binary").groupBy("at").applyInArrow(unite, "at int, bits binary").toLocalIterator():
        told_bits[r["at"]] = np.frombuffer(r["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(told_bits.reshape(-1))

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, ds, ps = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = windows(np.frombuffer(x, np.uint32), least_words)
                i = h >> np.uint64(64 - bits)
                p = np.flatnonzero(sent.value[i >> np.uint64(3)] & (np.uint8(128) >> (i & np.uint64(7)).astype(np.uint8)))
                hs.append(h[p])
                ds.append(np.full(len(p), d))
                ps.append(p)
            yield keyed(np.concatenate(hs), np.concatenate(ds), np.concatenate(ps))

    def settle(_: tuple, rows: pa.Table) -> pa.Table:
        _, d, p, head = ordered(rows)
        ok = d[head] < d
        return dealt(np.stack([d[ok], d[head][ok], p[ok], p[head][ok]]))

    def merge(_: tuple, rows: pa.Table) -> pa.Table:
        d, r, p, q = np.concatenate([np.frombuffer(m, np.int64).reshape(4, -1) for m in rows["matches"].to_pylist()], axis=1)
        by = np.lexsort((p, p - q, r, d))
        d, r, p, q = d[by], r[by], p[by], q[by]
        new = np.ones(len(d), dtype=bool)
        new[1:] = (d[1:] != d[:-1]) | (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (q[1:] != q[:-1] + 1)
        a = np.flatnonzero(new)
        size = np.diff(np.append(a, len(d))) - 1 + least_words
        return pa.table({n: pa.array(c.astype(np.int64)) for n, c in zip(("doc_id", "other", "p", "q", "size"), (d[a], r[a], p[a], q[a], size))})

    runs = spelt.mapInArrow(offer, "bucket int, keys binary, places binary").groupBy("bucket").applyInArrow(settle, "part int, matches binary").groupBy("part").applyInArrow(merge, "doc_id long, other long, p long, q long, size long")
    # runs that lie in a passage of the first round are done
    runs = runs.join(done, "doc_id", "left").where("not exists(coalesce(done, array()), v -> v.first_word <= p and p + size <= v.end_word)").drop("done")
    second = passed(stash(paired(runs.withColumns({"last_p": F.col("p"), "last_q": F.col("q"), "more": F.lit(None).cast("binary")})), "chain-runs"), "second")
    return first.unionAll(second).distinct()
