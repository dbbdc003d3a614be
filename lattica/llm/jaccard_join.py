"""N-gram Jaccard join: pivots, regions, triangle-inequality windows; exact.

Documents are sets of 5-word shingles (64-bit hashes), linked from a Jaccard
similarity of 0.8, a distance of at most r = 0.2.

1. A document at distance 1 from all others needs no region. In hash order, linked
   sets of n and m shingles share many of the first 30 %: at least
   4(n+m)/9 - 0.7 max(n, m). Documents with fewer shingles there that occur
   elsewhere are settled. (Unrelated texts are all at distance 1 from each other, so
   pivots cannot part them; this step stands in for that.)
2. Equal sets are one class, the rest goes on by its least doc_id.
3. First regions: the bound of step 1 holds in any common order, so also with frequent
   shingles put last; the holder of a shingle with the least random rank is its pivot. x
   meets the pivots of its first 30 %, its nearest in most shingles. It may leave those it
   meets in fewest, in less than half of its bound of shingles together: what it shares
   with a partner in the regions that either left is then less than what they share, so
   linked documents meet in at least one region. In the others x stays as replica.
4. A region beyond a size is cut by pivots of its own, documents of least random rank
   that are more than 4r apart, to which all its members' exact distances are computed.
   The nearest pivot is a member's home; members within r of it are its core, linked
   through it and never compared with each other. The others go to their home's cell, and
   as boundary replicas to each cell q with d(x,q) <= d(x,home) + 2r: the Voronoi cells of
   linked documents overlap by that. Cells are regions again, with pivots of their own.
   Unrelated texts are at distance 1 from all pivots; those over 0.6 from each (with the
   boundary down to 0.4) form one more cell. A core is compared, in chunks, with its guests:
   the cell's members within 2r of the pivot. (No member of another core is so near.)
   Where cells hold more than half as many members again, or one of them nearly all, the
   pivots part nothing: the region is compared chunk by chunk instead, as is any left after
   MOST_DEPTH cuts. Memory stays bounded, and nothing is left out.
5. In a region of bearable size members take turns as pivots: exact distances give links,
   and windows, as x and y with |d(x,p) - d(y,p)| > r cannot be linked. Documents that
   links have joined need no comparison.
6. Components of the links, by stars.

Null and empty texts have n_shingles 0 and are their own component; with fewer words
than five the whole sequence is one shingle; equal sets (so repeated rows) are linked;
rows that share a doc_id are one document when components are formed, whatever their
texts; rows without doc_id get no component. Other columns, whatever their names, are
ignored by `join` and carried by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import buckets_for, by_bucket, flat, free, joined, mix, quoted, ranges, sets, shingles, stash, words
from lattica.llm.components import components

_U = np.uint64
#: Regions of more documents, or more shingles, are cut, by so many pivots at most, so often at most.
MOST_REGION, MOST_WEIGHT, MOST_PIVOTS, MOST_DEPTH = 256, 1 << 20, 32, 4
#: So many frequent shingles at most are told to all tasks; so many ids, and places in regions, are broadcast.
MOST_FREQUENT, BROADCAST_IDS, BROADCAST_ROWS = 1 << 18, 1 << 20, 1 << 15
#: The distance of linked documents, that of those which no pivot is near, and room for rounding.
R, FAR, EPS = 0.2, 0.6, 1e-9
#: A cut is given up where cells have so many times the members, or one cell has this share of them.
MOST_COPIES, MOST_SHARE = 1.5, 0.8


def linked(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 100 * both >= 80 * (n + m - both)


def needed(n: np.ndarray) -> np.ndarray:
    """Least number of shingles that linked sets share among the first 30 %, for a set of n: the worst case over partners' sizes."""
    small, large = np.ceil(0.8 * n), np.floor(1.25 * n)
    a = 4 * (n + small) / 9 - np.floor(0.7 * n)
    b = 4 * (n + large) / 9 - np.floor(0.7 * large)
    return np.maximum(1, np.floor(np.minimum(a, b) - 1e-6)).astype(np.int32)


def signature(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    out = []
    for seed in (0x1234567, 0x7654321):
        c = np.concatenate([[_U(0)], np.cumsum(mix(h ^ _U(seed)))])
        out.append(mix(c[ptr[1:]] - c[ptr[:-1]] + np.diff(ptr).astype(np.uint64)).view(np.int64))
    return out[0], out[1]


def _blobs(key: np.ndarray, values: np.ndarray, buckets: int) -> tuple[list[int], list[bytes], list[bytes]]:
    order, cut = by_bucket(key, buckets)
    some = np.flatnonzero(np.diff(cut))
    parts = [order[cut[b] : cut[b + 1]] for b in some]
    return some.tolist(), [key[x].tobytes() for x in parts], [values[x].tobytes() for x in parts]


def survey(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """Written rows of two kinds: of a document (row, doc_id, n, fingerprints, need, known), and of a bucket (first shingles and their rows).

    A shingle that several documents of a batch share is counted there (`known`) and told on once, as row -1.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            n, sig, own, at = [], ([], []), [], []
            for t in flat(batch.column(1)):
                h, ptr = sets(*shingles(words(t), k))
                size = np.diff(ptr)
                n.append(size)
                for s, x in zip(sig, signature(h, ptr)):
                    s.append(x)
                first = size - np.floor(0.7 * size).astype(np.int64)
                own.append(h[ranges(ptr[:-1], first)])
                at.append(np.repeat(np.arange(t.first, t.last), first))
            if not n:
                continue
            size, own, at = np.concatenate(n), np.concatenate(own), np.concatenate(at)
            order = np.argsort(own, kind="stable")
            own, at = own[order], at[order]
            new = np.ones(len(own), dtype=bool)
            new[1:] = own[1:] != own[:-1]
            count = np.diff(np.append(np.flatnonzero(new), len(own)))
            many = np.repeat(count > 1, count)
            known = np.bincount(at[many], minlength=len(size))
            told = new | ~many
            b, x, y = _blobs(own[told], np.where(many, -1, at + row)[told], buckets)
            m, j = len(size), len(b)
            full = lambda v, t: pa.concat_arrays([pa.array(v, t), pa.nulls(j, t)])
            part = lambda v, t: pa.concat_arrays([pa.nulls(m, t), pa.array(v, t)])
            yield pa.RecordBatch.from_arrays(
                [full(np.arange(row, row + m), pa.int64()), pa.concat_arrays([batch.column(0), pa.nulls(j, pa.int64())]), full(size, pa.int64()), full(np.concatenate(sig[0]), pa.int64()), full(np.concatenate(sig[1]), pa.int64()), full(needed(size), pa.int32()), full(known.astype(np.int32), pa.int32()), part(b, pa.int32()), part(x, pa.binary()), part(y, pa.binary())],
                names=["row", "doc_id", "n", "a", "b", "need", "known", "bucket", "keys", "rows"],
            )
            row += m

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return stash(slim.mapInArrow(each, "row long, doc_id long, n long, a long, b long, need int, known int, bucket int, keys binary, rows binary"), "join-survey")


def _shared(told: DataFrame, buckets: int) -> DataFrame:
    """(row, more): how many of a row's first shingles other batches told as well."""

    def meet(_: tuple, rows: pa.Table) -> pa.Table:
        h, r = joined(rows["keys"], np.uint64), joined(rows["rows"], np.int64)
        order = np.argsort(h, kind="stable")
        h, r = h[order], r[order]
        same = np.zeros(len(h), dtype=bool)
        same[1:] = h[1:] == h[:-1]
        same[:-1] |= same[1:].copy()
        u, n = np.unique(r[same & (r >= 0)], return_counts=True)
        b, x, y = _blobs(u.astype(np.uint64), n.astype(np.int32), buckets)
        return pa.table({"part": pa.array(b, pa.int32()), "rows": pa.array(x, pa.binary()), "n": pa.array(y, pa.binary())})

    def total(_: tuple, rows: pa.Table) -> pa.Table:
        u, inv = np.unique(joined(rows["rows"], np.int64), return_inverse=True)
        return pa.table({"at": pa.array(u), "more": pa.array(np.bincount(inv, weights=joined(rows["n"], np.int32), minlength=len(u)).astype(np.int64))})

    return told.groupBy("bucket").applyInArrow(meet, "part int, rows binary, n binary").groupBy("part").applyInArrow(total, "at long, more long")


def _frequent(own: DataFrame, least: int = 64) -> np.ndarray:
    """Hashes of frequent shingles, sorted: a hint for the order alone, so counts below 3 in a batch don't matter."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, n = np.unique(joined(pa.chunked_array([batch.column(0)]), np.uint64), return_counts=True)
            u, n = u[n > 2], n[n > 2]
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["s", "n"])

    top = own.select("shingles").mapInArrow(local, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.sort(np.array(top.orderBy(F.desc("n"), "s").limit(MOST_FREQUENT).select("s").toArrow()["s"].to_pylist(), dtype=np.int64).view(np.uint64))


def meetings(own: DataFrame, buckets: int) -> DataFrame:
    """(pivot, node) over all first shingles of the nodes that two nodes or more have, without the regions that a node may leave."""
    sent = own.sparkSession.sparkContext.broadcast(_frequent(own))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, number = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            nodes = np.array(batch.column(0).to_pylist(), dtype=np.int64)
            h, at, spare = [], [], []
            for i, s in enumerate(batch.column(1)):
                s = np.frombuffer(s.as_py(), np.uint64)
                if len(frequent):
                    j = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    late = frequent[j] == s
                    s = np.concatenate([s[~late], s[late]])
                n = len(s)
                s = s[: n - int(np.floor(0.7 * n))]
                h.append(s)
                at.append(np.full(len(s), nodes[i]))
                spare.append(np.full(len(s), (int(needed(np.array([n]))[0]) - 1) // 2))
            if not h:
                continue
            h, at, spare = np.concatenate(h), np.concatenate(at), np.concatenate(spare)
            order, cut = by_bucket(h, buckets)
            rows: list[list] = [[], [], [], [], [], []]
            for b in np.flatnonzero(np.diff(cut)):
                x = order[cut[b] : cut[b + 1]]
                u, inv = np.unique(h[x], return_inverse=True)
                rank = mix(at[x].view(np.uint64))
                by = np.lexsort((rank, inv))
                first = by[np.searchsorted(inv[by], np.arange(len(u)))]
                for o, v in zip(rows, (int(b), number, u.tobytes(), at[x][first].tobytes(), np.bincount(inv).astype(np.int32).tobytes(), np.stack([inv, at[x], spare[x]]).astype(np.int64).tobytes())):
                    o.append(v)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), *[pa.array(r, pa.binary()) for r in rows[2:]]], names=["bucket", "batch", "keys", "pivots", "counts", "members"])

    told = stash(own.select("node", "shingles").mapInArrow(local, "bucket int, batch long, keys binary, pivots binary, counts binary, members binary"), "join-told")

    def elect(_: tuple, rows: pa.Table) -> pa.Table:
        """The pivot of each shingle over all batches, told back to each; -1 where only one node has it."""
        size = [len(x) // 8 for x in rows["keys"].to_pylist()]
        u, inv = np.unique(joined(rows["keys"], np.uint64), return_inverse=True)
        p, n = joined(rows["pivots"], np.int64), joined(rows["counts"], np.int32)
        by = np.lexsort((mix(p.view(np.uint64)), inv))
        best = p[by[np.searchsorted(inv[by], np.arange(len(u)))]]
        best = np.where(np.bincount(inv, weights=n, minlength=len(u)) > 1, best, -1)[inv]
        cut = np.concatenate([[0], np.cumsum(size)])
        return pa.table({"bucket": rows["bucket"], "batch": rows["batch"], "elected": pa.array([best[cut[i] : cut[i + 1]].tobytes() for i in range(len(size))], pa.binary())})

    elected = told.select("bucket", "batch", "keys", "pivots", "counts").groupBy("bucket").applyInArrow(elect, "bucket int, batch long, elected binary")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for m, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m, e = np.frombuffer(m, np.int64).reshape(3, -1), np.frombuffer(e, np.int64)
                p = e[m[0]]
                found.append(np.stack([p, m[1], m[2]])[:, p != -1])
            x = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            x = x[:, np.lexsort((x[1], x[0]))]
            new = np.ones(x.shape[1], dtype=bool)
            new[1:] = (x[:2, 1:] != x[:2, :-1]).any(axis=0)
            count = np.diff(np.append(np.flatnonzero(new), x.shape[1]))
            x = x[:, new]
            yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2]), pa.array(count.astype(np.int64))], names=["pivot", "node", "spare", "met"])

    both = told.select("bucket", "batch", "members").join(elected, ["bucket", "batch"])
    met = both.select("members", "elected").mapInArrow(pairs, "pivot long, node long, spare long, met long")
    met = met.groupBy("pivot", "node").agg(F.min("spare").alias("spare"), F.sum("met").alias("met"))
    # a pivot stays in its own region
    away = F.when(F.col("pivot") != F.col("node"), F.col("met")).otherwise(0)
    fewest = Window.partitionBy("node").orderBy("met", "pivot").rowsBetween(Window.unboundedPreceding, 0)
    return met.withColumn("left", F.sum(away).over(fewest)).where((F.col("left") > F.col("spare")) | (F.col("pivot") == F.col("node"))).select("pivot", "node")


class Region:
    """Sets of a region with an index from shingles to holders."""

    def __init__(self, nodes: np.ndarray, own: list[np.ndarray]):
        self.nodes, self.own = nodes, own
        self.n = np.array([len(s) for s in own], dtype=np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(self.n)])
        h = np.concatenate(own) if own else np.zeros(0, np.uint64)
        holder = np.repeat(np.arange(len(own)), self.n)
        order = np.argsort(h, kind="stable")
        h, self.holder = h[order], holder[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        self.key, self.start = h[new], np.append(np.flatnonzero(new), len(h))

    def common(self, s: np.ndarray) -> np.ndarray:
        """Size of the intersection of s with every set."""
        if not len(self.key):
            return np.zeros(len(self.own), dtype=np.int64)
        i = np.minimum(np.searchsorted(self.key, s), len(self.key) - 1)
        i = i[self.key[i] == s]
        return np.bincount(self.holder[ranges(self.start[i], self.start[i + 1] - self.start[i])], minlength=len(self.own))


def region_links(nodes: np.ndarray, own: list[np.ndarray], queries: np.ndarray | None = None, joined_already: bool = False, kept: int = 8) -> list[tuple[int, int]]:
    """Links that span the components of a region.

    queries: indexes of those to compare with the rest (not among themselves); None: all pairs.
    joined_already: the rest are in one component. Exact: a pair is left out only if it is in
    one component or in no common window.
    """
    g = Region(nodes, own)
    k = len(nodes)
    part, pivots, done, links = np.arange(k), [], np.zeros(k, dtype=bool), []
    rest = np.ones(k, dtype=bool)
    if queries is not None:
        rest[queries] = False
    if joined_already and rest.any():
        part[rest] = np.flatnonzero(rest)[0]
    for x in range(k) if queries is None else queries:
        maybe = (part != part[x]) & (~done if queries is None else rest) & (5 * g.n <= 6.25 * g.n[x] + EPS) & (g.n >= 0.8 * g.n[x] - EPS)
        for d in pivots:
            maybe &= np.abs(d - d[x]) <= R + EPS
        done[x] = True
        if not maybe.any():
            continue
        both = g.common(own[x])
        if len(pivots) < kept:
            pivots.append(1 - both / np.maximum(g.n + g.n[x] - both, 1))
        for y in np.flatnonzero(maybe & linked(both, g.n, g.n[x])):
            if part[y] != part[x]:
                links.append((int(nodes[x]), int(nodes[y])))
                part[part == part[y]] = part[x]
    return links


LINKS = "a long, b long"


def _links(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _own(rows: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    return np.array(rows["node"].to_pylist(), dtype=np.int64), [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]


def _with_sets(rows: DataFrame, own: DataFrame) -> DataFrame:
    """rows (node, ...) with their shingles. Few rows are broadcast, so that the sets are not shuffled to meet them."""
    rows = stash(rows, "join-asked")
    if rows.count() <= BROADCAST_ROWS:
        rows = F.broadcast(rows)
    return own.select(F.col("node").alias("id"), "shingles").join(rows, F.col("node") == F.col("id")).drop("id")


def _whole(regions: DataFrame, own: DataFrame) -> DataFrame:
    """Links within regions (region, node), each in one task."""

    def within(rows: pa.Table) -> pa.Table:
        return _links(region_links(*_own(rows)))

    return _with_sets(regions.select("region", "node"), own).groupBy("region").applyInArrow(within, LINKS)


def _grid(left: DataFrame, right: DataFrame | None, own: DataFrame) -> DataFrame:
    """Links between left and right (region, node, k: the region's number of chunks on that side), chunk by chunk; left's are in one component.

    right None: links within left, whose members are not in one component.
    """
    alone = right is None
    right = left if alone else right
    chunk = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    k = lambda df: df.groupBy("region").agg(F.max("k").alias("others"))
    every = F.explode(F.sequence(F.lit(0), F.col("others") - 1))
    base = left.join(k(right), "region").select("region", "node", chunk.alias("i"), every.alias("j"), F.lit(False).alias("q"))
    ask = right.join(k(left), "region").select("region", "node", every.alias("i"), chunk.alias("j"), F.lit(True).alias("q"))
    both = base.unionByName(ask)
    if alone:
        both = both.where("i < j or (i = j and q)")

    def across(rows: pa.Table) -> pa.Table:
        q = np.array(rows["q"].to_pylist(), dtype=bool)
        return _links(region_links(*_own(rows)) if q.all() else region_links(*_own(rows), np.flatnonzero(q), not alone) if q.any() else [])

    return _with_sets(both, own).groupBy("region", "i", "j").applyInArrow(across, LINKS)


def _chunks(size: str, weight: str) -> Column:
    return F.ceil(F.greatest(F.col(size) / MOST_REGION, F.col(weight) / MOST_WEIGHT)).cast("int")


CORE, OPEN, APART = range(3)


def voronoi(chosen: list[int], pivots: list[np.ndarray], nodes: np.ndarray, own: list[np.ndarray]) -> list[tuple[int, int | None, int, float]]:
    """(kind, cell, node, distance) of the members of a region; cells are nodes of pivots, of which those within 4R of an earlier one don't count.

    CORE: within R of the home; OPEN: in the cell as its home's or as replica; APART: far from all pivots or nearly so (cell null).
    """
    apart: list[int] = []
    for i, s in enumerate(pivots):
        g = Region(np.array([chosen[j] for j in apart]), [pivots[j] for j in apart])
        both = g.common(s)
        if (1 - both / np.maximum(g.n + len(s) - both, 1) > 4 * R + EPS).all():
            apart.append(i)
    chosen = [chosen[i] for i in apart]
    g = Region(np.array(chosen), [pivots[i] for i in apart])
    out = []
    for node, s in zip(nodes.tolist(), own):
        both = g.common(s)
        d = 1 - both / np.maximum(g.n + len(s) - both, 1)
        h = int(np.argmin(d))
        if linked(both[h], g.n[h], len(s)):
            out.append((CORE, chosen[h], node, float(d[h])))
            continue
        if d[h] <= FAR:
            out += [(OPEN, chosen[i], node, float(d[i])) for i in np.flatnonzero(d <= d[h] + 2 * R + EPS)]
        if d[h] > FAR - R - EPS:
            out.append((APART, None, node, float(d[h])))
    return out


def _cut(large: DataFrame, own: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(links, cells as regions of the next depth) of large regions (region, node, members, weight)."""
    rank = F.row_number().over(Window.partitionBy("region").orderBy(F.xxhash64(F.lit(depth), "node"), "node"))
    n = F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(2), F.ceil(F.col("members") / 32)))
    large = large.withColumn("k", _chunks("members", "weight"))
    chosen = large.withColumn("rank", rank).where(F.col("rank") <= MOST_PIVOTS).where(F.col("rank") <= n)
    chosen = chosen.select("region", "node", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk"), F.col("rank").alias("turn"))
    members = large.select("region", "node", F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("chunk"), F.lit(0).alias("turn"))

    def split(key: tuple, rows: pa.Table) -> pa.Table:
        nodes, sets_ = _own(rows)
        turn = np.array(rows["turn"].to_pylist(), dtype=np.int64)
        # in order of rank, so that every chunk has the same pivots
        at, mine = np.argsort(turn, kind="stable")[(turn == 0).sum() :], np.flatnonzero(turn == 0)
        found = voronoi(nodes[at].tolist(), [sets_[i] for i in at], nodes[mine], [sets_[i] for i in mine])
        kind, cell, node, _ = zip(*found) if found else ((),) * 4
        return pa.table({"kind": pa.array(kind, pa.int32()), "region": pa.array([key[0].as_py()] * len(kind), pa.int64()), "cell": pa.array(cell, pa.int64()), "node": pa.array(node, pa.int64()), "near": pa.array([x[3] <= 2 * R + EPS for x in found], pa.bool_())})

    dealt = _with_sets(members.unionByName(chosen), own).groupBy("region", "chunk").applyInArrow(split, "kind int, region long, cell long, node long, near boolean")
    at = stash(dealt.withColumn("next", F.xxhash64("region", "cell", F.lit(depth))), "join-cells")
    core, open_ = at.where(F.col("kind") == CORE), at.where(F.col("kind") != CORE)
    guests = at.where((F.col("kind") == OPEN) & F.col("near"))
    links = core.where("node <> cell").select(F.col("node").alias("a"), F.col("cell").alias("b"))
    links = links.unionAll(_grid(_sized(core.select(F.col("next").alias("region"), "node"), own), _sized(guests.select(F.col("next").alias("region"), "node"), own), own))
    per = open_.groupBy("region", "next").agg(F.count(F.lit(1)).alias("n")).groupBy("region").agg(F.sum("n").alias("copies"), F.max("n").alias("most"))
    members = large.groupBy("region").agg(F.max("members").alias("members"))
    poor = per.join(members, "region").where((F.col("copies") > MOST_COPIES * F.col("members")) | (F.col("most") > MOST_SHARE * F.col("members"))).select("region")
    alike = open_.select("region", "node").distinct().join(poor, "region", "left_semi")
    links = links.unionAll(_grid(_sized(alike, own), None, own))
    return links, open_.join(poor, "region", "left_anti").select(F.col("next").alias("region"), "node")


def _sized(rows: DataFrame, own: DataFrame) -> DataFrame:
    """rows (region, node) with k, the region's number of chunks."""
    n = rows.join(own.select(F.col("node").alias("id"), (F.length("shingles") / 8).alias("n")), F.col("node") == F.col("id"))
    per = n.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight"))
    return rows.join(per.select("region", _chunks("members", "weight").alias("k")), "region")


def region_join(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that meet in a region (pivot, node); large regions are cut by pivots again and again."""
    regions, links = stash(pairs.select(F.col("pivot").alias("region"), "node"), "join-pairs"), []
    sizes = own.select(F.col("node").alias("id"), (F.length("shingles") / 8).alias("n"))
    for depth in range(MOST_DEPTH + 1):
        per = regions.join(sizes, F.col("node") == F.col("id")).groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("weight")).where("members > 1")
        large = (F.col("members") > MOST_REGION) | ((F.col("weight") > MOST_WEIGHT) & (F.col("members") > 2))
        per = stash(per.withColumn("large", large), "join-sizes")
        links.append(stash(_whole(regions.join(per.where("not large"), "region", "left_semi"), own), "join-links"))
        hot = regions.join(per.where("large"), "region")
        if per.where("large").isEmpty():
            break
        if depth == MOST_DEPTH:
            hot = hot.select("region", "node", _chunks("members", "weight").alias("k"))
            links.append(stash(_grid(hot, None, own), "join-links"))
            break
        more, cells = _cut(stash(hot, "join-large"), own, depth)
        links.append(stash(more, "join-links"))
        regions = stash(cells, "join-regions")
    return reduce(DataFrame.unionAll, links)


def join(docs: DataFrame, k: int = 5, buckets: int | None = None) -> DataFrame:
    """Per row of docs (doc_id, text): n_shingles and component_id, the least doc_id that links reach."""
    buckets = buckets or buckets_for(docs)
    rows = survey(docs, k, buckets)
    one = rows.where("row is not null")
    more = _shared(rows.where("bucket is not null").select("bucket", "keys", "rows"), buckets)
    one = stash(one.join(more, F.col("row") == F.col("at"), "left").select("doc_id", "n", "a", "b", (F.col("known") + F.coalesce("more", F.lit(0)) >= F.col("need")).alias("open")), "join-docs")
    some = one.where("n > 0 and open and doc_id is not null")
    classes = stash(some.groupBy("a", "b").agg(F.min("doc_id").alias("node")), "join-classes")
    ids = classes.select(F.col("node").alias("want")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.selectExpr("cast(doc_id as bigint) node", "cast(text as string) text").join(ids, F.col("node") == F.col("want"), "left_semi")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in flat(batch.column(1)):
                h, ptr = sets(*shingles(words(t), k))
                full = np.flatnonzero(np.diff(ptr))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full + t.first)), pa.array([h[ptr[i] : ptr[i + 1]].tobytes() for i in full], pa.binary())], names=["node", "shingles"])

    held = stash(texts.mapInArrow(own, "node long, shingles binary"), "join-sets")
    links = region_join(meetings(held, buckets), held)
    reps = classes.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("node").alias("rep"))
    out = one.join(reps, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0) & F.col("doc_id").isNotNull(), "left")
    out = stash(out.select("doc_id", "n", "rep"), "join-reps")
    # a doc_id with several texts links their classes
    several = out.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    bridges = out.where("rep is not null").join(several, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b").distinct()
    label = components(links.unionAll(bridges))
    at = F.coalesce("rep", "doc_id")
    out = out.join(label, at == F.col("node"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", at).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5) -> DataFrame:
    """docs without near copies: of each component the row of least doc_id stays (all rows without doc_id or shingles do)."""
    gone = free(docs, start="gone")
    found = join(docs, k).where("component_id is not null and n_shingles > 0 and doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()
    found = stash(found, "join-gone")
    if found.count() <= BROADCAST_IDS:
        found = F.broadcast(found)
    return docs.join(found, F.col("doc_id").cast("bigint") == F.col(gone), "left_anti").select(*[quoted(c) for c in docs.columns])
