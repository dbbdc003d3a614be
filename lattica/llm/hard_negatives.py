"""Hard negatives by product quantisation with stored residual norms, exact.

Vectors are cut into parts of `sub` components; a part is coded as the nearest of 256
centroids, and the norm of what is left of it is stored, rounded up. A table of the anchor's
products with all centroids gives a score without the vectors; by the Cauchy-Schwarz
inequality it is off by no more than the sum, over the parts, of the anchor's norm times the stored one.
A row is a candidate where these bounds allow it a place among the first of a window; candidates
are scored by exact integer products. Codebooks come from at most `sample_rows` rows (those of least hash of vec_id); the
result doesn't depend on them.

All anchors (vec_id divisible by `every`) meet all rows in blocks: rows are dealt to groups of about
`group_rows` by a hash, so that labels and copies don't matter; anchors are sent to each group, pass over it batch by batch,
and leave their first few rows of it. The first pass finds positives, the second the negatives of each positive's window.

Rows with a null vec_id, label or vector, or with a component that is null or not finite take no part. Vectors of
unequal lengths are filled up with zeros; an empty one scores 0 with all. Rows that share a vec_id are rows of their own (and
anchors of their own). Of equal scores the smaller vec_id is first. Products beyond 64 bits are computed with
whole numbers of any size; such scores count as the nearest long. Other columns are ignored; without rows there is no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import partitions, stash

CENTROIDS = 256
_BATCH = 64
_LONG = 1 << 63


def codebooks(sample: np.ndarray, sub: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """(parts, 256, sub): centroids of each part by Lloyd's method."""
    rng = np.random.default_rng(seed)
    parts = sample.shape[1] // sub
    out = np.zeros((parts, CENTROIDS, sub))
    for p in range(parts):
        x = sample[:, p * sub : (p + 1) * sub]
        c = x[rng.integers(0, len(x), CENTROIDS)]
        for _ in range(rounds):
            near = nearest(x, c)
            n = np.bincount(near, minlength=CENTROIDS)
            for k in range(sub):
                c[:, k] = np.where(n > 0, np.bincount(near, x[:, k], CENTROIDS) / np.maximum(n, 1), c[:, k])
        out[p] = c
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T), axis=1)


def quantise(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms) of each row and part; norms are rounded up."""
    parts, _, sub = books.shape
    codes, left = np.zeros((len(v), parts), np.uint8), np.zeros((len(v), parts))
    for p in range(parts):
        x = v[:, p * sub : (p + 1) * sub]
        codes[:, p] = nearest(x, books[p])
        left[:, p] = np.sqrt(((x - books[p][codes[:, p]]) ** 2).sum(axis=1))
    return codes, left * (1 + 1e-9)


def bounds(a: np.ndarray, codes: np.ndarray, left: np.ndarray, books: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores by table, how far they can be off) of each anchor and row. norms: the rows' own, for the rounding of the sums."""
    parts, _, sub = books.shape
    cut = a.reshape(len(a), parts, sub)
    tables = np.einsum("aps,pcs->pac", cut, books)
    score = np.zeros((len(a), len(codes)))
    for p in range(parts):
        score += np.take(tables[p], codes[:, p], axis=1)
    size = np.sqrt((cut**2).sum(axis=2))
    slack = 1e-12 * np.sqrt((a**2).sum(axis=1))[:, None] * (norms + left.sum(axis=1))[None, :]
    return score, size @ left.T * (1 + 1e-9) + slack


def _whole(v: np.ndarray, wide: bool) -> np.ndarray:
    """Whole numbers of floats that are whole."""
    if not wide:
        return v.astype(np.int64)
    return np.array([[int(x) for x in row] for row in v], dtype=object).reshape(v.shape)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros."""
    n = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < n[:, None]] = np.asarray(column.flatten())
    return out


class Group:
    """The rows of a group, with their codes."""

    def __init__(self, row: np.ndarray, vec_id: np.ndarray, label: np.ndarray, v: np.ndarray, codes: np.ndarray, left: np.ndarray):
        order = np.lexsort((row, vec_id))  # of equal scores the first is the smaller
        self.row, self.vec_id, self.label, self.v, self.codes, self.left = row[order], vec_id[order], label[order], v[order], codes[order], left[order]
        self.norms = np.sqrt((self.v**2).sum(axis=1))
        self.most = np.abs(self.v).max(initial=0)
        self.whole = self.wide = None

    def first(self, a: np.ndarray, n: int, score: np.ndarray, off: np.ndarray, allowed: np.ndarray, low: int = -_LONG, high: int = _LONG - 1) -> list[tuple[int, int]]:
        """The first n rows by exact score of those `allowed` with scores from low to high: [(place, score)]."""
        least, most = score - off, score + off
        wide = float(self.most) * float(np.abs(a).max(initial=0)) * max(1, len(a)) >= 1 << 62
        if wide:
            least, most = np.clip(least, -_LONG, _LONG), np.clip(most, -_LONG, _LONG)
        maybe = allowed & (most >= _beside(low, -1)) & (least <= _beside(high, 1))
        sure = least[maybe & ((least > _beside(low, 1)) | (low == -_LONG)) & ((most < _beside(high, -1)) | (high == _LONG - 1))]
        if len(sure) >= n:
            maybe &= most >= np.partition(sure, len(sure) - n)[len(sure) - n]
        at = np.flatnonzero(maybe)
        if not len(at):
            return []
        if self.whole is None or self.wide != wide:
            self.whole, self.wide = _whole(self.v, wide), wide
        exact = self.whole[at] @ _whole(a[None, :], wide)[0]
        if wide:
            exact = np.array([max(-_LONG, min(_LONG - 1, x)) for x in exact], dtype=np.int64)
        keep = (exact >= low) & (exact <= high)
        at, exact = at[keep], exact[keep]
        best = np.lexsort((at, ~exact))[:n]  # ~x falls as x grows, for all longs
        return [(int(at[i]), int(exact[i])) for i in best]


def _beside(x: int, side: int) -> float:
    """A float below (-1) or above (1) a whole number."""
    return float(np.nextafter(float(x), side * np.inf))


def _meet(rows: DataFrame, anchors: DataFrame, groups: int, books: np.ndarray, each, schema: str) -> DataFrame:
    """each(group, anchors of a batch) for all groups and anchors; rows of a group come before the anchors sent to it."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books)
    width = books.shape[0] * books.shape[2]
    here = rows.select("at", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", "codes", "norms", F.lit(None).cast("array<long>").alias("scores"))
    there = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("at"), F.lit(1).alias("kind"), "row", "vec_id", "label", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("norms"), "scores")
    both = here.unionAll(there).repartition(max(1, min(groups, 4 * partitions(spark))), "at").sortWithinPartitions("at", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, held, now, group = sent.value, [], None, None
        for batch in batches:
            at, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero((np.diff(at) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(at)]):
                part = batch.slice(a, b - a)
                if at[a] != now:
                    now, held, group = at[a], [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if group is None and held:
                    x = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    codes = np.frombuffer(b"".join(x.column("codes").to_pylist()), np.uint8).reshape(x.num_rows, -1)
                    left = np.frombuffer(b"".join(x.column("norms").to_pylist()), np.float64).reshape(x.num_rows, -1)
                    group, held = Group(*(np.asarray(x.column(c)) for c in ("row", "vec_id", "label")), _matrix(x.column("v"), width), codes, left), []
                if group is not None:
                    for i in range(0, part.num_rows, _BATCH):
                        yield each(group, part.slice(i, _BATCH), books)

    return both.mapInArrow(work, schema)


def _positives(group: Group, part: pa.RecordBatch, books: np.ndarray, n: int) -> pa.RecordBatch:
    a = _matrix(part.column("v"), books.shape[0] * books.shape[2])
    score, off = bounds(a, group.codes, group.left, books, group.norms)
    out = []
    for i, (row, label) in enumerate(zip(part.column("row").to_pylist(), part.column("label").to_pylist())):
        found = group.first(a[i], n, score[i], off[i], (group.label == label) & (group.row != row))
        out += [(row, int(group.row[k]), int(group.vec_id[k]), s) for k, s in found]
    return _rows(out, ("anchor", "row", "vec_id", "score"))


def _negatives(group: Group, part: pa.RecordBatch, books: np.ndarray, n: int, least: int, most: int) -> pa.RecordBatch:
    a = _matrix(part.column("v"), books.shape[0] * books.shape[2])
    score, off = bounds(a, group.codes, group.left, books, group.norms)
    out = []
    for i, (row, label, wanted) in enumerate(zip(part.column("row").to_pylist(), part.column("label").to_pylist(), part.column("scores").to_pylist())):
        other = group.label != label
        done: dict[int, list] = {}
        for k, p in enumerate(wanted, 1):
            low, high = -(-least * p // 100), most * p // 100
            if p not in done:
                done[p] = group.first(a[i], n, score[i], off[i], other, low, high) if low <= high else []
            out += [(row, k, int(group.row[x]), int(group.vec_id[x]), s) for x, s in done[p]]
    return _rows(out, ("anchor", "place", "row", "vec_id", "score"))


def _rows(out: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def _ranked(found: DataFrame, by: list[str], n: int, name: str) -> DataFrame:
    """The first n rows of each key over all groups, with their rank; ranks are limited before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def _floor(x: Column) -> Column:
    """Rounded down as a double; from 2**52 on doubles are whole."""
    return F.when(F.abs(x) < 1 << 52, F.floor(x).cast("double")).otherwise(x)


def mine(table: DataFrame, label: str = "label", every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, sub: int = 2, group_rows: int = 8192, sample_rows: int = 4096) -> DataFrame:
    """Per anchor and positive the first `negatives` rows of other labels whose score is between `least` and `most` per cent of the positive's.

    Components are taken 256-fold and rounded down. anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = table.sparkSession
    given = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(label).cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id is not null and label is not null and v is not null")
    # NaN - NaN, and infinity - infinity, is NaN, which is not 0
    sound = given.where(F.forall("v", lambda x: x.isNotNull() & (F.coalesce(x, F.lit(0.0)) - F.coalesce(x, F.lit(0.0)) == 0)))
    scaled = stash(sound.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform("v", lambda x: _floor(x * 256)).alias("v")), "negatives-rows")
    n, width = scaled.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    sample = [r[0] for r in scaled.orderBy(F.xxhash64("vec_id"), "vec_id", "row").limit(sample_rows).select("v").collect()]
    parts = max(1, -(-width // sub))
    known = np.zeros((max(1, len(sample)), parts * sub))
    for i, v in enumerate(sample):
        known[i, : len(v)] = v
    books = codebooks(known, sub)
    sent = spark.sparkContext.broadcast(books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, left = quantise(_matrix(batch.column("v"), parts * sub), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x.tobytes() for x in codes], pa.binary()), pa.array([x.tobytes() for x in left], pa.binary())], names=[*batch.schema.names, "codes", "norms"])

    groups = max(-(-n // group_rows), min(2 * partitions(spark), -(-n // 256)), 1)
    coded = scaled.mapInArrow(code, "row long, vec_id long, label long, v array<double>, codes binary, norms binary")
    rows = stash(coded.withColumn("at", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")), "negatives-coded")
    anchors = rows.where(F.col("vec_id") % every == 0).select("row", "vec_id", "label", "v")
    found = _meet(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), groups, books, lambda g, a, b: _positives(g, a, b, positives), "anchor long, row long, vec_id long, score long")
    first = stash(_ranked(found, ["anchor"], positives, "place"), "negatives-positives")
    lists = first.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p")).select("anchor", F.col("p.score").alias("scores"))
    asked = stash(anchors.join(lists, F.col("row") == F.col("anchor")).drop("anchor"), "negatives-anchors")
    found = _meet(rows, asked, groups, books, lambda g, a, b: _negatives(g, a, b, negatives, least, most), "anchor long, place long, row long, vec_id long, score long")
    last = _ranked(found, ["anchor", "place"], negatives, "rank")
    named = first.join(anchors.select(F.col("row").alias("a"), F.col("vec_id").alias("anchor_id")), F.col("anchor") == F.col("a")).select("anchor_id", "anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = last.select(F.col("anchor").alias("x_anchor"), F.col("place").alias("x_place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return out.join(named, (F.col("anchor") == F.col("x_anchor")) & (F.col("place") == F.col("x_place"))).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
