"""Importance resampling to a target's distribution of n-grams, over bucket-partitioned inverted postings.

Features are the runs of one to `N` consecutive words (maximal runs of lower-case ASCII letters, digits and bytes beyond
ASCII, A-Z lower-cased) joined by one space; a feature's bucket is its CRC-32 modulo `buckets`. Both corpora become postings
(bucket, document, count), a written table packed by chunk of documents and group of buckets. They are shuffled by group, each
next to its buckets' counts in both corpora; there the gains are computed and what each bucket adds to each document of
a chunk is sent, and summed by document. A frequent bucket's postings are split by chunk into `parts`, and its two counts, summed before, go to
each of them. Sorting by score is a range partitioning, and ranks are sums over its sizes.

Null texts have no words; documents without features weigh 0. Each row is a document of its own, also where doc_ids repeat; a null
doc_id is hashed as an empty one and comes last among equal scores. An empty target counts 0 everywhere; without documents there is no result. Other columns are ignored.
"""

from __future__ import annotations

import math
import secrets
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Texts, buckets_for, flat, partitions, stash, words

N = 3
BUCKETS = 10_000
GROUPS = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, dtype=bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SHORT = 32


def _zeros() -> tuple[np.ndarray, np.ndarray]:
    """(tables for 0 to _SHORT zero bytes, for 2**k of them): what CRC-32's register becomes, by the value of each of its bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, one >> 1 ^ np.uint32(0xEDB88320), one >> 1)
    same = np.arange(256, dtype=np.uint32)[None, :] << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    some = [same]
    for _ in range(_SHORT):
        some.append(one[some[-1] & 255] ^ some[-1] >> 8)
    power = [some[1]]
    for _ in range(40):
        power.append(_through(power[-1], power[-1]))
    return np.array(some), np.array(power)


def _through(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 255] ^ table[1][x >> 8 & 255] ^ table[2][x >> 16 & 255] ^ table[3][x >> 24]


SOME, POWER = _zeros()


def after(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of texts moved by `size` bytes: with the next bytes' own CRC-32 on top it is that of both."""
    flat = SOME.reshape(-1)
    at = np.minimum(size, _SHORT).astype(np.int64) * 1024
    out = flat[at + (crc & 255)] ^ flat[at + 256 + (crc >> 8 & 255)] ^ flat[at + 512 + (crc >> 16 & 255)] ^ flat[at + 768 + (crc >> 24)]
    for i in np.flatnonzero(size > _SHORT):  # such words are long themselves
        x, n, k = crc[i : i + 1], int(size[i]), 0
        while n:
            x = _through(POWER[k], x) if n & 1 else x
            n, k = n >> 1, k + 1
        out[i] = x[0]
    return out


def features(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of each feature, its document, words of each document)."""
    w = words(t, strip=_GAP)
    count, size = np.diff(w.ptr), w.end - w.start
    n = len(size)
    doc = np.repeat(np.arange(len(t)), count)
    if not n:
        return np.zeros(0, np.uint32), doc, count
    raw = _LOWER[t.buf].tobytes()
    # each distinct word once; the 64-bit hash only says which may be equal
    order = np.argsort(w.hash, kind="stable")
    new = np.ones(n, dtype=bool)
    new[1:] = w.hash[order][1:] != w.hash[order][:-1]
    crc = np.zeros(n, dtype=np.uint32)
    known = np.array([zlib.crc32(raw[a:b]) for a, b in zip(w.start[order[new]].tolist(), w.end[order[new]].tolist())], dtype=np.uint32)
    crc[order] = known[np.cumsum(new) - 1]
    every, which, run, at = [crc], [doc], crc, np.arange(n)
    space = np.uint32(zlib.crc32(b" "))
    one = np.ones(1, np.int64)
    for k in range(1, N):
        keep = at + k < w.ptr[doc[at] + 1]
        at, run = at[keep], run[keep]
        run = after(after(run, np.broadcast_to(one, run.shape)) ^ space, size[at + k]) ^ crc[at + k]
        every.append(run)
        which.append(doc[at])
    return np.concatenate(every), np.concatenate(which), count


_POSTINGS = "chunk long, part int, size binary, doc binary, times binary, ids array<long>, n_features array<long>, n_words array<long>"


def packed(t: Texts, ids: list, buckets: int, groups: int) -> pa.RecordBatch:
    """The postings of some documents, a row for each group of buckets, and a row (part -1) with the documents.

    size: postings of each bucket (uint32); doc: places of their documents (uint16); times: counts (uint8); a higher count takes several postings.
    """
    crc, doc, n_words = features(t)
    n_docs = len(t)
    key = (crc % np.uint32(buckets)).astype(np.int64) * n_docs + doc
    key = np.sort(key.astype(np.uint32)) if buckets * n_docs < 1 << 32 else np.sort(key)
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times, key = np.diff(np.append(new, len(key))), key[new].astype(np.int64)
    more = -(-times // 255)
    if (more > 1).any():
        last = np.cumsum(more) - 1
        full = np.full(last[-1] + 1, 255)
        full[last] = times - 255 * (more - 1)
        key, times = np.repeat(key, more), full
    bucket, place = np.divmod(key, n_docs) if n_docs else (key, key)
    edges = group_edges(buckets, groups)
    cuts = np.searchsorted(bucket, edges)
    size = np.bincount(bucket, minlength=buckets).astype("<u4")
    place, times = place.astype("<u2"), times.astype(np.uint8)
    chunk = secrets.randbits(62)
    rows = [(chunk, g, size[edges[g] : edges[g + 1]].tobytes(), place[a:b].tobytes(), times[a:b].tobytes(), None, None, None) for g, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
    rows.append((chunk, -1, None, None, None, ids, np.bincount(doc, minlength=n_docs).tolist(), n_words.tolist()))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.list_(pa.int64())] * 3)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in _POSTINGS.split(", ")])


def group_edges(buckets: int, groups: int) -> np.ndarray:
    return np.arange(groups + 1) * buckets // groups


def postings(texts: DataFrame, key: str, name: str, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """The written postings of a table of texts. Chunks have random names; only written ones count, so a task that ran twice does no harm."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 1 << 15) for x in batches for i in range(0, x.num_rows, 1 << 15)):  # places are uint16
            ids = batch.column(0)
            for t in flat(batch.column(1)):
                yield packed(t, ids.slice(t.first, len(t)).to_pylist(), buckets, groups)

    return stash(texts.select(F.col(key).cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).mapInArrow(each, _POSTINGS), name)


def totals(table: DataFrame, buckets: int, groups: int) -> DataFrame:
    """(bucket, n): features of the corpus in each bucket. Every task sums its own before the shuffle."""
    edges = group_edges(buckets, groups)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for g, size, times in zip(*(batch.column(c).to_pylist() for c in range(3))):
                size = np.frombuffer(size, "<u4")
                end = np.concatenate([[0], np.cumsum(np.frombuffer(times, np.uint8), dtype=np.int64)])
                last = np.cumsum(size, dtype=np.int64)
                n[edges[g] : edges[g + 1]] += end[last] - end[last - size]
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    return table.where("part >= 0").select("part", "size", "times").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    return math.floor(1000 * math.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets))))


def weights(docs: DataFrame, target: DataFrame, target_key: str, buckets: int = BUCKETS, groups: int = GROUPS) -> DataFrame:
    """(chunk, place, doc_id, n_features, n_words, weight) for each row of docs."""
    spark = docs.sparkSession
    mine, theirs = postings(docs, "doc_id", "importance-docs", buckets, groups), postings(target, target_key, "importance-target", buckets, groups)
    s, t = totals(mine, buckets, groups).withColumnRenamed("n", "s"), totals(theirs, buckets, groups).select(F.col("bucket").alias("b"), F.col("n").alias("t"))
    counts = stash(s.join(t, F.col("bucket") == F.col("b"), "left").select("bucket", "s", F.coalesce("t", F.lit(0)).alias("t")), "importance-counts")
    all_s = counts.agg(F.coalesce(F.sum("s"), F.lit(0))).first()[0]
    all_t = theirs.where("part < 0").agg(F.coalesce(F.sum(F.aggregate("n_features", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0))).first()[0]
    # so many parts of a group that a task has several (group, part) of a bounded size
    parts = max(1, 8 * max(partitions(spark), buckets_for(docs) // 2) // groups)
    edges = group_edges(buckets, groups)
    group = F.floor(((F.col("bucket") + 1) * groups - 1) / buckets).cast("int")
    both = counts.groupBy(group.alias("g")).agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("c")).select("g", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("r"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("chunk"), *[F.lit(None).cast("binary").alias(c) for c in ("size", "doc", "times")], "c")
    own = mine.where("part >= 0").select(F.col("part").alias("g"), F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("r"), F.lit(1).alias("kind"), "chunk", "size", "doc", "times", F.lit(None).cast(dict(both.dtypes)["c"]).alias("c"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains, base = np.zeros(0, np.int64), 0
        for batch in batches:
            out = []
            for g, kind, chunk, size, doc, times, c in zip(*(batch.column(x).to_pylist() for x in ("g", "kind", "chunk", "size", "doc", "times", "c"))):
                if kind == 0:  # a new group begins
                    base = edges[g]
                    gains = np.zeros(edges[g + 1] - base, dtype=np.int64)
                    for x in c:
                        gains[x["bucket"] - base] = gain(x["s"], x["t"], all_s, all_t, buckets)
                    continue
                add = np.repeat(gains, np.frombuffer(size, "<u4")) * np.frombuffer(times, np.uint8)
                place = np.frombuffer(doc, "<u2")
                # sums of whole numbers far below 2**53 are exact
                out.append((chunk, np.bincount(place, add).astype("<i8").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.binary()))], names=["chunk", "adds"])

    met = both.unionAll(own).repartition(max(partitions(spark), buckets_for(docs) // 2), "g", "r").sortWithinPartitions("g", "r", "kind").mapInArrow(each, "chunk long, adds binary")
    lists = "ids array<long>, n_features array<long>, n_words array<long>"
    docs_of = mine.where("part < 0").select("chunk", F.lit(None).cast("binary").alias("adds"), "ids", "n_features", "n_words")
    parts_of = met.select("chunk", "adds", *[F.lit(None).cast("array<long>").alias(x.split()[0]) for x in lists.split(", ")])

    def add(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        k = next(i for i, x in enumerate(rows["ids"]) if x is not None)
        total = np.zeros(len(rows["ids"][k]), dtype=np.int64)
        for x in rows["adds"]:
            if x is not None:
                x = np.frombuffer(x, "<i8")
                total[: len(x)] += x
        n = len(total)
        return pa.table({"chunk": pa.array([rows["chunk"][k]] * n, pa.int64()), "place": pa.array(np.arange(n)), "doc_id": pa.array(rows["ids"][k], pa.int64()), "n_features": pa.array(rows["n_features"][k], pa.int64()), "n_words": pa.array(rows["n_words"][k], pa.int64()), "weight": pa.array(total)})

    return docs_of.unionAll(parts_of).groupBy("chunk").applyInArrow(add, "chunk long, place long, doc_id long, n_features long, n_words long, weight long")


def resample(docs: DataFrame, target: DataFrame, target_key: str = "item_id", seed: int = 42, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """Per document doc_id, n_features, weight, score (the weight with Gumbel noise from the id) and the rank of those drawn, null for others.

    Of the documents with `least_words` words or more, `percent` of a hundred are drawn, without replacement, in proportion to exp(weight / 1000).
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = stash(weights(docs, target, target_key, buckets).withColumn("score", F.col("weight") + noise), "importance-scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("chunk"), F.col("place")]
    row = F.monotonically_increasing_id()
    cut = able.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("doc_id", "n_features", "weight", "score", F.shiftright(row, 33).alias("at"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    cut = stash(cut, "importance-ranks")
    sizes = cut.groupBy("at").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("at").alias("part"), (F.sum("n").over(Window.orderBy("at")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("i") + 1
    ranked = cut.join(before, F.col("at") == F.col("part")).select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionAll(rest)
