"""Shared pieces: where intermediate tables go, and word hashing over Arrow text columns.

A batch of texts stays one byte buffer with offsets, so that hashing costs a few
numpy calls a batch and not some for each document.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that are hashed at once; longer documents are taken alone and whole.
CHUNK_BYTES = 1 << 21


#: The temporary folder of local runs, once there is one.
_temporary: list[str] = []


def quoted(name: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free(*frames: DataFrame, start: str = "x") -> str:
    """A name that no column of the frames begins with, in either case."""
    names = [c.lower() for f in frames for c in f.columns]
    name = start
    while any(c.startswith(name) for c in names):
        name += "x"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one set by setCheckpointDir; if both are unset and all runs on this machine (tests), a temporary one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _temporary:
            _temporary.append(tempfile.mkdtemp(prefix="lattica-"))
            atexit.register(shutil.rmtree, _temporary[0], ignore_errors=True)
        at = _temporary[0]
    return at.rstrip("/")


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(docs: DataFrame, most_bytes: int = 1 << 25) -> int:
    """Into how many hash buckets the work on docs is dealt: two for each shuffle partition, and more where the files are so large that a bucket would stand for over most_bytes of them."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size < 1 << 60  # else the source can't tell
    return max(2 * partitions(docs.sparkSession), -(-size // most_bytes) if known else 1)


def arrow_rows(docs: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """mapInArrow with docs' own columns, whatever their names; `each` sees them by position."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(each, plain.schema).toDF(*docs.columns)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (a bijection of 64-bit words)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_pow = np.ones(1, dtype=np.uint64)
_inv = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd base modulo 2**64, and of its inverse."""
    global _pow, _inv
    if len(_pow) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, _BASE, dtype=np.uint64))])
        _inv = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, inverse, dtype=np.uint64))])
    return _pow, _inv


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j]-H[i] = sum over i<=t<j of (byte+1)*base**t; times inverse**i it depends on the bytes alone."""
    p, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * p[: len(buf)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inv = powers(len(h))
    return mix((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Some documents of a batch: rows [first, last) of it, their bytes end to end, and where each begins."""

    first: int
    last: int
    buf: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return self.last - self.first


def flat(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[Texts]:
    """Whole texts of a string column in pieces of about `most` bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=n + 1, offset=column.offset * 8)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        j = min(j, n)
        yield Texts(i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


@dataclass
class Words:
    """The words of some texts: byte spans, hashes, and for each document the range of its words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    ptr: np.ndarray


def words(t: Texts, lower: bool = True, strip: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes other than ASCII space; strip: a mask of bytes that count as spaces as well."""
    buf = _LOWER[t.buf] if lower else t.buf
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e, e, np.zeros(0, np.uint64), np.zeros(len(t) + 1, np.int64))
    gap = (_SPACE if strip is None else strip)[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[t.at] = True
    before = edge[:n].copy()
    before[1:] |= gap[:-1]
    after = edge[1:].copy()
    after[:-1] |= gap[1:]
    start = np.flatnonzero(before & ~gap)
    end = np.flatnonzero(after & ~gap) + 1
    ptr = np.searchsorted(start, t.at)
    return Words(start, end, span_hash(prefix_hash(buf), start, end), ptr)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and the range of each document's; with fewer words the whole sequence is one."""
    count = np.diff(w.ptr)
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    ptr = np.concatenate([[0], np.cumsum(n)])
    if not ptr[-1]:
        return np.zeros(0, np.uint64), ptr
    first = np.repeat(w.ptr[:-1] - ptr[:-1], n) + np.arange(ptr[-1])
    length = np.repeat(np.minimum(count, k), n)
    short = bool((length < k).any())
    h = np.zeros(ptr[-1], np.uint64)
    for j in range(k):
        if short:
            ok = length > j
            h[ok] = mix(h[ok] * _U(0x2545F4914F6CDD1D) + w.hash[first[ok] + j] + _U(j + 1))
        else:
            h = mix(h * _U(0x2545F4914F6CDD1D) + w.hash[first + j] + _U(j + 1))
    return h, ptr


def sets(h: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's hashes sorted and distinct."""
    h = h.copy()
    for i in range(len(ptr) - 1):
        if ptr[i + 1] - ptr[i] > 1:
            h[ptr[i] : ptr[i + 1]].sort()
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = h[1:] != h[:-1]
    first = ptr[:-1][ptr[:-1] < len(h)]
    keep[first] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return h[keep], before[ptr]


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of start[i], start[i]+1, ... (count[i] of them), end to end."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)


def cells(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], names=list(columns))


def by_bucket(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by bucket key % n, and the n+1 bounds: what goes to one bucket is then one slice."""
    bucket = (key % _U(n)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def joined(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """The arrays in a column of binary values, end to end."""
    parts = [np.frombuffer(b, dtype) for b in column.to_pylist() if b]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def segment_sum(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i+1]]; 0 where that is empty."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ptr[1:]] - total[ptr[:-1]]
