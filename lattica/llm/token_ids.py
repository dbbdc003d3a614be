"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of documents in ascending order of doc_id, end to end, each with an
end id, in blocks of `block` ids (a multiple of 8, 256 at most). Of a block the least id is taken off; what is
left is packed into as many bits as a share `quantile` of it needs; the others are exceptions,
whose place and upper bits are listed. An index gives where each block and its exceptions
begin, so that a range of ids is read from the blocks that it touches alone.

Layout, little-endian: MAGIC; uint64 x 8: part, block, ids, documents, blocks, exceptions,
packed bytes, 0; documents: int64 doc_id, uint8 whether it is known, uint64 where it begins (one more than
documents); blocks: uint32 least id, uint8 width, uint64 first packed byte, uint64 first
exception (the last two one more than blocks); exceptions: uint8 place, uint32 upper bits; packed bits.
Spark's text writer stores the files and ends each with a line feed, so they go to any file system that Spark
writes to, and a task that failed or ran twice leaves nothing behind.

Files are parts of a range partitioning by doc_id: what lies in part p precedes part p + 1.
Null texts are empty (the end id alone); null doc_ids come first and stay null; rows of equal doc_id are documents
of their own, in the order of the input, and may lie in two parts; no rows, no files and no result. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import CHUNK_BYTES, Texts, buckets_for, flat, ranges, stash

MAGIC = b"PFORIDS1"
_PIECE = 4096


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def encode(ids: np.ndarray, doc_ids: list, starts: np.ndarray, part: int = 0, block: int = 128, quantile: float = 0.95) -> bytes:
    """A file's bytes: ids of all documents end to end, starts one more than documents; a doc_id may be None."""
    if block % 8 or not 8 <= block <= 256:
        raise ValueError("a block has 8, 16, ... 256 ids")
    n = len(ids)
    blocks = -(-n // block)
    grid = np.full(blocks * block, ids[-1] if n else 0, dtype=np.uint32)
    grid[:n] = ids
    grid = grid.reshape(blocks, block)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    grid -= low[:, None]
    grid.reshape(-1)[n:] = 0
    bits = bit_length(grid)
    width = np.sort(bits, axis=1)[:, max(0, int(np.ceil(quantile * block)) - 1)] if blocks else np.zeros(0, np.uint8)
    at = np.concatenate([[0], np.cumsum(width.astype(np.uint64) * np.uint64(block // 8))]).astype(np.uint64)
    packed = np.zeros(int(at[-1]), dtype=np.uint8)
    for w in np.unique(width[width > 0]):
        same = np.flatnonzero(width == w)
        for i in range(0, len(same), _PIECE):
            rows = same[i : i + _PIECE]
            cut = (grid[rows][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
            packed[at[rows].astype(np.int64)[:, None] + np.arange(int(w) * block // 8)] = np.packbits(cut.astype(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
    row, place = np.nonzero(bits > width[:, None])
    upper = grid[row, place] >> width[row].astype(np.uint32)
    first = np.searchsorted(row, np.arange(blocks + 1)).astype(np.uint64)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    head = np.array([part, block, n, len(doc_ids), blocks, len(row), len(packed), 0], dtype="<u8")
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    sections = (head, names, known, starts.astype("<u8"), low.astype("<u4"), width, at.astype("<u8"), first.astype("<u8"), place.astype(np.uint8), upper.astype("<u4"), packed)
    return b"".join([MAGIC, *[x.tobytes() for x in sections]])


class IdFile:
    """A file's documents and ids; only the blocks that are asked for are unpacked."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("no file of token ids")
        self.at = 8
        self.content = content
        self.part, self.block, self.n_ids, self.n_docs, blocks, exceptions, size, _ = (int(x) for x in self._next("<u8", 8))
        self.doc_id, self.known, self.starts = self._next("<i8", self.n_docs), self._next(np.uint8, self.n_docs), self._next("<u8", self.n_docs + 1).astype(np.int64)
        self.low, self.width, self.bytes_at, self.exceptions_at = self._next("<u4", blocks), self._next(np.uint8, blocks), self._next("<u8", blocks + 1).astype(np.int64), self._next("<u8", blocks + 1).astype(np.int64)
        self.place, self.upper, self.packed = self._next(np.uint8, exceptions), self._next("<u4", exceptions), self._next(np.uint8, size)

    def _next(self, kind: object, n: int) -> np.ndarray:
        out = np.frombuffer(self.content, kind, n, self.at)
        self.at += out.nbytes
        return out

    def ids(self, start: int = 0, end: int | None = None) -> np.ndarray:
        """Ids from place start to end as uint32."""
        end = self.n_ids if end is None else min(end, self.n_ids)
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (end - 1) // self.block + 1
        out = np.zeros((b - a, self.block), dtype=np.uint32)
        width = self.width[a:b]
        for w in np.unique(width[width > 0]):
            same = np.flatnonzero(width == w)
            for i in range(0, len(same), _PIECE):
                rows = same[i : i + _PIECE]
                raw = self.packed[self.bytes_at[a + rows][:, None] + np.arange(int(w) * self.block // 8)]
                cut = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), self.block, int(w))
                value = np.zeros((len(rows), self.block), dtype=np.uint32)
                for k in range(int(w)):
                    value |= cut[:, :, k].astype(np.uint32) << np.uint32(k)
                out[rows] = value
        x, y = int(self.exceptions_at[a]), int(self.exceptions_at[b])
        row = np.repeat(np.arange(b - a), np.diff(self.exceptions_at[a : b + 1]))
        out[row, self.place[x:y]] |= self.upper[x:y] << width[row].astype(np.uint32)
        out += self.low[a:b, None]
        return out.reshape(-1)[start - a * self.block : end - a * self.block]

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the file."""
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


@cache
def _tokenizer(given: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(given), {}


#: Bytes by kind: white space 0, letters 1, digits, apostrophes and what is not ASCII 2, other marks 3.
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[39, *range(48, 58), *range(128, 256)]] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[32, *range(9, 14)]] = 0


def pieces(t: Texts) -> tuple[pa.Array, np.ndarray]:
    """(the texts' pieces in order, the range of each text's): stretches between ASCII white space, cut between a letter and a mark.

    A stretch with `<` or a control character stays whole, as it may hold a special token. Pieces of letters alone are lower-cased.
    """
    kind = _KIND[t.buf]
    solid = kind > 0
    head = solid.copy()  # begins a stretch
    head[1:] &= ~solid[:-1]
    begin = t.at[t.at < len(solid)]
    head[begin] = solid[begin]
    begin = np.concatenate([[0], np.cumsum(solid)])[t.at]
    head, kind, data = head[solid], kind[solid], t.buf[solid]
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    cut[1:] = (kind[1:] ^ kind[:-1]) == 2  # 1 beside 3
    odd = np.flatnonzero((data == 60) | (data < 32) | (data == 127))
    if len(odd):
        stretch = np.cumsum(head)
        whole = np.zeros(stretch[-1] + 1, dtype=bool)
        whole[stretch[odd]] = True
        cut &= ~whole[stretch]
    first = np.flatnonzero(head | cut)
    size = np.diff(np.append(first, n))
    letters = np.maximum.reduceat(kind, first) == 1 if n else np.zeros(0, bool)
    data |= np.repeat(letters.view(np.uint8) << 5, size)
    offsets = np.append(first, n).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data)), np.searchsorted(first, begin)


class Encoder:
    """Ids of texts by a tokenizer of the tokenizers library, given as its JSON.

    by_pieces: the tokenizer lower-cases, drops white space, and joins neither across it nor a letter with another mark than
    an apostrophe. A text's ids are then those of its pieces, and each piece is encoded once: up to `most_known` (of 64 characters at most) are kept
    from batch to batch, the others are encoded anew in each batch that has them.
    """

    def __init__(self, given: str, by_pieces: bool, most_known: int = 400_000):
        self.tokenizer, self.known = _tokenizer(given)
        self.by_pieces, self.most_known = by_pieces, most_known

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, t: Texts, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of each text's)."""
        if not self.by_pieces:
            lists = self._encode(pc.fill_null(texts, "").to_pylist())
            count = np.array([len(x) for x in lists], dtype=np.int64)
            return np.array([i for x in lists for i in x], dtype=np.uint32), count
        every, ptr = pieces(t)
        coded = every.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False)
        found = [*map(self.known.get, distinct)]
        new = [i for i, x in enumerate(found) if x is None]
        for i, x in zip(new, self._encode([distinct[i] for i in new])):
            found[i] = np.array(x, dtype=np.uint32).tobytes()
            if len(self.known) < self.most_known and len(distinct[i]) <= 64:
                self.known[distinct[i]] = found[i]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        pool = np.frombuffer(b"".join(found), dtype=np.uint32)
        which = np.asarray(coded.indices)
        n = size[which]
        before = np.concatenate([[0], np.cumsum(n)])
        return pool[ranges((np.cumsum(size) - size)[which], n)], np.diff(before[ptr])


def write(docs: DataFrame, path: str, tokenizer: str, by_pieces: bool = False, end_id: int = 1, parts: int | None = None, block: int = 128, quantile: float = 0.95) -> None:
    """Tokenize all texts and write the files to path. tokenizer: the driver's path of a file of the tokenizers library."""
    with open(tokenizer, encoding="utf-8") as f:
        given = docs.sparkSession.sparkContext.broadcast(f.read())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(given.value, by_pieces)
        names, parts, counts = [], [], []
        for batch in batches:
            names += batch.column(0).to_pylist()
            for t in flat(batch.column(1), 2 * CHUNK_BYTES):
                ids, count = encoder(t, batch.column(1).slice(t.first, len(t)))
                parts.append(np.insert(ids, np.cumsum(count), end_id))
                counts.append(count + 1)
        if names:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            content = encode(np.concatenate(parts), names, starts, TaskContext.get().partitionId(), block, quantile)
            yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], names=["content"])

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "monotonically_increasing_id() place")
    dealt = slim.repartitionByRange(parts or buckets_for(docs), "doc_id", "place").sortWithinPartitions("doc_id", "place").drop("place")
    dealt.mapInArrow(each, "content binary").select(F.col("content").cast("string").alias("value")).write.option("compression", "none").text(path)


def _read(spark: SparkSession, path: str, each, schema: str) -> DataFrame:
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield each(IdFile(content.as_py()))

    return spark.read.format("binaryFile").load(path).where("length > 8").select("content").mapInArrow(files, schema)


def _documents(f: IdFile) -> pa.Array:
    return pa.array(f.doc_id, mask=f.known == 0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, place, ids): the documents of the files, with their place in the part."""

    def each(f: IdFile) -> pa.RecordBatch:
        ids = pa.LargeListArray.from_arrays(pa.array(f.starts), pa.array(f.ids().astype(np.int64))).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(f.n_docs, f.part)), _documents(f), pa.array(np.arange(f.n_docs)), ids], names=["part", "doc_id", "place", "ids"])

    return _read(spark, path, each, "part long, doc_id long, place long, ids array<long>")


def some(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """As `read` for documents from first to last doc_id; of a file only the blocks that hold them are unpacked."""

    def each(f: IdFile) -> pa.RecordBatch:
        k = np.flatnonzero((f.known == 1) & (f.doc_id >= first) & (f.doc_id <= last))
        ids = pa.array([f.document(i).astype(np.int64) for i in k], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), f.part)), pa.array(f.doc_id[k]), pa.array(k), ids], names=["part", "doc_id", "place", "ids"])

    return _read(spark, path, each, "part long, doc_id long, place long, ids array<long>")


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32 of its ids as little-endian uint32.

    Where parts begin is a sum over one row for each file.
    """

    def each(f: IdFile) -> pa.RecordBatch:
        ids = f.ids().astype("<u4")
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(f.starts[:-1], f.starts[1:])]
        columns = [pa.array(np.full(f.n_docs, f.part)), _documents(f), pa.array(f.starts[:-1]), pa.array(np.diff(f.starts)), pa.array(crc, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])

    rows = stash(_read(spark, path, each, "part long, doc_id long, start long, n_tokens long, ids_crc32 long"), "token-ids-digest")
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = sizes.select(F.col("part").alias("at"), (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return rows.join(before, F.col("part") == F.col("at")).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
