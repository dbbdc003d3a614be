"""WARC fixity: Merkle trees over records and ordered offset ranges.

Records lie in archive files of `per_file` consecutive page ids, ordered by id. A
leaf is the SHA-256 of a record's bytes; a node hashes the hashes of up to `fanout`
children in order and spans their offset range; file roots are joined likewise up to
one root. An audit compares two replicas' roots and goes down into branches that
differ, so that only these are read at the lower levels.

Null urls and bodies count as empty, a null page_id as file and id -1; records with
equal ids are ordered by hash; an empty archive has no root and an audit against one
reports every record. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import stash

#: What a gzip member begins with.
_GZIP = b"\x1f\x8b\x08"


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a resource record, as text."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id, F.lit(-1)).cast("string"), F.lit(">\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, per_file: int = 1024) -> DataFrame:
    """Per record: file, idx within it, byte range, hash."""
    r = record(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    page = F.coalesce(F.col("page_id").cast("bigint"), F.lit(-1))
    x = pages.select(page.alias("page_id"), F.floor(page / per_file).alias("file"), F.octet_length(r).cast("bigint").alias("size"), F.sha2(r.cast("binary"), 256).alias("hash"))
    order = Window.partitionBy("file").orderBy("page_id", "hash")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return x.select("file", (F.row_number().over(order) - 1).cast("bigint").alias("idx"), "page_id", (end - F.col("size")).alias("start"), end.alias("end"), "hash")


def _above(nodes: DataFrame, keys: list[Column], idx: str) -> DataFrame:
    """One level up: children in order of idx, at most fanout of them in a group."""
    kids = F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), "hash", "start", "end")))
    g = nodes.groupBy(*keys).agg(kids.alias("k"))
    text = F.array_join(F.transform("k", lambda c: F.concat_ws(":", c["start"].cast("string"), c["end"].cast("string"), c["hash"])), "|")
    return g.select(*[c for c in g.columns if c != "k"], F.element_at("k", 1)["start"].alias("start"), F.element_at("k", -1)["end"].alias("end"), F.sha2(text.cast("binary"), 256).alias("hash"))


def _raise(nodes: DataFrame, fanout: int, name: str) -> DataFrame:
    up = nodes.withColumn("up", F.floor(F.col("idx") / fanout))
    return stash(_above(up, [F.col("file"), F.col("up")], "idx").withColumnRenamed("up", "idx"), name)


def tree(pages: DataFrame, per_file: int = 1024, fanout: int = 16, name: str = "warc") -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels within the files, from the leaves to one root a file; levels over the files, from those roots to one).

    A level is a written table (file, idx, start, end, hash), smaller than the last by
    the fanout. Over the files, file is -2 and idx the group of files.
    """
    inner = [stash(leaves(pages, per_file), name)]
    widest = inner[0].agg(F.max("idx")).first()[0]
    while widest:
        inner.append(_raise(inner[-1], fanout, name))
        widest //= fanout
    number = F.when(F.col("file") >= 0, 2 * F.col("file")).otherwise(-2 * F.col("file") - 1)  # negative ids have files too
    outer = [inner[-1].select(F.lit(-2).cast("bigint").alias("file"), number.alias("idx"), "start", "end", "hash")]
    while outer[-1].limit(2).count() > 1:
        outer.append(_raise(outer[-1], fanout, name))
    return inner, outer


def _differ(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select(*[F.col(c).alias(f"o_{c}") for c in ("file", "idx", "hash")])
    both = a.select("file", "idx", "hash").join(b, (F.col("file") == F.col("o_file")) & (F.col("idx") == F.col("o_idx")), "full_outer")
    return both.where(~F.col("hash").eqNullSafe(F.col("o_hash"))).select(F.coalesce("file", "o_file").alias("file"), F.coalesce("idx", "o_idx").alias("idx"))


def _below(level: DataFrame, bad: DataFrame, fanout: int) -> DataFrame:
    up = bad.select(F.col("file").alias("up_file"), F.col("idx").alias("up"))
    return level.join(up, (F.col("file") == F.col("up_file")) & (F.floor(F.col("idx") / fanout) == F.col("up")), "left_semi")


def audit(one: DataFrame, two: DataFrame, per_file: int = 1024, fanout: int = 16) -> DataFrame:
    """Records of two replicas (tables of pages) that differ: page_id, file_id, offsets and hashes on both sides, status.

    From the root down, only children of nodes that differ are read. Under the last of
    them records are compared by id (where ids repeat, by id and rank of the hash), so
    that a lost record does not make all that follow it differ. Trees of different
    height are compared from the files, or the leaves, that both have.
    """
    (in_a, out_a), (in_b, out_b) = tree(one, per_file, fanout, "warc-a"), tree(two, per_file, fanout, "warc-b")
    bad = None
    for k in reversed(range(len(out_a) if len(out_a) == len(out_b) else 1)):
        pair = [x[k] if bad is None else _below(x[k], bad, fanout) for x in (out_a, out_b)]
        bad = stash(_differ(*pair), "warc-bad")
    file = F.when(F.col("idx") % 2 == 0, F.floor(F.col("idx") / 2)).otherwise(-F.floor((F.col("idx") + 1) / 2))
    files = bad.select(file.alias("f"))
    pair = [x[0].join(files, F.col("file") == F.col("f"), "left_semi") for x in (in_a, in_b)]
    if len(in_a) == len(in_b) and len(in_a) > 1:
        bad = bad.select(file.alias("file"), F.lit(0).cast("bigint").alias("idx"))
        for k in reversed(range(len(in_a) - 1)):
            pair = [_below(x[k], bad, fanout) for x in (in_a, in_b)]
            bad = stash(_differ(*pair), "warc-bad") if k else bad
    rank = Window.partitionBy("file", "page_id").orderBy("hash")
    x, y = (z.withColumn("rank", F.row_number().over(rank)) for z in pair)
    y = y.select(*[F.col(c).alias(f"o_{c}") for c in ("file", "page_id", "rank", "start", "end", "hash")])
    both = x.join(y, (F.col("file") == F.col("o_file")) & (F.col("page_id") == F.col("o_page_id")) & (F.col("rank") == F.col("o_rank")), "full_outer").where(~F.col("hash").eqNullSafe(F.col("o_hash")))
    status = F.when(F.col("o_hash").isNull(), "missing").when(F.col("hash").isNull(), "added").otherwise("corrupt")
    return both.select(F.coalesce("page_id", "o_page_id").alias("page_id"), F.coalesce("file", "o_file").alias("file_id"), "start", "end", F.col("hash").alias("sha256"), F.col("o_hash").alias("replica_sha256"), status.alias("status"))


def archives(pages: DataFrame, per_file: int = 1024) -> DataFrame:
    """(file, content): the bytes of each archive file; a file is bounded by per_file records."""
    r = record(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    x = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(-1)).alias("page_id"), r.alias("r")).withColumn("file", F.floor(F.col("page_id") / per_file))
    parts = F.sort_array(F.collect_list(F.struct("page_id", F.sha2(F.col("r").cast("binary"), 256).alias("h"), "r")))
    return x.groupBy("file").agg(F.array_join(F.transform(parts, lambda p: p["r"]), "").cast("binary").alias("content"))


Record = tuple[int, int, dict[str, str] | None, bytes]


def _plain_records(content: bytes) -> Iterator[Record]:
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at) if content[at : at + 5] == b"WARC/" else -1
        headers: dict[str, str] = {}
        if head >= 0:
            lines = content[at:head].decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = headers.get("content-length", "0")
        end = head + 4 + int(size) + 4 if head >= 0 and size.isdecimal() and len(size) < 19 else -1
        if 0 <= end <= len(content) and content[end - 4 : end] == b"\r\n\r\n":
            yield at, end, headers, content[head + 4 : end - 4]
        else:
            end = content.find(b"WARC/1", at + 1)
            end = end if end >= 0 else len(content)
            yield at, end, None, content[at:end]
        at = end


def inflated(content: bytes, at: int, step: int = 1 << 16) -> tuple[int, bytes] | None:
    """(end, data) of the gzip member that begins at `at`; None if it is damaged or cut off."""
    z, out, fed = zlib.decompressobj(31), [], at
    try:
        while not z.eof and fed < len(content):
            out.append(z.decompress(content[fed : fed + step]))
            fed = min(fed + step, len(content))
        return (fed - len(z.unused_data), b"".join(out)) if z.eof else None
    except zlib.error:
        return None


def split_records(content: bytes) -> Iterator[Record]:
    """(start, end, headers, body) of the records of one file, gzipped member by member or not. Places are those in the file.

    A range that is no whole record has headers None and its own bytes as body: up to the next record, or the next
    member that is whole, or the end. Of a member with several records each has the range of the member.
    """
    if content[:3] != _GZIP:
        yield from _plain_records(content)
        return
    at = 0
    while at < len(content):
        got = inflated(content, at) if content.startswith(_GZIP, at) else None
        if got is not None:
            end, data = got
            for _, _, headers, body in _plain_records(data):
                yield at, end, headers, body if headers is not None else content[at:end]
        else:
            end = content.find(_GZIP, at + 1)
            while end >= 0 and inflated(content, end) is None:
                end = content.find(_GZIP, end + 1)
            end = end if end >= 0 else len(content)
            yield at, end, None, content[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files below path: file, start, end, record_id, url, body; ranges that are no whole records are `damaged`. A file is one row of Spark's binary files, so it has 2 GB at most."""
    schema = "path string, start long, end long, record_id string, url string, body binary, damaged boolean"

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                rows = [(name, s, e, (h or {}).get("warc-record-id"), (h or {}).get("warc-target-uri"), body, h is None) for s, e, h, body in split_records(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "start", "end", "record_id", "url", "body", "damaged"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(each, schema)
