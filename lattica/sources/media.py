"""Images and mailboxes from files, with the standard library; in Arrow batches, spread over tasks."""

from __future__ import annotations

import email
import email.policy
import email.utils
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.streaming.sink import opened

_HEAD = b"\x89PNG\r\n\x1a\n"
_GRAY = T.ArrayType(T.ArrayType(T.IntegerType()))
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def encode(image: np.ndarray) -> bytes:
    """A gray (h, w) or colour (h, w, 3) image of bytes as PNG."""
    h, w = image.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, -1)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return _HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes | None) -> np.ndarray | None:
    """PNG (8 bits, not interlaced, no palette) and binary PGM or PPM as (h, w) or (h, w, channels); null for all else."""
    if not data:
        return None
    if m := re.match(rb"P([56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data):
        c, w, h = 1 if m[1] == b"5" else 3, int(m[2]), int(m[3])
        body = np.frombuffer(data, np.uint8, offset=m.end())
        return None if len(body) < h * w * c else body[: h * w * c].reshape((h, w) if c == 1 else (h, w, c))
    if data[:8] != _HEAD:
        return None
    at, packed, head = 8, b"", None
    while at + 8 <= len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6]:
        return None
    w, h, c = head[0], head[1], _CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * c)
    out = np.zeros((h + 1, w * c + c), dtype=np.int32)  # a line above and a pixel to the left of zeros
    for y in range(h):
        kind, line, up, row = raw[y, 0], raw[y, 1:].astype(np.int32), out[y], out[y + 1]
        if kind in (0, 2):
            row[c:] = (line + (up[c:] if kind else 0)) & 255
            continue
        for i in range(w * c):
            a, b, d = row[i], up[i + c], up[i]
            p = a + b - d
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - d) else b if abs(p - b) <= abs(p - d) else d
            row[i + c] = (line[i] + (a if kind == 1 else (a + b) // 2 if kind == 3 else paeth)) & 255
    image = out[1:, c:].astype(np.uint8).reshape(h, w, c)
    return image[:, :, 0] if c == 1 else image


def gray(image: np.ndarray) -> np.ndarray:
    """Colour as luma; an alpha channel is dropped."""
    if image.ndim == 2:
        return image
    c = image[:, :, : 1 if image.shape[2] == 2 else 3]
    return c[:, :, 0] if c.shape[2] == 1 else np.rint(c @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


@F.pandas_udf(_GRAY)
def pixels(content: pd.Series) -> pd.Series:
    """Gray pixels of an encoded image; null if it can't be read."""
    return content.map(lambda b: None if (x := decode(b)) is None else gray(x).astype("int32").tolist())


@F.pandas_udf(T.ArrayType(_GRAY))
def colours(content: pd.Series) -> pd.Series:
    """Red, green and blue of each pixel."""

    def one(b):
        x = decode(b)
        if x is None:
            return None
        x = x[:, :, None] if x.ndim == 2 else x
        return (np.repeat(x[:, :, :1], 3, axis=2) if x.shape[2] < 3 else x[:, :, :3]).astype("int32").tolist()

    return content.map(one)


@F.pandas_udf(T.BinaryType())
def png(image: pd.Series) -> pd.Series:
    """Rows of gray pixels as PNG; null and empty images are null."""
    return image.map(lambda rows: None if rows is None or not len(rows) else encode(np.array([list(r) for r in rows]).astype(np.uint8)))


def text_png(lines: Column, line_height: int, width: int = 64) -> Column:
    """A page with a bar for each character where a line has no blank: the layout of the lines, not their letters."""

    @F.pandas_udf("binary")
    def draw(pages: pd.Series) -> pd.Series:
        def one(page):
            image = np.full((max(1, len(page)) * line_height, width), 255, dtype=np.uint8)
            for i, line in enumerate(page):
                on = [j for j, c in enumerate(line[:width]) if c != " "]
                image[i * line_height + 1 : (i + 1) * line_height - 1, on] = 0
            return encode(image)

        return pages.map(lambda p: None if p is None else one(p))

    return draw(lines)


def images(spark: SparkSession, path: str, mode: str = "L") -> DataFrame:
    """(path, image) of the images at path: L gray, RGB colour; files that can't be read have a null image."""
    return spark.read.format("binaryFile").load(path).select("path", (pixels if mode == "L" else colours)("content").alias("image"))


def write_files(df: DataFrame, folder: str, name: str, content: str) -> None:
    """One file for each row, in a folder of any file system that pyarrow opens; a file appears whole, and one that is written again is replaced."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = opened(folder)
        fs.create_dir(base, recursive=True)
        for b in batches:
            for n, c in zip(b[name], b[content]):
                part = f"{base}/.{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as f:
                    f.write(c)
                fs.move(part, f"{base}/{n}")
            yield b[[name]]

    df.select(name, content).mapInPandas(put, f"{name} string").write.format("noop").mode("overwrite").save()


MESSAGE = "message_id string, thread_id string, sent timestamp, sender string, subject string, body string, attachments array<string>"
#: Messages that are parsed at once.
MESSAGES = 500


def _message(raw: bytes) -> tuple:
    m = email.message_from_bytes(raw, policy=email.policy.default)
    first = (m["References"] or m["In-Reply-To"] or m["Message-ID"] or "").split()
    try:
        sent = email.utils.parsedate_to_datetime(m["Date"]).replace(tzinfo=None) if m["Date"] else None
    except ValueError:
        sent = None
    body = m.get_body(("plain", "html"))
    return (m["Message-ID"], first[0] if first else None, sent, m["From"], m["Subject"], body.get_content().rstrip("\n") if body else "", [a.get_filename() or "" for a in m.iter_attachments()])


def mailbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mbox files, a row each; a thread goes by its first message. Files are read in splits, message by message; what stands before a file's first From line is none."""
    names = [x.split()[0] for x in MESSAGE.split(", ")]

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = None
        for whole in frames:
            for frame in (whole.iloc[i : i + MESSAGES] for i in range(0, len(whole), MESSAGES)):
                found = []
                for raw, file, start in zip(frame["raw"], frame["file"], frame["start"]):
                    # records are cut at From lines, so only a file's first one still has its From, or is no message
                    first, seen = start == 0 and file != seen, file
                    if not first or raw.startswith(b"From "):
                        text = raw.partition(b"\n")[2]
                        found.append(_message(re.sub(rb"(?m)^>(>*From )", rb"\1", text if text.endswith(b"\n") else text + b"\n")))
                yield pd.DataFrame(found, columns=names)

    records = spark.read.option("lineSep", "\nFrom ").text(path)
    return records.select(F.col("value").cast("binary").alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")).mapInPandas(each, MESSAGE)


def threads(messages: DataFrame) -> DataFrame:
    """Threads with their messages, the newest first."""
    lists = F.sort_array(F.collect_list(F.struct("sent", "message_id", "sender", "subject")), False)
    return messages.groupBy("thread_id").agg(F.max("sent").alias("newest"), lists.alias("messages"))
