"""Paged sources for `spark.read.format("paged")` and `spark.readStream.format("paged")`.

A page is a JSON object: {"rows": [{..}, ..], "next": token or null, "pages": how many there are, if known}. It is got from
  - http(s)://..., with {page} and {start} in the address replaced, or
  - a folder on any file system that pyarrow opens, where page n of a start is <folder>/start=<start>/page=<n>/ (JSON lines in
    its files are the rows, the next page is n + 1 if it is there); without starts <folder>/page=<n>/. `write_pages` makes such folders.

Options of a batch read
  address   as above
  starts    JSON array of starts, a chain of pages for each; without it one chain
  pages     how many pages a chain has; they are then dealt over tasks. Without it a chain is followed, token by token, by one task,
            until there is no next page, an empty page, or `most` rows
  first     the first page or token (0, or the page after a stored offset)
  most      rows of a chain at most
  tasks, tries, wait   tasks for the pages, attempts for a page, seconds before the second (twice, three times .. as many before later ones)
  failures  how many first attempts for each page are refused before it is got, to try retries out (0)

A stream reads one chain: its offset is the next page, pages that have come since are a micro-batch (`batch` of them at most),
dealt over tasks, and a restarted query goes on after the last page that was committed. Pages must not change once they are there.
"""

from __future__ import annotations

import json
import threading
import urllib.parse
import urllib.request
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from lattica.sources.paged import retry
from lattica.streaming.sink import opened


@dataclass
class Chain(InputPartition):
    """Pages first, first + 1, ... last - 1 of a start; all that follow first if last is None."""

    start: str | None
    first: object
    last: int | None
    most: int | None = None


class Endpoint:
    def __init__(self, options: Mapping[str, str]):
        self.address = options["address"].rstrip("/")
        self.tries, self.wait = int(options.get("tries", 5)), float(options.get("wait", 1))
        self.web = self.address.startswith(("http://", "https://"))
        self.failures, self.counted = int(options.get("failures", 0)), 0

    def page(self, start: str | None, page: object) -> dict:
        left = self.failures

        def attempt() -> dict:
            nonlocal left
            if left > 0:
                left -= 1
                raise OSError(f"503: page {page} is refused")
            return self._web(start, page) if self.web else self._folder(start, page)

        return retry(attempt, self.tries, self.wait)

    def _web(self, start: str | None, page: object) -> dict:
        quoted = lambda x: urllib.parse.quote(str(x), safe="")
        with urllib.request.urlopen(self.address.replace("{page}", quoted(page)).replace("{start}", quoted(start)), timeout=60) as r:
            return json.load(r)

    def _at(self, start: str | None, page: object) -> str:
        return ("" if start is None else f"/start={urllib.parse.quote(start, safe=' ')}") + f"/page={page}"

    def _folder(self, start: str | None, page: object) -> dict:
        fs, base = opened(self.address)
        rows = []
        for f in sorted(fs.get_file_info(pafs.FileSelector(base + self._at(start, page), allow_not_found=True)), key=lambda f: f.path):
            if f.base_name.endswith(".json"):
                with fs.open_input_stream(f.path) as x:
                    rows += [json.loads(line) for line in x.readall().splitlines()]
        following = fs.get_file_info(base + self._at(start, int(page) + 1))
        return {"rows": rows, "next": int(page) + 1 if following.type != pafs.FileType.NotFound else None}

    def known(self, after: int) -> int:
        """The number of pages that are there, counted on from `after`, or from where it was counted to before."""
        if self.web:
            return int(self.page(None, after).get("pages", after))
        fs, base = opened(self.address)
        if after > self.counted and fs.get_file_info(base + self._at(None, after)).type == pafs.FileType.NotFound:
            return after
        after = max(after, self.counted)
        while fs.get_file_info(base + self._at(None, after)).type != pafs.FileType.NotFound:
            after += 1
        self.counted = after
        return after


def _rows(endpoint: Endpoint, part: Chain, fields: Sequence[str]) -> Iterator[tuple]:
    at, n = part.first, 0
    while at is not None and (part.last is None or int(at) < part.last):
        got = endpoint.page(part.start, at)
        rows = got["rows"] if part.most is None else got["rows"][: part.most - n]
        n += len(rows)
        yield from (tuple(part.start if f == "start" and f not in r else r.get(f) for f in fields) for r in rows)
        if part.last is not None:
            at = int(at) + 1
        elif not got["rows"] or (part.most is not None and n >= part.most):
            at = None
        else:
            at = got.get("next")


class PagedReader(DataSourceReader):
    def __init__(self, options: Mapping[str, str], schema: StructType):
        self.options, self.fields = dict(options), schema.names

    def partitions(self) -> list[Chain]:
        o = self.options
        starts = json.loads(o["starts"]) if "starts" in o else [None]
        most = int(o["most"]) if "most" in o else None
        first = o.get("first", "0")
        first = int(first) if first.isdigit() else first
        if "pages" not in o:
            return [Chain(s, first, None, most) for s in starts]
        end = int(o["pages"])
        step = max(1, -(-(end - first) * len(starts) // int(o.get("tasks", 8)))) if most is None else max(1, end)
        return [Chain(s, a, min(a + step, end), most) for s in starts for a in range(first, end, step)]

    def read(self, partition: Chain) -> Iterator[tuple]:
        return _rows(Endpoint(self.options), partition, self.fields)


class PagedStream(DataSourceStreamReader):
    def __init__(self, options: Mapping[str, str], schema: StructType):
        self.options, self.fields = dict(options), schema.names
        self.last = int(options.get("first", 0))

    def initialOffset(self) -> dict:
        return {"page": int(self.options.get("first", 0))}

    def latestOffset(self) -> dict:
        known = Endpoint(self.options).known(self.last)
        most = int(self.options.get("batch", 0))
        self.last = min(known, self.last + most) if most else known
        return {"page": self.last}

    def partitions(self, start: dict, end: dict) -> list[Chain]:
        self.last = max(self.last, end["page"])
        a, b = start["page"], end["page"]
        step = max(1, -(-(b - a) // int(self.options.get("tasks", 8))))
        return [Chain(None, i, min(i + step, b)) for i in range(a, b, step)]

    def read(self, partition: Chain) -> Iterator[tuple]:
        return _rows(Endpoint(self.options), partition, self.fields)

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset; pages stay where they are."""


class Paged(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("a paged source needs a schema")

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)

    def streamReader(self, schema: StructType) -> PagedStream:
        return PagedStream(self.options, schema)


def register(spark) -> None:
    spark.dataSource.register(Paged)


def read(spark, address: str, schema: str, **options: object) -> DataFrame:
    register(spark)
    reader = spark.read.format("paged").schema(schema).option("address", address)
    for k, v in options.items():
        reader = reader.option(k, json.dumps(v) if isinstance(v, list) else str(v))
    return reader.load()


def stream(spark, address: str, schema: str, **options: object) -> DataFrame:
    register(spark)
    reader = spark.readStream.format("paged").schema(schema).option("address", address)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def write_pages(df: DataFrame, path: str, page: Column, order: Sequence[str], start: Column | None = None) -> None:
    """Put rows into pages, as a paged endpoint has them: page numbers are given, rows of a page are in order and in one file."""
    by = ["start", "page"] if start is not None else ["page"]
    out = df.withColumn("page", page)
    out = out.withColumn("start", start) if start is not None else out
    out.repartition(*by).sortWithinPartitions(*by, *order).write.mode("append").partitionBy(*by).option("ignoreNullFields", False).json(path)


@contextmanager
def served(path: str, failures: int = 0) -> Iterator[str]:
    """Serve a page folder over HTTP from this process: the address. Each page answers 503 to its first `failures` calls."""
    endpoint, calls, lock = Endpoint({"address": path, "tries": 1}), Counter(), threading.Lock()

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            asked = urllib.parse.parse_qs(urllib.parse.urlsplit(self.path).query)
            start, page = asked.get("start", [None])[0], int(asked["page"][0])
            with lock:
                calls[start, page] += 1
                busy = calls[start, page] <= failures
            body = b"" if busy else json.dumps(endpoint.page(start, page) | ({"pages": endpoint.known(page)} if start is None else {})).encode()
            self.send_response(503 if busy else 200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args: object) -> None:
            """No lines on the console."""

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        yield f"http://127.0.0.1:{server.server_port}/"
    finally:
        server.shutdown()
        server.server_close()
