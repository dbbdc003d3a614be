"""A streaming sink whose rows appear once, whatever is done twice: `writeStream.format("committed")`.

Tasks write files that nobody reads yet and report their names. When all tasks of a micro-batch are done, the driver puts
down one list of the batch's files; readers read listed files alone. A task that was killed or ran twice leaves files that
are on no list; a batch that is done again after its list is there leaves the list as it is.

Options: path (a URI of any file system that pyarrow opens, or a local path that all executors share), fileformat
(parquet, or json for one object a line), rows (most rows of a file), columns (comma-separated: only these, in this order).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamArrowWriter, WriterCommitMessage

LISTS = "_batches"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path within it)."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)
    rows: int = 0


class CommittedWriter(DataSourceStreamArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.kind, self.most = options.get("fileformat", "parquet"), int(options.get("rows", 1_000_000))
        self.columns = [c for c in options.get("columns", "").split(",") if c]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = opened(self.path)
        out, held, n = Written(), [], 0
        fs.create_dir(base, recursive=True)
        for batch in iterator:
            batch = batch.select(self.columns) if self.columns else batch
            while batch.num_rows:
                part = batch.slice(0, self.most - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == self.most:
                    self._flush(fs, base, held, out)
                    held, n = [], 0
        if held:
            self._flush(fs, base, held, out)
        return out

    def _flush(self, fs: pafs.FileSystem, base: str, held: list[pa.RecordBatch], out: Written) -> None:
        table = pa.Table.from_batches(held)
        name = f"part-{uuid.uuid4().hex}.{self.kind}"
        with fs.open_output_stream(f"{base}/{name}") as to:
            if self.kind == "parquet":
                import pyarrow.parquet as pq

                pq.write_table(table, to)
            else:
                for row in table.to_pylist():
                    to.write((json.dumps(row, default=str, ensure_ascii=False) + "\n").encode())
        out.files.append(name)
        out.rows += table.num_rows

    def commit(self, messages: list, batchId: int) -> None:
        fs, base = opened(self.path)
        at = f"{base}/{LISTS}/{batchId}.json"
        files = [f for m in messages if m for f in m.files]
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            self._drop(fs, base, files)
            return
        fs.create_dir(f"{base}/{LISTS}", recursive=True)
        entry = {"batch": batchId, "files": files, "rows": sum(m.rows for m in messages if m)}
        with fs.open_output_stream(f"{at}.new") as to:
            to.write(json.dumps(entry).encode())
        fs.move(f"{at}.new", at)

    def abort(self, messages: list, batchId: int) -> None:
        fs, base = opened(self.path)
        self._drop(fs, base, [f for m in messages if m for f in m.files])

    def _drop(self, fs: pafs.FileSystem, base: str, files: list[str]) -> None:
        for f in files:
            if fs.get_file_info(f"{base}/{f}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{base}/{f}")


class CommittedSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def streamWriter(self, schema, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(dict(self.options))


def start(stream: DataFrame, path: str, checkpoint: str, once: bool = True, **options: object):
    """Write a stream to a committed sink; once: all that is there, then end."""
    spark = stream.sparkSession
    spark.dataSource.register(CommittedSink)
    writer = stream.writeStream.format("committed").option("path", path).option("checkpointLocation", checkpoint)
    for k, v in options.items():
        writer = writer.option(k, str(v))
    return (writer.trigger(availableNow=True) if once else writer).start()


def listed(path: str) -> list[dict]:
    """The batches that are committed, in order."""
    fs, base = opened(path.rstrip("/"))
    found = fs.get_file_info(pafs.FileSelector(f"{base}/{LISTS}", allow_not_found=True))
    out = []
    for x in found:
        if x.path.endswith(".json"):
            with fs.open_input_stream(x.path) as f:
                out.append(json.loads(f.readall()))
    return sorted(out, key=lambda x: x["batch"])


def committed(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """The rows of all committed batches, with the number of their batch."""
    from pyspark.sql import functions as F

    lists = listed(path)
    every = [f"{path.rstrip('/')}/{f}" for x in lists for f in x["files"]]
    if not every:
        return spark.createDataFrame([], f"{schema}, batch long")
    rows = spark.read.schema(schema).format(kind).load(every).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    names = spark.createDataFrame([(f, x["batch"]) for x in lists for f in x["files"]], "name string, batch long")
    return rows.join(names, F.col("file") == F.col("name")).drop("file", "name")
