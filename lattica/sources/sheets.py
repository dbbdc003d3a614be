"""Spreadsheets (.xlsx, .xlsm) as rows: files are spread over tasks, each is read row by row with the standard library."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "file string, row long, cells array<string>"
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_index(letters: str) -> int:
    """A is 0, Z is 25, AA is 26."""
    n = 0
    for c in letters.upper():
        n = 26 * n + ord(c) - 64
    return n - 1


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(_MAIN + "t"))


def read_rows(content: bytes, name: str | None) -> Iterator[tuple[int, list]]:
    """(row number from 1, cells by position) of one sheet: the named one, else the first. Empty cells are None; dates are serial numbers."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [_text(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(_MAIN + "si")]
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall(f"{_MAIN}sheets/{_MAIN}sheet")
        at = next((targets[s.get(_LINK)] for s in sheets if name is None or s.get("name") == name), None)
        if at is None:
            return
        number = 0
        with z.open(at.lstrip("/") if at.startswith("/") else "xl/" + at) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _MAIN + "row":
                    continue
                number = int(row.get("r") or number + 1)
                cells: list = []
                for c in row.findall(_MAIN + "c"):
                    i = column_index(re.match("[A-Za-z]+", c.get("r"))[0]) if c.get("r") else len(cells)
                    cells += [None] * (i + 1 - len(cells))
                    v, kind = c.find(_MAIN + "v"), c.get("t")
                    if kind == "inlineStr":
                        cells[i] = _text(c)
                    elif v is not None and v.text is not None:
                        cells[i] = shared[int(v.text)] if kind == "s" else {"0": "False", "1": "True"}[v.text] if kind == "b" else v.text
                row.clear()
                yield number, cells


def sheet(spark: SparkSession, paths: str | Sequence[str], name: str | None = None, batch: int = 10_000) -> DataFrame:
    """Rows of a sheet of all files at paths (folders and globs too): file name, row number, cells. A file without that sheet has none."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                out = []
                for number, cells in read_rows(content, name):
                    out.append((path.rsplit("/", 1)[-1], number, cells))
                    if len(out) == batch:
                        yield pd.DataFrame(out, columns=["file", "row", "cells"])
                        out = []
                yield pd.DataFrame(out, columns=["file", "row", "cells"])

    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    return files.where(F.lower("path").rlike(r"\.xls[xm]$")).select("path", "content").mapInPandas(each, SCHEMA)


def cell(letter: str):
    return F.get("cells", F.lit(column_index(letter)))


def column(rows: DataFrame, letter: str = "C") -> DataFrame:
    """One column; an empty cell is the text None."""
    return rows.select("file", "row", F.coalesce(cell(letter), F.lit("None")).alias("value"))


def positional(rows: DataFrame, width: int) -> DataFrame:
    """All rows, no header: _c0, _c1, ... as text."""
    return rows.select("file", "row", *[F.get("cells", F.lit(i)).alias(f"_c{i}") for i in range(width)])


def body(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows below the header row, by the given names."""
    return rows.where("row > 1").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def key_values(rows: DataFrame, key: str, value: str, compat: bool = False) -> DataFrame:
    """Each key with the list of its values in order of file and row; rows without key are left out.

    compat: the n-th key of a file goes with the file's n-th row instead, so that a blank key shifts all behind it.
    """
    k = rows.select("file", "row", cell(key).alias("key")).where("key is not null")
    v = rows.select("file", "row", cell(value).alias("value"))
    if compat:
        w = Window.partitionBy("file").orderBy("row")
        k = k.withColumn("row", F.row_number().over(w).cast("bigint"))
        v = v.withColumn("row", F.row_number().over(w).cast("bigint"))
    pairs = k.join(v, ["file", "row"])
    lists = F.transform(F.sort_array(F.collect_list(F.struct("file", "row", "value"))), lambda x: F.coalesce(x["value"], F.lit("None")))
    return pairs.groupBy("key").agg(lists.alias("values"))


_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{name}" sheetId="1" r:id="rId1"/></sheets></workbook>',
}


def book(rows: Sequence[Sequence], name: str = "Sheet1") -> bytes:
    """A workbook of one sheet with the rows as text; None leaves a cell out."""
    letter = lambda i: (letter(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    cells = lambda r, row: "".join(f'<c r="{letter(i)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for i, v in enumerate(row) if v is not None)
    body = "".join(f'<row r="{r}">{cells(r, row)}</row>' for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part, text in _BOOK.items():
            z.writestr(part, text.replace("{name}", escape(name)))
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN[1:-1]}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def books(df: DataFrame, header: Sequence[str], by: str, most: int = 1_000_000) -> DataFrame:
    """(by, part, content): the rows of each value of `by` as workbooks of at most `most` rows (a sheet holds no more), each with the header.

    Write them with media.write_files. A later run's rows are further parts: a sheet is not opened again.
    """
    order = Window.partitionBy(by).orderBy(*header)
    dealt = df.withColumn("part", ((F.row_number().over(order) - 1) / most).cast("int"))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(header))
        cells = [[None if pd.isna(v) else v for v in row] for row in rows[list(header)].astype(object).values.tolist()]
        return pd.DataFrame([(str(key[0]), int(key[1]), book([list(header), *cells]))], columns=["by", "part", "content"])

    return dealt.groupBy(by, "part").applyInPandas(one, "by string, part int, content binary")
