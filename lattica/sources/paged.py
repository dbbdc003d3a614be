"""Paged scans. A fetch function gives the rows of a page; it runs in tasks, with retries, so it must be safe to repeat."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def retry(call: Callable, tries: int = 5, wait: float = 1.0):
    """call(), again after wait, 2 wait, ... while it fails; the last failure is raised."""
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if n == tries:
                raise
            time.sleep(wait * n)


def _frame(rows: Sequence[tuple], names: Sequence[str]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=list(names))


def numbered(spark: SparkSession, pages: int | None, fetch: Callable[[int], Sequence[tuple]], schema: str, tasks: int | None = None, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """Pages 1 to `pages`, dealt over tasks; an unknown number of pages is 1."""
    names = StructType.fromDDL(schema).names

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for page in frame["id"]:
                yield _frame(retry(lambda p=int(page): fetch(p), tries, wait), names)

    n = pages or 1
    return spark.range(1, n + 1, 1, min(n, tasks or spark.sparkContext.defaultParallelism)).mapInPandas(each, schema)


def followed(spark: SparkSession, starts: Sequence[str], fetch: Callable[[str, object], tuple[Sequence[tuple], object]], schema: str, most: int | None = None, tries: int = 5, wait: float = 1.0) -> DataFrame:
    """From each start one page after the other: fetch(start, token) gives rows and the next token, None at the end.

    One task for each start. most: no page is fetched once a start has that many rows; an empty page ends it too.
    """
    names = StructType.fromDDL(schema).names

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in frame["start"]:
                token, n = None, 0
                while True:
                    rows, token = retry(lambda s=start, t=token: fetch(s, t), tries, wait)
                    rows = rows if most is None else rows[: most - n]
                    n += len(rows)
                    yield _frame(rows, names)
                    if token is None or (most is not None and (n >= most or not rows)):
                        break

    given = spark.createDataFrame([(s,) for s in starts], "start string")
    return given.repartition(max(1, len(starts))).mapInPandas(each, schema)


def linked(pages: DataFrame, first: object, page: str, after: str, depth: int = 10_000) -> DataFrame:
    """Rows of a table of pages that are reached from the first one, with their position; a missing next page ends it."""
    spark = pages.sparkSession
    view = f"lattica_pages_{abs(hash((id(pages), page, after)))}"
    pages.createOrReplaceTempView(view)
    walk = f"""with recursive walk(at, nxt, position) max recursion level {depth} as (
        select {page}, {after}, 0 from {view} where {page} = :first
        union all select p.{page}, p.{after}, w.position + 1 from walk w join {view} p on p.{page} = w.nxt)
        select at, position from walk"""
    try:
        return pages.join(spark.sql(walk, args={"first": first}), F.col(page) == F.col("at")).drop("at")
    finally:
        spark.catalog.dropTempView(view)
