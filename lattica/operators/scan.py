"""Ordered operators over a whole table, without one task for all rows: block-wise prefix scans.

Rows are dealt to ranges of the order, sorted within them and written with the number of their range and their place. Each
range is summarised in one row, a window over these few rows says what comes before each range, and a second pass
goes over the ranges side by side. Rows at one place in the order are ordered by a hash of all their columns, so that a
frequent value is split among ranges as well; nulls come first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.names import fresh
from lattica.sources import scratch


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t])


def ranged(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, str, str]:
    """(df written in order, the names of its columns of range and place)."""
    spark = df.sparkSession
    x = fresh(df)
    tie, part, place = x, f"{x}_part", f"{x}_place"
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    cut = df.withColumn(tie, row_hash(df)).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, F.col(tie)).sortWithinPartitions(*keys, tie)
    row = F.monotonically_increasing_id()
    at = scratch.folder(spark, "ranged")
    cut.drop(tie).withColumns({part: F.shiftright(row, 33), place: row.bitwiseAND(F.lit((1 << 33) - 1))}).write.parquet(at)
    return spark.read.parquet(at), part, place


def _with_summary(rows: DataFrame, summary: DataFrame, part: str) -> DataFrame:
    """Each row beside the summary of its range, of which there is one for each."""
    x = fresh(rows, summary)
    return rows.join(summary.withColumnRenamed(part, x), F.col(part) == F.col(x)).drop(x)


def _local(part: str, place: str):
    return Window.partitionBy(part).orderBy(place)


_PAST = (Window.unboundedPreceding, 0)
_BEFORE = (Window.unboundedPreceding, -1)


def carried(df: DataFrame, order: Sequence[str | Column], value: str, name: str, lead: bool = False) -> DataFrame:
    """df with the last value that is not null up to each row; lead: rows before the first value take the first one."""
    rows, part, place = ranged(df, order)
    x = fresh(rows)
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(place).alias("i"), F.col(value).alias("v")))
    ends = rows.groupBy(part).agg(F.max_by(seen, seen["i"]).alias(f"{x}last"), F.min_by(seen, seen["i"]).alias(f"{x}first"))
    over = Window.orderBy(part)
    ends = ends.select(part, F.last(f"{x}last", True).over(over.rowsBetween(*_BEFORE)).alias(f"{x}before"), F.first(f"{x}first", True).over(over.rowsBetween(0, Window.unboundedFollowing)).alias(f"{x}after"))
    here = rows.withColumn(f"{x}here", F.last(value, True).over(_local(part, place).rowsBetween(*_PAST)))
    filled = [F.col(f"{x}here"), F.col(f"{x}before")["v"]] + ([F.col(f"{x}after")["v"]] if lead else [])
    return _with_summary(here, ends, part).withColumn(name, F.coalesce(*filled)).select(*dict.fromkeys([*df.columns, name]))


def fill_forward(df: DataFrame, order: Sequence[str | Column], value: str) -> DataFrame:
    """The last value up to each row; rows before the first take the first."""
    return carried(df, order, value, value, lead=True)


def runs(df: DataFrame, order: Sequence[str | Column], value: str) -> DataFrame:
    """Runs of equal values over the table: run (from 1), the value, length."""
    named = all(isinstance(c, str) for c in order)
    rows, part, place = ranged(df.select(*dict.fromkeys([*order, value])) if named else df, order)
    x = fresh(rows)
    w = _local(part, place)
    before = F.lag(F.struct(value)).over(w)
    rows = rows.withColumn(f"{x}new", (before.isNotNull() & ~before.eqNullSafe(F.struct(value))).cast("long"))
    own = F.struct(F.col(place).alias("i"), F.struct(value).alias("v"))
    ends = rows.groupBy(part).agg(F.sum(f"{x}new").alias(f"{x}inner"), F.min_by(own["v"], place).alias(f"{x}first"), F.max_by(own["v"], place).alias(f"{x}last"))
    over = Window.orderBy(part)
    previous = F.lag(f"{x}last").over(over)
    ends = ends.withColumn(f"{x}head", (previous.isNull() | ~previous.eqNullSafe(F.col(f"{x}first"))).cast("long"))
    ends = ends.select(part, f"{x}head", F.coalesce(F.sum(F.col(f"{x}inner") + F.col(f"{x}head")).over(over.rowsBetween(*_BEFORE)), F.lit(0)).alias(f"{x}sum"))
    number = F.col(f"{x}sum") + F.col(f"{x}head") + F.col(f"{x}in")
    numbered = _with_summary(rows.withColumn(f"{x}in", F.sum(f"{x}new").over(w.rowsBetween(*_PAST))), ends, part)
    return numbered.groupBy(number.alias("run"), value).agg(F.count(F.lit(1)).alias("length"))


def above_high_water(df: DataFrame, order: Sequence[str | Column], value: str) -> DataFrame:
    """Rows whose value exceeds all before it."""
    rows, part, place = ranged(df, order)
    x = fresh(rows)
    tops = rows.groupBy(part).agg(F.max(value).alias(f"{x}max"))
    tops = tops.select(part, F.max(f"{x}max").over(Window.orderBy(part).rowsBetween(*_BEFORE)).alias(f"{x}before"))
    here = rows.withColumn(f"{x}here", F.max(value).over(_local(part, place).rowsBetween(*_BEFORE)))
    top = F.greatest(f"{x}here", f"{x}before")
    return _with_summary(here, tops, part).where(top.isNull() | (F.col(value) > top)).select(*df.columns)


def take_while(df: DataFrame, order: Sequence[str | Column], condition: Column) -> DataFrame:
    """Rows before the first that fails."""
    rows, part, place = ranged(df, order)
    at = rows.where(~F.coalesce(condition, F.lit(False))).agg(F.min(F.struct(part, place)).alias("at")).first()["at"]
    if at is None:
        return rows.select(*df.columns)
    return rows.where((F.col(part) < at[0]) | ((F.col(part) == at[0]) & (F.col(place) < at[1]))).select(*df.columns)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "id", start: int = 1) -> DataFrame:
    """df with numbers from `start` in the given order."""
    rows, part, place = ranged(df, order)
    x = fresh(rows)
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias(f"{x}n"))
    before = sizes.select(part, (F.sum(f"{x}n").over(Window.orderBy(part)) - F.col(f"{x}n")).alias(f"{x}before"))
    return _with_summary(rows, before, part).withColumn(name, F.col(place) + F.col(f"{x}before") + start).select(*dict.fromkeys([*df.columns, name]))
