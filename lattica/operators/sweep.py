"""Joins of values with closed ranges, first range by position, of any width and number.

The ends of all ranges, numbered in order, cut the line into points and gaps. Over the numbers a range is a least-value update of an
interval; an interval is two overlapping stretches of a power of two, so that all updates of a length meet in one
table, and lengths are passed down by halves: first over blocks of 2**16 numbers, then within each block. That gives each
point and gap its first range. Rows then take the last end up to their value by a prefix scan, and so the range.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators import scan
from lattica.operators.names import fresh

BLOCK = 1 << 16
_NONE = np.iinfo(np.int64).max


def passed_down(size: int, level: np.ndarray, start: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value over each of `size` places, of updates that cover 2**level places from start."""
    now = np.full(size, _NONE)
    for k in range(int(level.max(initial=0)), -1, -1):
        if k < int(level.max(initial=0)):
            half = 1 << k
            right = np.full(size, _NONE)
            right[half:] = now[:-half] if half < size else now[:0]
            now = np.minimum(now, right)
        mine = level == k
        np.minimum.at(now, start[mine], value[mine])
    return now


def _stretches(low: Column, high: Column) -> Column:
    """Two (level, start) that together cover low to high."""
    power = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    level = F.floor(F.log2((high - low + 1).cast("double")) + 1e-12).cast("int")
    level = F.when(power(level) > high - low + 1, level - 1).otherwise(level)
    return F.array(F.struct(level.alias("level"), low.alias("start")), F.struct(level.alias("level"), (high - power(level) + 1).alias("start")))


def _updates(pieces: DataFrame) -> DataFrame:
    """Least priority of each (block, level, start), from (block, low, high, priority)."""
    cut = pieces.select("block", F.explode(_stretches(F.col("low"), F.col("high"))).alias("s"), "priority")
    return cut.groupBy("block", "s.level", "s.start").agg(F.min("priority").alias("priority"))


def winners(intervals: DataFrame) -> DataFrame:
    """(place, priority): the least priority of the intervals (low, high, priority) over each place that has one.

    What covers whole blocks is settled on the driver, from at most one row for each block and level.
    """
    spark = intervals.sparkSession
    a, b = F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK)
    x = intervals.select("low", "high", "priority", a.alias("a"), b.alias("b"))
    within = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("block"), F.col("low").alias("low"), F.col("high").alias("high")))).otherwise(
        F.array(F.struct(F.col("a").alias("block"), F.col("low").alias("low"), ((F.col("a") + 1) * BLOCK - 1).alias("high")), F.struct(F.col("b").alias("block"), (F.col("b") * BLOCK).alias("low"), F.col("high").alias("high"))))
    parts = x.select(F.explode(within).alias("p"), "priority").select("p.block", (F.col("p.low") - F.col("p.block") * BLOCK).alias("low"), (F.col("p.high") - F.col("p.block") * BLOCK).alias("high"), "priority")
    whole = _updates(x.where("b > a + 1").select(F.lit(0).cast("bigint").alias("block"), (F.col("a") + 1).alias("low"), (F.col("b") - 1).alias("high"), "priority")).toArrow()
    updates = _updates(parts)
    if whole.num_rows:
        level, start, value = (whole[c].to_numpy().astype(np.int64) for c in ("level", "start", "priority"))
        least = passed_down(int((start + (1 << level)).max()), level, start, value)
        at = np.flatnonzero(least < _NONE)
        covers = spark.createDataFrame(pa.table({"block": at, "level": np.full(len(at), BLOCK.bit_length() - 1, np.int32), "start": np.zeros(len(at), np.int64), "priority": least[at]}))
        updates = updates.unionByName(covers)

    def settle(key: tuple, table: pa.Table) -> pa.Table:
        least = passed_down(BLOCK, *(table[c].to_numpy().astype(np.int64) for c in ("level", "start", "priority")))
        at = np.flatnonzero(least < _NONE)
        return pa.table({"place": at + key[0].as_py() * BLOCK, "priority": least[at]})

    return updates.groupBy("block").applyInArrow(settle, "place long, priority long")


def band_join(df: DataFrame, value: str, tiers: DataFrame, low: str, high: str, position: str) -> DataFrame:
    """Each row with the first tier (by position) that has low <= value <= high; rows without one are left out, as are tiers without an end."""
    x = fresh(df, tiers)
    known = scan.numbered(tiers.where(F.col(low) <= F.col(high)), [position], f"{x}p")
    kind = dict(tiers.dtypes)[low]
    ends = scan.numbered(known.select(F.col(low).alias("e")).unionAll(known.select(F.col(high).cast(kind))).distinct(), ["e"], "i", start=0)
    near = lambda n: ends.select(F.col("e").alias(f"{n}e"), (2 * F.col("i")).alias(n))
    placed = known.join(near(f"{x}a"), F.col(low) == F.col(f"{x}ae")).join(near(f"{x}b"), F.col(high) == F.col(f"{x}be"))
    intervals = placed.select(F.col(f"{x}a").alias("low"), F.col(f"{x}b").alias("high"), F.col(f"{x}p").alias("priority"))
    best = winners(intervals).withColumn("i", F.floor(F.col("place") / 2))
    best = best.groupBy("i").agg(F.max(F.when(F.col("place") % 2 == 0, F.col("priority"))).alias("at"), F.max(F.when(F.col("place") % 2 == 1, F.col("priority"))).alias("after"))
    # ends where nothing begins to hold end what was before
    steps = ends.join(best, "i", "left").select(F.col("e").alias(f"{x}v"), F.lit(0).alias(f"{x}k"), F.struct("e", "at", "after").alias(f"{x}s"))
    rows = df.where(F.col(value).isNotNull()).withColumns({f"{x}v": F.col(value), f"{x}k": F.lit(1), f"{x}s": F.lit(None).cast(dict(steps.dtypes)[f"{x}s"])})
    both = rows.unionByName(steps, allowMissingColumns=True)
    s = F.col(f"{x}f")
    hit = scan.carried(both, [f"{x}v", f"{x}k"], f"{x}s", f"{x}f").where(F.col(f"{x}k") == 1)
    hit = hit.withColumn(f"{x}w", F.when(F.col(f"{x}v") == s["e"], s["at"]).otherwise(s["after"])).where(F.col(f"{x}w").isNotNull())
    return hit.join(known, F.col(f"{x}w") == F.col(f"{x}p")).select(*[hit[c] for c in df.columns], *[known[c] for c in tiers.columns])
