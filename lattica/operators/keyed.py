"""Row numbers without one task for all rows, samples by quota, lookups and joins by text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.automaton import containing  # noqa: F401
from lattica.operators.names import fresh
from lattica.operators.scan import numbered  # noqa: F401


def quota_sample(df: DataFrame, groups: Column, quota: int, seed: int, key: str) -> DataFrame:
    """At most `quota` rows of each group, those of least hash of key: a random choice that reruns repeat."""
    n, w = fresh(df), Window.partitionBy(groups).orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key))
    return df.withColumn(n, F.row_number().over(w)).where(F.col(n) <= quota).drop(n)


def get_or(df: DataFrame, table: DataFrame, key: str, value: str, default: object = None) -> DataFrame:
    """The table's value for each row's key, or the default."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def rehashed(df: DataFrame, key: str, hashed: Column, capacity: int) -> DataFrame:
    """df with the bucket of each key in a table of the next prime size from `capacity` on."""
    n = max(capacity, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return df.withColumn("bucket", F.pmod(hashed, F.lit(n)).cast("int"))


def sorted_modes(df: DataFrame, by: str, order: Sequence[str], value: str) -> DataFrame:
    """Of each group the values of the longest runs in order, with their length; on sorted values these are the modes."""
    x, w = fresh(df), Window.partitionBy(by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    n = df.withColumn(f"{x}new", new).withColumn(f"{x}run", F.sum(f"{x}new").over(w)).groupBy(by, f"{x}run", value).agg(F.count(F.lit(1)).alias("frequency"))
    return n.withColumn(x, F.max("frequency").over(Window.partitionBy(by))).where(F.col("frequency") == F.col(x)).select(by, value, "frequency").distinct()
