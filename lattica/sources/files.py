"""Scans and sinks of plain files, all through Spark's readers and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one array of objects; absent keys are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_json(spark: SparkSession, path: str, value: str) -> DataFrame:
    """A file that maps names to objects: (key, value columns)."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>"))).select("key", "value.*")


def delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """No header, no quotes; empty fields stay empty strings."""
    names = StructType.fromDDL(schema).names
    parts = F.split(F.trim("value"), ",")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def words(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("word")).where("word <> ''")


def config(spark: SparkSession, path: str) -> DataFrame:
    """`key : value` lines; what follows a second colon is dropped."""
    p = F.split("value", ":")
    return spark.read.text(path).where("value like '%:%'").select(F.trim(F.get(p, F.lit(0))).alias("key"), F.trim(F.get(p, F.lit(1))).alias("value"))


def seen(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Values of an earlier output's column; none if it isn't there."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # a missing path is an empty one
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{column} string")
    return old.select(column).distinct() if column in old.columns else spark.createDataFrame([], f"{column} string")


def links(pages: DataFrame, html: str = "html") -> DataFrame:
    """Targets of a page's links, in order."""
    return pages.withColumn("links", F.regexp_extract_all(F.col(html), F.lit(r'href="([^"]*)"'), 1))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_sharded(df: DataFrame, path: str, shards: int) -> None:
    """Rows dealt round by round."""
    df.repartition(shards).write.mode("overwrite").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all, columns as they appear first; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def by_id(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row with that key; running it fails if there is none."""
    found = df.where(F.col(key) == F.lit(value)).limit(1)
    # one row whatever was found, so that a missing one is noticed
    n = found.agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(c) for c in df.columns])
    ok = F.when(F.col("__n") == 1, F.col(key)).otherwise(F.raise_error(F.lit(f"no {key} {value}")).cast(dict(df.dtypes)[key]))
    return n.withColumn(key, ok).select(*df.columns)


def json_keys(df: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """One key of each object in a column of JSON arrays."""
    return df.withColumn(name, F.transform(F.from_json(column, f"array<struct<{key}:string>>"), lambda x: x[key]))


def random_pick(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """One file of a folder by the seed: (path)."""
    files = spark.read.format("binaryFile").load(path).select("path")
    return files.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(1)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate(df: DataFrame, path: str) -> None:
    """Leave an empty table of df's columns."""
    df.limit(0).write.mode("overwrite").parquet(path)


def append_log(df: DataFrame, path: str, line: str) -> None:
    """Lines of text, added to those before."""
    df.select(F.col(line).cast("string").alias("value")).write.mode("append").text(path)


def append_projections(df: DataFrame, full: str, least: str, columns: Sequence[str]) -> None:
    """All columns to one place and some to another; null, false, 0 and blank are written as blank."""
    blank = lambda c: F.coalesce(F.when(F.col(c).cast("string").isin("0", "0.0", "false"), "").otherwise(F.col(c).cast("string")), F.lit(""))
    out = df.select(*[blank(c).alias(c) for c in df.columns])
    append(out, full)
    append(out.select(*columns), least)


def upsert_json(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of the same key; a null key counts as blank."""
    named = lambda df: df.withColumn(key, F.coalesce(F.col(key), F.lit("")))
    return named(old).join(named(new).select(key), key, "left_anti").unionByName(named(new), allowMissingColumns=True)


def wide(pairs: DataFrame, row: str, key: str, value: str, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of (row, key, value) with a column for each of the keys, in their order; the last value of a key by `order` counts, the greatest without one."""
    return pairs.groupBy(row).pivot(key, list(keys)).agg(F.max_by(value, order) if order else F.max(value))


def first_seen(pairs: DataFrame, row: str, key: str) -> list[str]:
    """Keys in the order of the rows in which they come first: the header of a file whose columns appear on first sight."""
    return [r[0] for r in pairs.groupBy(key).agg(F.min(row).alias("at")).orderBy("at", key).select(key).collect()]
