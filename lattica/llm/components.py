"""Connected components of a table of links, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import stash


def _least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): m is the least of u and its neighbours. Minima are aggregated before the shuffle; hot nodes split in the join."""
    least = pairs.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "w"))
    return pairs.join(least, F.col("u") == F.col("w")).drop("w")


def components(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """links (a, b) of longs -> (node, label): label is the least node that is reachable. Nodes without links are not listed."""
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(most_rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, edges = edges, stash(small, "cc")
        # both are distinct: equal counts and no new row mean equal sets
        if edges.count() == before.count() and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label").unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
