"""Mixing: targets of many small sources, the shards' quotas, columns with clashing names."""

import math
from collections import Counter

from pyspark.sql import functions as F

from lattica.llm import source_mix


def test_many_small_sources(spark):
    docs = spark.createDataFrame([(20 * i + j, "w", f"s{i:04d}") for i in range(300) for j in range(20)], "doc_id long, text string, source string")
    got = source_mix.taken(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 300 and all(abs(x.taken - x.target) <= 1 for x in got)


def test_one_document_off_at_most(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i * 7 % 40), f"s{i % 3}" if i % 5 else None) for i in range(900)], "doc_id long, text string, source string")
    got = source_mix.taken(docs, blocks=16).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert len(got) == 4 and all(abs(x.taken - x.target) <= 20 for x in got)


def test_quotas_add_up(spark):
    q = {f"s{i}": 1 + i * i % 50 for i in range(90)}
    units = spark.createDataFrame(list(q.items()), "name string, q long")
    for shards in (1, 5, 16):
        got = source_mix.quotas(units, shards, 3).collect()
        per, by = Counter(), Counter()
        for x in got:
            per[x.shard] += x.q
            by[x["name"]] += x.q
        assert by == q and set(per) == set(range(shards)) and max(per.values()) - min(per.values()) <= 5
    a, b = (source_mix.quotas(units, 4, s).orderBy("shard", "name").collect() for s in (3, 4))
    assert a != b and a == source_mix.quotas(units.repartition(5), 4, 3).orderBy("shard", "name").collect()


def test_draws_are_hypergeometric(spark):
    n = 4000
    x = spark.range(n).select(source_mix.hypergeometric(F.lit(60).cast("bigint"), F.lit(25).cast("bigint"), F.lit(30).cast("bigint"), (F.col("id") + 0.5) / n).alias("k"))
    got = Counter(r.k for r in x.collect())
    for k in range(26):
        assert abs(got[k] / n - math.comb(25, k) * math.comb(35, 30 - k) / math.comb(60, 30)) < 2 / n
    # far from any mode the quantiles stay in range
    x = spark.range(50).select(source_mix.hypergeometric(F.lit(9000).cast("bigint"), F.lit(4000).cast("bigint"), F.lit(4500).cast("bigint"), (F.col("id") + 0.5) / 50).alias("k"))
    assert all(1850 < r.k < 2150 for r in x.collect())


def test_shards_hold_what_is_taken(spark):
    docs = spark.createDataFrame([(i, f"a b {'c ' * (i % 9)}", f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    want = Counter({x.doc_id: x.taken // max(x.size, 1) for x in source_mix.taken(docs).collect() if x.taken})
    rows = source_mix.mixed(docs).collect()
    assert Counter(x.doc_id for x in rows) == want
    held = {x.doc_id: list(x.shards) for x in source_mix.taken(docs).collect()}
    for x in rows:
        assert held[x.doc_id][x.mix_copy] == x.mix_shard


def test_clashing_columns(spark):
    names = ["__size", "__key", "size", "key", "name", "block", "place", "units", "a.b", "c`d", "row", "u", "at", "need", "mix_shard"]
    docs = spark.createDataFrame([(i, f"text {i}", "s", *[f"{n}{i}" for n in names]) for i in range(30)], ["doc_id", "text", "source", *names])
    got = source_mix.mixed(docs)
    assert got.columns == [*docs.columns[:-1], "mix_shard", "mix_copy"]
    for x in got.collect():
        assert all(x[n] == f"{n}{x.doc_id}" for n in names[:-1]) and x.text == f"text {x.doc_id}" and isinstance(x.mix_shard, int)
    assert source_mix.taken(docs).count() == 30


def test_rows_without_id_spread(spark):
    docs = spark.createDataFrame([(None, f"text number {i}", "s" if i % 2 else None) for i in range(200)], "doc_id long, text string, source string")
    got = source_mix.taken(docs)
    assert got.agg(F.sum("taken")).first()[0] == 900 and got.count() == 200
