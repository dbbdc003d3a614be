"""Mixing sources to target weights: a splitting tree over block quotas, in DataFrame operations only.

A source's rows fall into blocks by hash. Its target is met by whole passes over its
blocks and, for what is left, by blocks in permuted order. Of the block that crosses
the target, whole documents go in, in permuted order, while they fit; of the ten about
that place those go in that come nearest to the target: no document is cut. A block
taken once is a unit.

The tree deals units to output shards: at a node the left half gets a number of units
of each source that is a multivariate-hypergeometric draw (sources in turn, from groups
of them first), so that the quotas of the shards add up to the units exactly. Each shard
then takes its quota of a source as the next units of the source's permutation. Within a
shard, rows are shuffled by hash. Randomness is a hash of seed and keys, so reruns agree.

Where the target is crossed is found by sums over hash cells, three times at most, each
in the cell found before: no task sorts documents. Sources are ranked by range partitions
and their level by sums, so that no task holds all of them.

Null source: a source of its own, last. Null text: size 0. Sources without words have
target 0. Repeated rows (doc_id and text) are each taken alike. Empty input: empty output.
Other columns, whatever their names, are carried by `mixed` (but mix_shard and mix_copy,
which it replaces) and ignored by `taken`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import partitions, quoted, stash

GAP = r"[\x20\x09-\x0D]+"
#: At most so many rows of the table of sources or of blocks are broadcast.
BROADCAST_ROWS = 50_000
#: Groups of sources in a node's draw; bits of a cell; rows that a block has on average, at least; documents about the crossing that are chosen from.
GROUPS, CELL, LEAST_ROWS, CHOICE = 64, 12, 64, 10


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")), F.lit(0)).cast("bigint")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _ranked(per: DataFrame) -> DataFrame:
    """per with `turn`, from 0 in order of source, null last: ranges of sources are counted, and numbered on their own."""
    by = F.col("source").asc_nulls_last()
    cut = per.repartitionByRange(partitions(per.sparkSession), by).sortWithinPartitions(by)
    cut = stash(cut.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "mix-ranges")
    # one row for each range
    sizes = cut.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return cut.join(F.broadcast(before), "part").withColumn("turn", F.col("row") + F.col("before")).drop("part", "row", "before")


def targets(sized: DataFrame, weights: Sequence[float], ratio: float, cap: float) -> DataFrame:
    """Per source: source_size, n_rows and target. Targets are min(cap*size, level*weight), the level such that they share ratio*all."""
    turn = (F.col("turn") % len(weights) + 1).cast("int")
    per = _ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    per = stash(per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn)).drop("turn"), "mix-ranked")
    most = F.col("source_size") * cap
    total, level, full = per.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:  # the sources at their cap only become more
        capped = most < F.col("w") * level
        n, gone, left = per.agg(F.count_if(capped), F.coalesce(F.sum(F.when(capped, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("w"))), F.lit(0.0))).first()
        if n == full or not left:
            break
        full, level = n, (total * ratio - gone) / left
    return per.select("source", "source_size", "n_rows", F.least(most, F.col("w") * (level if left else float("inf"))).alias("target"))


def _log_factorial(n: Column) -> Column:
    """Exactly up to 20, then Stirling's series, which is off by less than 1e-12 there."""
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * F.pi() * x) + 1 / (12 * x) - 1 / (360 * F.pow(x, F.lit(3))) + 1 / (1260 * F.pow(x, F.lit(5)))
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of `good` among `total` are in a draw of `drawn`: the quantile u of the exact distribution."""
    choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    low, high = F.greatest(F.lit(0).cast("bigint"), drawn - (total - good)), F.least(good, drawn)
    p = lambda k: F.exp(choose(good, k) + choose(total - good, drawn - k) - choose(total, drawn))
    start = F.struct(F.lit(0.0).alias("sum"), low.alias("k"))
    step = lambda a, k: F.struct((a["sum"] + p(k)).alias("sum"), F.when(a["sum"] < u, k).otherwise(a["k"]).alias("k"))
    return F.aggregate(F.sequence(low, high), start, step, lambda a: a["k"])


def _uniform(*keys: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11) + 0.5) / float(1 << 53)


def _drawn(parts: Column, total: Column, drawn: Column, *keys: Column) -> Column:
    """From parts (name, q) that add up to total: how many of each are among `drawn`; one after the other, each from what is left."""
    n = lambda a: a["total"] - a["q"]
    k = lambda a: a["drawn"] - a["k"]
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<bigint>")
    start = F.struct(total.alias("total"), drawn.alias("drawn"), zero.alias("q"), zero.alias("k"), none.alias("out"))
    step = lambda a, x: F.struct(n(a).alias("total"), k(a).alias("drawn"), x["q"].alias("q"), hypergeometric(n(a), x["q"], k(a), _uniform(*keys, x["name"])).alias("k"), F.concat(a["out"], F.array(a["k"])).alias("out"))
    # what is drawn of an element is put down with the next one
    got = F.aggregate(parts, start, step, lambda a: F.concat(a["out"], F.array(a["k"])))
    return F.transform(parts, lambda x, i: F.struct(x["name"].alias("name"), x["q"].alias("q"), F.get(got, i + 1).alias("k")))


def quotas(units: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, name, q): how many of a source's units each shard gets, for units (name, q) with q above 0."""
    at = units.select(F.lit(0).alias("shard"), F.lit(shards).alias("leaves"), "name", "q")
    for _ in range((shards - 1).bit_length()):
        group = F.pmod(F.xxhash64("name"), F.lit(GROUPS)).alias("group")
        lists = at.groupBy("shard", "leaves", group).agg(F.sort_array(F.collect_list(F.struct("name", "q"))).alias("parts"), F.sum("q").alias("n"))
        lists = stash(lists, "mix-tree")
        nodes = lists.groupBy("shard", "leaves").agg(F.sort_array(F.collect_list(F.struct(F.col("group").alias("name"), F.col("n").alias("q")))).alias("groups"), F.sum("n").alias("all"))
        left = F.ceil(F.col("leaves") / 2).cast("int")
        draw = _drawn(F.col("groups"), F.col("all"), F.floor(F.col("all") * left / F.col("leaves")).cast("bigint"), F.lit(seed), F.lit("groups"), F.col("shard"), F.col("leaves"))
        groups = nodes.select("shard", "leaves", F.explode(draw).alias("d")).select("shard", "leaves", F.col("d.name").alias("group"), F.col("d.k").alias("k"))
        got = lists.join(groups, ["shard", "leaves", "group"])
        draw = _drawn(F.col("parts"), F.col("n"), F.col("k"), F.lit(seed), F.lit("sources"), F.col("shard"), F.col("leaves"))
        got = got.select("shard", "leaves", left.alias("left"), F.explode(draw).alias("d"))
        sides = F.array(F.struct(F.col("shard").alias("shard"), F.col("left").alias("leaves"), F.col("d.name").alias("name"), F.col("d.k").alias("q")), F.struct((F.col("shard") + F.col("left")).alias("shard"), (F.col("leaves") - F.col("left")).alias("leaves"), F.col("d.name").alias("name"), (F.col("d.q") - F.col("d.k")).alias("q")))
        at = got.select(F.explode(sides).alias("s")).select("s.*").where("q > 0")
    return at.select("shard", "name", "q")


def _crossing(sums: DataFrame, at: str) -> DataFrame:
    """(name, at, need, words): of sums (name, need, at, words) the place, in order of `at`, that passes need, and what is open before it."""
    lists = sums.groupBy("name", "need").agg(F.sort_array(F.collect_list(F.struct(at, "words"))).alias("x"))
    start = F.struct(F.col("need").alias("need"), F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("words"))
    here = lambda a, x: F.struct(a["need"].alias("need"), x[at].alias("at"), x["words"].alias("words"))
    on = lambda a, x: F.struct((a["need"] - x["words"]).alias("need"), a["at"].alias("at"), a["words"].alias("words"))
    found = F.aggregate("x", start, lambda a, x: F.when(a["at"].isNotNull(), a).when(x["words"] > a["need"], here(a, x)).otherwise(on(a, x)))
    return lists.select("name", found.alias("f")).select("name", F.col("f.at").alias(at), "f.need", "f.words").where(F.col(at).isNotNull())


def _place(seed: int) -> Column:
    """A document's place in the permutation of its block, 63 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("place"), "key"), 1)


def _block(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit("block"), "key"), F.col("n_blocks")).cast("int")


def plan(keyed: DataFrame, weights: Sequence[float], ratio: float, cap: float, blocks: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """For rows (source, size, key): (name, source_size, target, n_blocks, until, about, chosen) of sources and (name, block, copy, part, shard) of units.

    Of a unit with `part`, the documents whose place lies below `until` are taken, but of those at the places `about` those at `chosen`.
    """
    per = targets(keyed, weights, ratio, cap)
    total = per.agg(F.sum("source_size")).first()[0] or 0
    n_blocks = F.greatest(F.lit(1), F.least(F.round(F.col("source_size") * (blocks / max(total, 1))), F.floor(F.col("n_rows") / LEAST_ROWS))).cast("int")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    per = per.withColumns({"name": named(F.col("source")), "n_blocks": n_blocks, "passes": passes})
    per = stash(per.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")).drop("source"), "mix-sources")
    at = keyed.withColumn("name", named(F.col("source"))).join(_small(per.select("name", "n_blocks")), "name").withColumn("block", _block(seed))
    sizes = at.groupBy("name", "block").agg(F.sum("size").alias("words"))
    # at most `blocks` elements and some for each source
    order = F.struct(F.xxhash64(F.lit(seed), F.lit("draw"), "name", "block").alias("at"), "block", "words")
    lists = sizes.groupBy("name").agg(F.sort_array(F.collect_list(order)).alias("blocks")).join(per, "name").where("source_size > 0")
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.array().cast("array<struct<block:int,words:bigint,before:bigint>>").alias("out"))
    step = lambda a, b: F.struct((a["before"] + b["words"]).alias("before"), F.concat(a["out"], F.array(F.struct(b["block"].alias("block"), b["words"].alias("words"), a["before"].alias("before")))).alias("out"))
    lists = stash(lists.withColumn("blocks", F.aggregate("blocks", start, step, lambda a: a["out"])), "mix-blocks")
    one = lambda b, copy, part: F.struct(F.xxhash64(F.lit(seed), F.lit("deal"), "name", b["block"], copy).alias("at"), b["block"].alias("block"), copy.alias("copy"), F.lit(part).alias("part"))
    whole = F.when(F.col("passes") > 0, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.col("passes") - 1, F.lit(0))), lambda c: F.transform("blocks", lambda b: one(b, c, False)))))
    inside = F.filter("blocks", lambda b: (b["words"] > 0) & (b["before"] + b["words"] <= F.col("rest")))
    crossed = F.filter("blocks", lambda b: (b["before"] < F.col("rest")) & (b["before"] + b["words"] > F.col("rest")))
    rest = F.concat(F.transform(inside, lambda b: one(b, F.col("passes"), False)), F.transform(crossed, lambda b: one(b, F.col("passes"), True)))
    units = lists.select("name", F.array_sort(F.concat(F.coalesce(whole, F.array().cast("array<struct<at:bigint,block:int,copy:int,part:boolean>>")), rest)).alias("units")).where("size(units) > 0")
    dealt = quotas(units.select("name", F.size("units").cast("bigint").alias("q")), shards, seed)
    turns = dealt.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("shard", "q"))).alias("q"))
    turns = turns.select("name", F.flatten(F.transform("q", lambda x: F.array_repeat(x["shard"], x["q"].cast("int")))).alias("shards"))
    units = units.join(turns, "name").select("name", F.posexplode("units").alias("i", "u"), "shards")
    units = stash(units.select("name", "u.block", "u.copy", "u.part", F.get("shards", F.col("i")).alias("shard")), "mix-units")
    # where the target is crossed, in that block
    open_ = _small(lists.select("name", F.get(crossed, F.lit(0)).alias("c"), "rest").where("c is not null").select("name", F.col("c.block").alias("cut"), (F.col("rest") - F.col("c.before")).alias("need")))
    every = stash(at.join(open_, "name").where("block = cut and size > 0").groupBy("name", "need", _place(seed).alias("place")).agg(F.sum("size").alias("words")), "mix-crossed")
    rows = every
    for shift in (63 - CELL, 63 - 2 * CELL):
        cell = F.shiftright("place", shift)
        found = _crossing(rows.groupBy("name", "need", cell.alias("cell")).agg(F.sum("words").alias("words")), "cell")
        rows = rows.drop("need").join(_small(found.select("name", "need", F.col("cell").alias("c"))), "name").where(cell == F.col("c")).select("name", "need", "place", "words")
    until = stash(_crossing(rows, "place").select("name", "need", F.col("place").alias("until")), "mix-until")
    near = Window.partitionBy("name").orderBy(F.abs(F.col("place") - F.col("until")), "place")
    about = every.drop("need").join(_small(until), "name").withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= CHOICE)
    below = F.sum(F.when(F.col("place") < F.col("until"), F.col("words")).otherwise(0))
    about = about.groupBy("name", "until", "need").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("about"), below.alias("below"))
    none = F.array(F.struct(F.lit(0).cast("bigint").alias("words"), F.array().cast("array<bigint>").alias("places")))
    both = lambda a, x: F.concat(a, F.transform(a, lambda s: F.struct((s["words"] + x["words"]).alias("words"), F.concat(s["places"], F.array(x["place"])).alias("places"))))
    off = lambda s: F.struct(F.abs(s["words"] - F.col("below") - F.col("need")).alias("off"), s["places"].alias("places"))
    chosen = F.array_min(F.transform(F.aggregate("about", none, both), off))["places"]
    until = about.select("name", "until", F.col("about.place").alias("about"), chosen.alias("chosen"))
    return stash(per.select("name", "source_size", "target", "n_blocks").join(_small(until), "name", "left"), "mix-plan"), units


def named(source: Column) -> Column:
    """Sources as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def _dealt(rows: DataFrame, per: DataFrame, units: DataFrame, seed: int) -> DataFrame:
    """rows (source, key, ...) with name, source_size, target, block, place and their units: array of (copy, shard, part)."""
    lists = units.groupBy("name", "block").agg(F.sort_array(F.collect_list(F.struct("copy", "shard", "part"))).alias("units"))
    at = rows.withColumn("name", named(F.col("source"))).join(_small(per), "name").withColumns({"block": _block(seed), "place": _place(seed)})
    at = at.join(_small(lists), ["name", "block"], "left")
    inside = F.when(F.array_contains("about", F.col("place")), F.array_contains("chosen", F.col("place"))).otherwise(F.col("place") < F.col("until"))
    return at.withColumn("units", F.filter("units", lambda u: ~u["part"] | F.coalesce(inside, F.lit(False))))


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def taken(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, blocks: int = 1024, shards: int = 16, seed: int = 17) -> DataFrame:
    """Per row of docs (doc_id, text, source): doc_id, size, source_size, target, the words that the shards take of it, and these shards."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    keyed = stash(slim.select("doc_id", "source", n_words(F.col("text")).alias("size"), _key().alias("key")), "mix-sizes")
    per, units = plan(keyed, weights, ratio, cap, blocks, shards, seed)
    held = F.coalesce(F.transform("units", lambda u: u["shard"]), F.array().cast("array<int>"))
    return _dealt(keyed, per, units, seed).select("doc_id", "size", "source_size", "target", (F.size(held) * F.col("size")).cast("bigint").alias("taken"), held.alias("shards"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0, blocks: int = 1024, shards: int = 16, seed: int = 17) -> DataFrame:
    """The mix itself: docs repeated by unit, whole, with mix_shard and mix_copy.

    Partitions hold whole shards in random order; order by mix_shard when writing to keep that.
    """
    own = [c for c in docs.columns if c not in ("mix_shard", "mix_copy")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), F.struct(*[quoted(c) for c in own]).alias("row"))
    rows = rows.select("source", _key().alias("key"), n_words(F.col("text")).alias("size"), "row")
    per, units = plan(stash(rows.select("source", "size", "key"), "mix-sizes"), weights, ratio, cap, blocks, shards, seed)
    dealt = _dealt(rows.drop("size"), per, units, seed).where("size(units) > 0").select("row", "key", F.explode("units").alias("u"))
    order = F.xxhash64(F.lit(seed), F.lit("order"), "key", "u.copy")
    spread = max(64, partitions(docs.sparkSession))
    dealt = dealt.withColumn("at", order).repartition(F.col("u.shard"), F.pmod("at", F.lit(spread))).sortWithinPartitions("u.shard", "at")
    return dealt.select(*[F.col("row").getField(c).alias(c) for c in own], F.col("u.shard").alias("mix_shard"), F.col("u.copy").alias("mix_copy"))
