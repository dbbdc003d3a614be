"""Joins, grouped and ordered operators, set operators and keyed updates on DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import scan
from lattica.operators.names import fresh
from lattica.operators.sweep import band_join  # noqa: F401


# joins
def populate(left: DataFrame, right: DataFrame, on: str, key: str, columns: Sequence[str]) -> DataFrame:
    """Resolve a reference: right's columns beside left, null where it dangles."""
    k = fresh(left, right)
    return left.join(right.select(F.col(key).alias(k), *columns), F.col(on) == F.col(k), "left").drop(k)


def children(parent: DataFrame, child: DataFrame, key: str, foreign: str, columns: Sequence[str], name: str) -> DataFrame:
    """Each parent with an array of its children, empty without any."""
    k = fresh(parent, child)
    lists = child.groupBy(F.col(foreign).alias(k)).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    out = parent.join(lists, F.col(key) == F.col(k), "left").drop(k)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(dict(out.dtypes)[name])))


def populate_array(df: DataFrame, ids: str, right: DataFrame, key: str, value: str, name: str, row: str) -> DataFrame:
    """An array of references as an array of the values they lead to, in order; dangling ones are left out. Rows that share `row` keep their own arrays."""
    x = fresh(df, right)
    r, a, k = f"{x}r", f"{x}a", f"{x}k"
    one = df.select(F.col(row).alias(r), F.col(ids).alias(a)).distinct().select(r, a, F.posexplode(a).alias(f"{x}i", k))
    got = one.join(right.select(F.col(key).alias(f"{x}o"), F.col(value).alias(f"{x}v")), F.col(k) == F.col(f"{x}o"))
    lists = got.groupBy(r, a).agg(F.transform(F.sort_array(F.collect_list(F.struct(f"{x}i", f"{x}v"))), lambda y: y[f"{x}v"]).alias(name))
    out = df.join(lists, F.col(row).eqNullSafe(F.col(r)) & F.col(ids).eqNullSafe(F.col(a)), "left").drop(r, a)
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(dict(out.dtypes)[name])))


def unseen(new: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key was not seen, once each."""
    return new.dropDuplicates(list(keys)).join(seen.select(*keys), list(keys), "left_anti")


def all_exist(wanted: DataFrame, known: DataFrame, key: str) -> Column:
    """Whether every wanted key is known; a key asked for twice counts twice and so fails."""
    n = wanted.join(known.select(key).distinct(), key, "left_semi").distinct().count()
    return F.lit(n == wanted.count())


def contains_any(df: DataFrame, column: str, words: Sequence[str]) -> DataFrame:
    """Rows whose column holds one of the words. words is a parameter, so its size is known."""
    return df.where(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(column), w)))


def band(df: DataFrame, value: str, tiers: Sequence[tuple[float, float, object]], name: str) -> DataFrame:
    """The first tier (low, high, result) with low <= value <= high, null without one; tiers compile to one expression."""
    c = F.col(value)
    return df.withColumn(name, F.coalesce(*[F.when(c.between(lo, hi), F.lit(r)) for lo, hi, r in tiers]))


def lookup(df: DataFrame, column: str, mapping: Mapping, name: str, default=None) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(name, F.coalesce(F.try_element_at(pairs, F.col(column)), F.lit(default)))


# aggregates
def ratings(df: DataFrame, by: str, value: str) -> DataFrame:
    """Average to one decimal, half up, and count."""
    return df.groupBy(by).agg((F.floor(F.avg(value) * 10 + 0.5) / 10).alias("average"), F.count(F.lit(1)).alias("quantity"))


def modes(df: DataFrame, column: str) -> DataFrame:
    """All most frequent values with their frequency."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))
    return n.join(n.agg(F.max("frequency").alias("frequency")), "frequency").select(column, "frequency")


def letters_key(word: Column) -> Column:
    return F.array_join(F.array_sort(F.split(word, "")), "")


def anagrams(df: DataFrame, word: str, position: str) -> DataFrame:
    """Words in groups of equal letters, in order of position."""
    lists = F.transform(F.sort_array(F.collect_list(F.struct(position, word))), lambda x: x[word])
    return df.groupBy(letters_key(F.col(word)).alias("key")).agg(lists.alias("words"))


def load_statistics(df: DataFrame, key: str, hashed: Column, capacity: int) -> DataFrame:
    n = df.select(key, F.pmod(hashed, F.lit(capacity)).alias("bucket")).agg(F.countDistinct(key).alias("size"), F.countDistinct("bucket").alias("used"))
    return n.select("size", (F.col("size") / capacity).alias("table_load"), (F.lit(capacity) - F.col("used")).alias("empty_buckets"))


# ordered rows; without `by` they are those of `scan`, over the whole table and in no single task
def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Runs of equal values: number, value, length."""
    if not by:
        return scan.runs(df, order, value)
    x = fresh(df)
    w = Window.partitionBy(*by).orderBy(*order)
    new = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.row_number().over(w).eqNullSafe(1)).cast("int")
    return df.withColumn(x, new).withColumn("run", F.sum(x).over(w)).groupBy(*by, "run", value).agg(F.count(F.lit(1)).alias("length"))


def fill_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """The last value up to each row; leading gaps take the first."""
    if not by:
        return scan.fill_forward(df, order, value)
    w = Window.partitionBy(*by).orderBy(*order)
    back = w.rowsBetween(0, Window.unboundedFollowing)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, True).over(past), F.first(value, True).over(back)))


def take_while(df: DataFrame, by: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Rows before the first that fails."""
    if not by:
        return scan.take_while(df, order, condition)
    x = fresh(df)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(x, F.max((~F.coalesce(condition, F.lit(False))).cast("int")).over(w)).where(F.col(x) == 0).drop(x)


def first_or_last_marked(df: DataFrame, key: str, order: str, marked: Column) -> DataFrame:
    """Of each key the first row, or the last marked row if there is one; of rows at one place in the order the one of least hash."""
    x, hit = fresh(df), F.coalesce(marked, F.lit(False))
    rank = Window.partitionBy(key).orderBy(hit.desc(), F.when(hit, F.col(order)).desc_nulls_last(), F.col(order).asc(), scan.row_hash(df))
    return df.withColumn(x, F.row_number().over(rank)).where(F.col(x) == 1).drop(x)


def above_high_water(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value exceeds all before it."""
    if not by:
        return scan.above_high_water(df, order, value)
    x = fresh(df)
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(x, F.max(value).over(w)).where(F.col(x).isNull() | (F.col(value) > F.col(x))).drop(x)


# sets and changes
def same_set(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty() and b.subtract(a).isEmpty()


def subset(a: DataFrame, b: DataFrame) -> bool:
    return a.subtract(b).isEmpty()


def changed(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of new that differ from old's of the same key."""
    k = fresh(old, new)
    other = old.select(F.col(key).alias(k), *[F.col(c).alias(f"old_{c}") for c in columns])
    diff = F.lit(False)
    for c in columns:
        diff |= ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return new.join(other, F.col(key) == F.col(k)).where(diff).drop(k)


def roles(readers: DataFrame, writers: DataFrame, user: str) -> DataFrame:
    """Members of either, as writer if they are in both."""
    both = readers.select(user, F.lit(0).alias("r")).unionAll(writers.select(user, F.lit(1).alias("r")))
    return both.groupBy(user).agg(F.when(F.max("r") == 1, "writer").otherwise("reader").alias("role"))


# keyed updates
def last_wins(ops: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key (put, put, ...); of rows at one place in the order the one of greatest hash."""
    n = fresh(ops)
    return ops.withColumn(n, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), scan.row_hash(ops).desc()))).where(F.col(n) == 1).drop(n)


def replay(ops: DataFrame, key: str, order: str, op: str = "op") -> DataFrame:
    """State after puts, removes and clears in order; a clear takes away all keys that were put before it."""
    cleared = ops.where(F.col(op) == "clear").agg(F.max(order)).scalar()
    kept = ops.where(~F.col(op).eqNullSafe("clear") & (cleared.isNull() | (F.col(order) > cleared)))
    return last_wins(kept, key, order).where(F.col(op) == "put").drop(op)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def update(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Non-null columns of new replace old's."""
    x = fresh(old, new)
    other = new.select(F.col(key).alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    out = old.join(other, F.col(key) == F.col(x), "left")
    return out.withColumns({c: F.coalesce(f"{x}_{c}", c) for c in columns}).select(*old.columns)


def increment(stock: DataFrame, lines: DataFrame, key: str, foreign: str, amount: str, minus: str, plus: str) -> DataFrame:
    """Take the lines' amounts off one column and add them to another; no floor."""
    x = fresh(stock, lines)
    k, n = f"{x}k", f"{x}n"
    total = lines.groupBy(F.col(foreign).alias(k)).agg(F.sum(amount).alias(n))
    out = stock.join(total, F.col(key) == F.col(k), "left").withColumn(n, F.coalesce(n, F.lit(0)))
    return out.withColumn(minus, F.col(minus) - F.col(n)).withColumn(plus, F.col(plus) + F.col(n)).drop(k, n)


def stamp(df: DataFrame, reached: Column, flag: str, at: str, when: Column) -> DataFrame:
    """A state with the time it was reached; null as long as it is not."""
    return df.withColumn(flag, F.coalesce(reached, F.lit(False))).withColumn(at, F.when(reached, when))


def validate(df: DataFrame, rules: Sequence[tuple[Column, str]], name: str = "errors") -> DataFrame:
    """All messages of rules that a row breaks; an unknown outcome breaks the rule."""
    return df.withColumn(name, F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(m)) for ok, m in rules])))
