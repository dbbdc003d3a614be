"""Pages of any depth: histograms of the order's columns narrow the table to the rows about the page, and only these are sorted."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewer rows than these are sorted at once.
MOST_ROWS = 1 << 18


def parsed(spec: str) -> list[tuple[str, bool]]:
    """`a,-b` as (column, whether it falls)."""
    return [(x.lstrip("-"), x[0] == "-") for x in spec.split(",") if x]


def ordered(df: DataFrame, spec: str) -> DataFrame:
    """Nulls are least."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in parsed(spec)])


def _histogram(df: DataFrame, c: str, n: int, buckets: int, sample: int) -> tuple[list, list[int]]:
    """(bounds, rows in each bucket): bucket 0 holds nulls, bucket i values from bound i-1 on and below bound i.

    Bounds come from at most about `sample` rows; rows are counted in one pass that reads this column alone.
    """
    some = df.select(c).where(F.col(c).isNotNull()).sample(min(1.0, sample / max(n, 1)), 7).groupBy(c).count().collect()
    values = sorted(r[0] for r in some)
    bounds = sorted(set(values[:: max(1, len(values) // buckets)]) | set(values[-1:]))
    if not bounds:
        return [], [n]
    kind = df.schema[c].dataType
    bucket = F.when(F.col(c).isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(b).cast(kind) for b in bounds]), lambda b: b <= F.col(c))) + 1)
    counts = dict(df.select(bucket.alias("b")).groupBy("b").count().collect())
    return bounds, [counts.get(i, 0) for i in range(len(bounds) + 2)]


def _between(c: str, bounds: list, first: int, last: int) -> Column:
    """The condition of buckets first to last."""
    if first == last == 0:
        return F.col(c).isNull()
    low = F.lit(True) if first <= 1 else F.col(c) >= F.lit(bounds[first - 2])
    high = F.lit(True) if last > len(bounds) else F.col(c) < F.lit(bounds[last - 1])
    inside = F.col(c).isNotNull() & low & high
    return F.col(c).isNull() | inside if first == 0 else inside


def rows_at(df: DataFrame, spec: str, offset: int, limit: int, most: int = MOST_ROWS, buckets: int = 64, sample: int = 8192) -> DataFrame:
    """As `order by spec offset .. limit ..`: rows about the page are picked by one column after the other, until at most `most` are left to be sorted.

    Each step reads one column; conditions on columns reach the files' statistics. spec should be a total order, else ties at the page's
    edges are settled anew each time.
    """
    found, skip, n = df, offset, df.count()
    for c, down in parsed(spec):
        while n > most and skip < n:
            bounds, counts = _histogram(found, c, n, buckets, sample)
            order = [i for i in (reversed(range(len(counts))) if down else range(len(counts))) if counts[i]]
            sums = [0]
            for i in order:
                sums.append(sums[-1] + counts[i])
            a = bisect_left(sums, skip + 1) - 1
            b = min(bisect_left(sums, skip + limit) - 1, len(order) - 1)
            if a == 0 and b == len(order) - 1:
                break  # one value, or nothing to leave out
            first, last = min(order[a], order[b]), max(order[a], order[b])
            found = found.where(_between(c, bounds, first, last))
            skip, n = skip - sums[a], sums[b + 1] - sums[a]
        low, high = found.agg(F.min(c), F.max(c)).first() if n > most else (None, None)
        if n <= most or low != high:
            break  # what is left spans several values: the next column orders within them only
    return ordered(found, spec).offset(max(skip, 0)).limit(limit)


def rows_after(df: DataFrame, spec: str, last: Mapping | Sequence, limit: int) -> DataFrame:
    """The next rows in order after the row `last` (its values of the order's columns): no row before it is sorted or counted."""
    columns = parsed(spec)
    values = [last[c] for c, _ in columns] if isinstance(last, Mapping) else list(last)
    beyond, same = F.lit(False), F.lit(True)
    for (c, down), v in zip(columns, values):
        x, v_ = F.col(c), F.lit(v)
        if v is None:
            further, equal = (F.lit(False) if down else x.isNotNull()), x.isNull()
        else:
            further, equal = (x.isNull() | (x < v_) if down else x > v_), x.eqNullSafe(v_)
        beyond, same = beyond | (same & F.coalesce(further, F.lit(False))), same & equal
    return ordered(df.where(beyond), spec).limit(limit)
