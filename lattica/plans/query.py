"""The list API's query layer: a parameter map becomes filters, search, columns, order and a page."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESERVED = ("page", "sort", "limit", "fields", "keyword")
_OPS = {"gte": lambda c, v: c >= v, "gt": lambda c, v: c > v, "lte": lambda c, v: c <= v, "lt": lambda c, v: c < v}


def conditions(df: DataFrame, params: Mapping) -> Column:
    """All of f=v, f={gte: v, ...} and f={in: [..]}; values are cast to the column's type."""
    out, types = F.lit(True), dict(df.dtypes)
    for field, want in params.items():
        if field in RESERVED:
            continue
        cast = lambda v, t=types[field]: F.lit(v).cast(t)
        for op, v in want.items() if isinstance(want, Mapping) else [("eq", want)]:
            c = F.col(field)
            out &= c == cast(v) if op == "eq" else c.isin(*[cast(x) for x in v]) if op == "in" else _OPS[op](c, cast(v))
    return out


def search(df: DataFrame, keyword: str | None, columns: Sequence[str]) -> DataFrame:
    """Rows of which a column matches the pattern, in either case."""
    if not keyword:
        return df
    hit = F.lit(False)
    for c in columns:
        hit |= F.coalesce(F.col(c).rlike(f"(?i){keyword}"), F.lit(False))
    return df.where(hit)


def fields(df: DataFrame, spec: str | None) -> DataFrame:
    """`a,b` selects, `-a,-b` drops; a mix is an error."""
    names = [x for x in (spec or "").split(",") if x]
    drop = [x[1:] for x in names if x[0] == "-"]
    if drop and len(drop) < len(names):
        raise ValueError("fields either selects or drops")
    return df.drop(*drop) if drop else df.select(*names) if names else df


def order(df: DataFrame, spec: str | None, default: str) -> DataFrame:
    """`a,-b`: ascending a, descending b; nulls are least."""
    names = [x for x in (spec or default).split(",") if x]
    return df.orderBy(*[F.col(x[1:]).desc_nulls_last() if x[0] == "-" else F.col(x).asc_nulls_first() for x in names])


@dataclass
class Page:
    data: DataFrame
    results: int
    current: int
    limit: int

    @property
    def pages(self) -> int:
        return math.ceil(self.results / self.limit)

    def meta(self) -> dict:
        out = {"currentPage": self.current, "limit": self.limit, "numberOfPages": self.pages}
        if self.current * self.limit < self.results:
            out["nextPage"] = self.current + 1
        if self.current > 1:
            out["prevPage"] = self.current - 1
        return out

    def envelope(self) -> dict:
        """What the API sends: results is the filtered count. The page alone is collected."""
        return {"results": self.results, "paginationResult": self.meta(), "data": [r.asDict(True) for r in self.data.collect()]}


    def meta_frame(self) -> DataFrame:
        """The envelope's figures as one row."""
        m = self.meta()
        row = (self.results, self.current, self.limit, self.pages, m.get("nextPage"), m.get("prevPage"))
        return self.data.sparkSession.createDataFrame([row], "results long, current_page int, page_limit int, pages int, next_page int, prev_page int")


def secured(df: DataFrame, role: str, owner: str, me: object) -> DataFrame:
    """A plain user sees own rows, other roles all."""
    return df.where(F.col(owner) == F.lit(me)) if role == "user" else df


def only_keys(pairs: Column, allowed: Sequence[str]) -> Column:
    return F.map_filter(pairs, lambda k, _: k.isin(*allowed))


def _number(value, default: int) -> int:
    try:
        return int(value) or default
    except (TypeError, ValueError):
        return default


def paginate(df: DataFrame, page=None, limit=None) -> DataFrame:
    page, limit = _number(page, 1), _number(limit, 50)
    return df.offset((page - 1) * limit).limit(limit)


def page(df: DataFrame, params: Mapping, searched: Sequence[str] = (), key: str | None = None, default_sort: str = "-createdAt", scope: Column | None = None) -> Page:
    """The whole chain. scope: a parent's or a user's condition; key breaks ties of the order."""
    found = search(df.where(conditions(df, params)) if scope is None else df.where(scope).where(conditions(df, params)), params.get("keyword"), searched)
    spec = params.get("sort") or default_sort
    ordered = order(found, f"{spec},{key}" if key and key not in spec.replace("-", "").split(",") else spec, default_sort)
    n, k = _number(params.get("page"), 1), _number(params.get("limit"), 50)
    return Page(fields(paginate(ordered, n, k), params.get("fields")), found.count(), n, k)
