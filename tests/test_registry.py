"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from lattica.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(v):
    if isinstance(v, list):
        return tuple(plain(x) for x in v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return "nan" if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA)
    want = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted((tuple(plain(r[n]) for n in names) for r in got.collect()), key=str)
    b = sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=str)
    assert a == b
