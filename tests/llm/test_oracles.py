"""The queries with SQL against DuckDB, on whole small tables."""

import os

import duckdb
import pytest

from lattica.llm import queries


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, name, folder):
    at = f"/root/testdata/{folder}"
    c = duckdb.connect()
    for f in os.listdir(at):
        c.execute(f"create view {f.split('.')[0]} as select * from '{at}/{f}'")
    want = c.execute(queries.ORACLE[name])
    names = [d[0] for d in want.description]
    # repr, as some values are null
    assert sorted(map(tuple, queries.QUERIES[name](spark, at).select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
