"""Caches bounded by size: batches of operations in order, or a stream of them, one cache for each key.

Operations are rows (key, seq, op, cid, size, policy) with op put, get, update or clear. Null sizes count as 0.
"""

from __future__ import annotations

import json
from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

COLUMNS = ["key", "seq", "op", "cid", "size", "policy"]
SCHEMA = "key long, seq long, op string, cid long, outcome string, remaining long, items long"


class Cache:
    """Items by cid, the most recent last; lookups of any kind make an item the most recent."""

    def __init__(self, capacity: int, items: list | None = None):
        self.capacity, self.items = capacity, OrderedDict(tuple(x) for x in items or [])
        self.remaining = capacity - sum(self.items.values())

    def touch(self, cid) -> bool:
        if cid in self.items:
            self.items.move_to_end(cid)
            return True
        return False

    def apply(self, op: str, cid, size: int, policy: str) -> str:
        if op == "clear":
            self.items.clear()
            self.remaining = self.capacity
            return "cleared"
        known = self.touch(cid)
        if op == "get":
            return "hit" if known else "miss"
        if op == "update":
            if not known or size > self.remaining + self.items[cid]:
                return "miss"
            self.remaining += self.items[cid] - size
            self.items[cid] = size
            return "updated"
        if known:
            return "present"
        if size > self.capacity:
            return "refused"
        while self.remaining < size:
            self.remaining += self.items.popitem(last=policy != "lru")[1]
        self.items[cid] = size
        self.remaining -= size
        return "inserted"


def _answer(cache: Cache, key, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for seq, op, cid, size, policy in zip(rows["seq"], rows["op"], rows["cid"], rows["size"], rows["policy"]):
        outcome = cache.apply(op, cid, 0 if pd.isna(size) else int(size), policy)
        out.append((key, seq, op, cid, outcome, cache.remaining, len(cache.items)))
    return pd.DataFrame(out, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def simulate(ops: DataFrame, capacity: int = 200) -> DataFrame:
    """The outcome of each operation. A key's rows pass through one task in order, in batches, with no more than its cache held."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cache = None, Cache(capacity)
        for batch in batches:
            for k, rows in batch.groupby("key", sort=False):
                if k != key:
                    key, cache = k, Cache(capacity)
                yield _answer(cache, k, rows)

    rows = ops.select(*COLUMNS).where("key is not null").repartition("key").sortWithinPartitions("key", "seq")
    return rows.mapInPandas(each, SCHEMA)


def stream(ops: DataFrame, capacity: int = 200) -> DataFrame:
    """As `simulate` on a stream: the cache of each key is kept as state; a micro-batch's rows are taken by seq."""

    def each(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        cache = Cache(capacity, json.loads(state.get[0]) if state.exists else None)
        yield _answer(cache, key[0], pd.concat(frames).sort_values("seq", kind="stable"))
        state.update((json.dumps([[int(c), s] for c, s in cache.items.items()]),))

    return ops.select(*COLUMNS).where("key is not null").groupBy("key").applyInPandasWithState(each, SCHEMA, "items string", "append", "NoTimeout")
