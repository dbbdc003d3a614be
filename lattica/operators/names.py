"""Names of helper columns that clash with no one's."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(*frames: DataFrame, start: str = "x") -> str:
    """A name with which no column of the frames begins, in either case."""
    names = [c.lower() for f in frames for c in f.columns]
    name = start
    while any(c.startswith(name) for c in names):
        name += "x"
    return name
