"""Presence in batches, counts by window, and incremental loads; `state` has presence on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def online(events: DataFrame, conn: str = "conn_id", ts: str = "ts", kind: str = "kind", closing: str = "close") -> DataFrame:
    """Batch: connections whose last event is no closing one; of events at one time the greatest kind is the last."""
    last = events.groupBy(conn).agg(F.max(F.struct(ts, kind))[kind].alias("last"))
    return last.where(F.col("last") != closing).select(conn)


def online_counts(events: DataFrame, window: str = "1 hour", ts: str = "ts", kind: str = "kind") -> DataFrame:
    """Stream or batch: opens and closes by window; on streams set a watermark on ts before."""
    return events.groupBy(F.window(ts, window).alias("w")).agg(F.count_if(F.col(kind) == "open").alias("opened"), F.count_if(F.col(kind) == "close").alias("closed")).select(F.col("w.start").alias("start"), "opened", "closed")


def new_since(messages: DataFrame, last_run, ts: str = "ts") -> DataFrame:
    """Rows after the last run's mark; `next_mark` gives the mark to store once they are handled."""
    return messages.where(F.col(ts) > F.lit(last_run))


def next_mark(messages: DataFrame, last_run, ts: str = "ts") -> DataFrame:
    """One row: the mark for the next run, the old one if nothing is new."""
    return new_since(messages, last_run, ts).agg(F.coalesce(F.max(ts), F.lit(last_run).cast(dict(messages.dtypes)[ts])).alias("next_run"))

