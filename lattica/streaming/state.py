"""Streams with a state for each key, kept in RocksDB by Spark: a batch reads and writes the keys that it has, and no others.

The state is a table of its own: `table_of` reads it from the checkpoint, as it was after any of the last batches that Spark
retains (spark.sql.streaming.minBatchesToRetain, 100). What changes goes to a committed sink, so a batch that is
done again after a failure changes neither the state nor the feed.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lattica.streaming import sink

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start within keep their state in RocksDB, and changes of it alone in the checkpoint."""
    names = {_PROVIDER: _ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Presence(StatefulProcessor):
    """A connection's last event; of events at one time the greatest kind is the last, earlier ones that come late change nothing.

    idle: microseconds of event time after which a connection that isn't closed is closed as `idle`.
    """

    def __init__(self, closing: str, idle: int | None):
        self.closing, self.idle = closing, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = tuple(self.last.get()) if self.last.exists() else None
        new = max([x for frame in rows for x in zip(frame["us"].tolist(), frame["kind"])] + ([old] if old else []))
        if new != old:
            self.last.update(new)
            if self.idle is not None:
                for at in [*self.handle.listTimers()]:
                    self.handle.deleteTimer(at)
                if new[1] != self.closing:
                    self.handle.registerTimer((new[0] + self.idle) // 1000)
            yield pd.DataFrame({"conn_id": [key[0]], "us": [new[0]], "kind": [new[1]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self.last.update((at, self.closing))
        yield pd.DataFrame({"conn_id": [key[0]], "us": [at], "kind": ["idle"]})

    def close(self) -> None:
        pass


def presence(events: DataFrame, closing: str = "close", idle: float | None = None) -> DataFrame:
    """Changes of each connection's last event: (conn_id, ts, kind). Rows without one of these change nothing.

    idle: seconds of event time after which an open connection is closed; events then need a watermark on ts.
    """
    x = events.where("conn_id is not null and ts is not null and kind is not null").select("conn_id", "ts", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    schema = f"conn_id {dict(events.dtypes)['conn_id']}, us long, kind string"
    out = x.groupBy("conn_id").transformWithStateInPandas(Presence(closing, None if idle is None else int(idle * 1e6)), schema, "Append", "None" if idle is None else "EventTime")
    return out.select("conn_id", F.timestamp_micros("us").alias("ts"), "kind")


class Reviews(StatefulProcessor):
    """All ratings of a product by review, and their sum and number; a review that comes again replaces its rating, a null rating removes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.of = handle.getMapState("reviews", "review string", "rating double")
        self.sums = handle.getValueState("sums", "total double, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}
        for frame in rows:
            for review, order, rating in zip(frame["review"], frame["seq"], frame["rating"]):
                if review not in last or order >= last[review][0]:
                    last[review] = (order, None if pd.isna(rating) else float(rating))
        # each call is a message to the JVM: a product without sums has no reviews, and a rating that is replaced need not be removed first
        known = self.sums.exists()
        total, n = tuple(self.sums.get()) if known else (0.0, 0)
        for review, (_, rating) in last.items():
            old = self.of.getValue((review,)) if known else None
            if old is not None:
                total, n = total - old[0], n - 1
            if rating is not None:
                self.of.updateValue((review,), (rating,))
                total, n = total + rating, n + 1
            elif old is not None:
                self.of.removeKey((review,))
        self.sums.update((total if n else 0.0, n))
        yield pd.DataFrame({"product": [key[0]], "total": [total if n else 0.0], "n": [n]})

    def close(self) -> None:
        pass


def reviews(changes: DataFrame) -> DataFrame:
    """(product, review, seq, rating): each product's sum and number of ratings, whenever one of them is set, changed or removed (null).

    Of a batch's rows of one review the one of greatest seq counts; batches count in their order. Rows without product or review are left out.
    """
    x = changes.select("product", F.col("review").cast("string").alias("review"), F.col("seq").cast("bigint").alias("seq"), F.col("rating").cast("double").alias("rating"))
    schema = f"product {dict(changes.dtypes)['product']}, total double, n long"
    return x.where("product is not null and review is not null and seq is not null").groupBy("product").transformWithStateInPandas(Reviews(), schema, "Append", "None")


def start(changes: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Run a stateful stream; its changes go to the committed sink at path."""
    with rocksdb(changes.sparkSession):
        return sink.start(changes, path, checkpoint, once)


def maintained(stream: DataFrame, by: str, value: str, path: str, checkpoint: str):
    """Sum and number of a value for each key, kept up to date by Spark's own aggregation; a batch's new figures go to path/batch=<n>, of its own keys alone."""
    sums = stream.groupBy(by).agg(F.sum(F.col(value).cast("double")).alias("total"), F.count(value).alias("n"))
    put = lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}")
    with rocksdb(stream.sparkSession):
        return sums.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_of(spark: SparkSession, checkpoint: str, name: str | None = None, batch: int | None = None) -> DataFrame:
    """The state as a table, key and value columns, as it is after a batch (the last one). name: of a processor's variable; None for an aggregation."""
    reader = spark.read.format("statestore")
    reader = reader if name is None else reader.option("stateVarName", name)
    reader = reader if batch is None else reader.option("batchId", batch)
    with rocksdb(spark):
        return reader.load(checkpoint).select("key.*", "value.*")


def online(spark: SparkSession, checkpoint: str, closing: str = "close", batch: int | None = None) -> DataFrame:
    """Connections that are open after a batch: (conn_id, ts, kind)."""
    return table_of(spark, checkpoint, "last", batch).where(F.col("kind") != closing).select("conn_id", F.timestamp_micros("us").alias("ts"), "kind")


def ratings(spark: SparkSession, checkpoint: str, by: str, name: str | None = "sums", batch: int | None = None) -> DataFrame:
    """Each key's average to one decimal, half up, and number of ratings; keys without any are left out. name: None for `maintained`."""
    x = table_of(spark, checkpoint, name, batch).toDF(by, "total", "n").where("n > 0")
    return x.select(by, (F.floor(F.round(F.col("total") / F.col("n"), 9) * 10 + 0.5) / 10).alias("average"), F.col("n").alias("quantity"))
