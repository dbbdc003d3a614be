"""Streams of events: sources, routing, snapshots, maintained aggregates; each a micro-batch job that can be run again from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a connection or a webhook sends.
ENVELOPE = "id string, type string, created timestamp, payload string"


def webhook(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """Stream of posted events, one JSON object a line; files are the queue between the receiver and this job."""
    reader = spark.readStream.schema(ENVELOPE)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).json(path)


def connections(spark: SparkSession, path: str, schema: str, most_files: int | None = None) -> DataFrame:
    """Stream of what a socket server writes: (connection, time, kind, payload) in Parquet files."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", most_files) if most_files else reader).parquet(path)


def finish(query) -> None:
    """Wait for a query that ends of itself; its failure is raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run handle on all that is there, batch by batch; with `every` (say, 5 minutes) go on polling at that interval."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def routed(stream: DataFrame, routes: Mapping[str, tuple[Column, str]], checkpoint: str):
    """Each route's rows to its Parquet path, a folder for each batch: a batch that is done again replaces its folder."""

    def put(batch: DataFrame, epoch: int) -> None:
        for condition, path in routes.values():
            batch.where(condition).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return each_batch(stream, put, checkpoint)


def alerts(old: DataFrame, new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What a snapshot has that the one before has not, and the reverse: (columns, change)."""
    a, b = old.select(*columns).distinct(), new.select(*columns).distinct()
    return b.join(a, list(columns), "left_anti").withColumn("change", F.lit("added")).unionAll(a.join(b, list(columns), "left_anti").withColumn("change", F.lit("removed")))


def reply(requests: DataFrame, state: DataFrame, kind: str, wanted: str, answer: Column) -> DataFrame:
    """Each request of a kind with an answer from the state, which is one row."""
    return requests.where(F.col(kind) == wanted).join(F.broadcast(state.limit(1).select(answer.alias("answer"))), F.lit(True))


def sessions(events: DataFrame, by: str, ts: str, idle: str) -> DataFrame:
    """Work of each worker between pauses of `idle`; stream or batch (on streams set a watermark on ts before)."""
    return events.groupBy(by, F.session_window(ts, idle).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
