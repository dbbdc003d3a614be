"""Keyed stream state, committed sinks, paged sources and versioned tables: restarts, repeated batches, faults."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lattica.sources import pages, scratch, versions
from lattica.streaming import events as E
from lattica.streaming import sink, state


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def updated(query):
    return [sum(s.numRowsUpdated for s in p.stateOperators) for p in query.recentProgress if p.numInputRows]


def test_presence_writes_the_keys_of_a_batch(spark):
    src, to, check = (scratch.folder(spark, x) for x in ("src", "to", "check"))
    schema = "conn_id long, ts timestamp, kind string"
    feed(spark, src, [(i, at(0), "open") for i in range(200)] + [(None, at(0), "open"), (5, None, "close"), (6, at(0), None)], schema)
    run = lambda: state.start(state.presence(E.connections(spark, src, spark.createDataFrame([], schema).schema)), to, check)
    q = run()
    E.finish(q)
    assert updated(q) == [200]
    feed(spark, src, [(1, at(5), "close"), (2, at(-5), "close"), (3, at(7), "open"), (3, at(6), "close"), (4, at(0), "close")], schema)
    q = run()
    E.finish(q)
    assert sum(updated(q)) <= 4
    E.finish(run())  # nothing new
    assert {r.conn_id for r in state.online(spark, check).collect()} == set(range(200)) - {1}  # of events at one time the greatest kind
    assert state.online(spark, check, batch=0).count() == 200
    assert {(r.conn_id, r.ts, r.kind) for r in sink.committed(spark, to, schema).where("batch = 1").collect()} == {(1, at(5), "close"), (3, at(7), "open")}


def test_idle_connections_are_closed(spark):
    src, to, check = (scratch.folder(spark, x) for x in ("src", "to", "check"))
    schema = "conn_id long, ts timestamp, kind string"
    for rows in ([(1, at(0), "open"), (2, at(0), "open"), (3, at(0), "open")], [(1, at(8), "open"), (3, at(1), "close")], [(2, at(30), "close"), (9, at(31), "open")]):
        feed(spark, src, rows, schema)
        x = E.connections(spark, src, spark.createDataFrame([], schema).schema).withWatermark("ts", "1 minute")
        E.finish(state.start(state.presence(x, idle=600), to, check))
    got = {(r.conn_id, r.ts, r.kind) for r in sink.committed(spark, to, schema).where("kind = 'idle'").collect()}
    assert (1, at(18), "idle") in got and not any(c in (3, 9) for c, _, _ in got)
    assert {r.conn_id for r in state.online(spark, check).collect()} == {9}


def test_averages_follow_each_change_of_a_review(spark):
    src, to, check = (scratch.folder(spark, x) for x in ("src", "to", "check"))
    schema = "product string, review long, seq long, rating double"
    run = lambda: E.finish(state.start(state.reviews(E.connections(spark, src, spark.createDataFrame([], schema).schema)), to, check))
    got = lambda: {r["product"]: (r.average, r.quantity) for r in state.ratings(spark, check, "product").collect()}
    feed(spark, src, [("a", 1, 1, 5.0), ("a", 2, 2, 2.0), ("b", 1, 3, 4.0), ("b", 1, 4, 1.0), (None, 1, 5, 1.0), ("c", 9, 6, None)], schema)
    run()
    assert got() == {"a": (3.5, 2), "b": (1.0, 1)}
    feed(spark, src, [("a", 1, 7, 4.0), ("b", 1, 8, None)], schema)
    run()
    run()
    assert got() == {"a": (3.0, 2)}


def test_maintained_by_spark_alone(spark):
    src, to, check = (scratch.folder(spark, x) for x in ("src", "to", "check"))
    x = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 5.0)], "k long, v double")
    x.coalesce(1).write.mode("append").parquet(src)
    for more in (None, [(1, 6.0), (3, 1.0)], None):
        if more:
            feed(spark, src, more, x.schema)
        E.finish(state.maintained(E.connections(spark, src, x.schema), "k", "v", to, check))
    assert {r.k: (r.average, r.quantity) for r in state.ratings(spark, check, "k", None).collect()} == {1: (4.0, 3), 2: (5.0, 1), 3: (1.0, 1)}
    assert {r.k for r in spark.read.parquet(to).where("batch = 1").collect()} == {1, 3}


def test_a_sink_shows_each_batch_once(tmp_path):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"x": list(range(10)), "y": ["é"] * 10})
    writer = sink.CommittedWriter({"path": str(tmp_path), "rows": "4"})
    lost = writer.write(iter([batch]))  # a task whose report never came
    done = writer.write(iter([batch]))
    assert len(lost.files) == len(done.files) == 3 and sink.listed(str(tmp_path)) == []
    writer.commit([done, None], 0)
    again = writer.write(iter([batch]))
    writer.commit([again], 0)  # the batch was done twice
    assert [(x["batch"], x["files"], x["rows"]) for x in sink.listed(str(tmp_path))] == [(0, done.files, 10)]
    assert not any((tmp_path / f).exists() for f in again.files)
    other = writer.write(iter([batch]))
    writer.abort([other, None], 1)
    assert not any((tmp_path / f).exists() for f in other.files)


def test_a_killed_query_goes_on(spark):
    src, to, check = (scratch.folder(spark, x) for x in ("src", "to", "check"))
    feed(spark, src, [(i,) for i in range(30)], "x long")
    x = E.connections(spark, src, spark.createDataFrame([], "x long").schema)
    broken = x.select(F.when(F.col("x") == 29, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("x")).alias("x"))
    with pytest.raises(Exception, match="broken"):
        E.finish(sink.start(broken, to, check, rows=4))
    assert sink.committed(spark, to, "x long").count() == 0
    E.finish(sink.start(x, to, check, rows=4, fileformat="json"))
    E.finish(sink.start(x, to, check, rows=4, fileformat="json"))
    assert sorted(r.x for r in sink.committed(spark, to, "x long", "json").collect()) == list(range(30))


def test_pages_in_tasks_chains_and_streams(spark):
    at_, chains = scratch.folder(spark, "pages"), scratch.folder(spark, "pages")
    rows = spark.range(95).select("id", F.concat(F.lit("ü"), "id").alias("name"))
    pages.write_pages(rows, at_, F.floor(F.col("id") / 10).cast("int"), ["id"])
    pages.write_pages(rows, chains, F.floor(F.col("id") / 30).cast("int"), ["id"], F.concat(F.lit("s "), F.col("id") % 3))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(pages.read(spark, at_, "id long, name string", pages=10, tasks=3, wait=0)) == list(range(95))
    assert pages.read(spark, at_, "id long", pages=10, tasks=3).rdd.getNumPartitions() == 3
    assert ids(pages.read(spark, at_, "id long", wait=0)) == list(range(95))
    assert ids(pages.read(spark, at_, "id long", most=33, wait=0)) == list(range(33))
    assert ids(pages.read(spark, at_, "id long", first=7, wait=0)) == list(range(70, 95))  # a stored offset
    assert {(r.start, r.id) for r in pages.read(spark, chains, "start string, id long", starts=["s 0", "s 2", "none"]).collect()} == {(f"s {i % 3}", i) for i in range(95) if i % 3 != 1}
    with pages.served(at_, failures=2) as address:
        assert ids(pages.read(spark, address + "?page={page}", "id long", wait=0)) == list(range(95))
    with pages.served(at_, failures=9) as address, pytest.raises(Exception, match="503"):
        ids(pages.read(spark, address + "?page={page}", "id long", tries=2, wait=0))


def test_a_page_stream_goes_on_from_its_offset(spark):
    at_, to, check = (scratch.folder(spark, x) for x in ("pages", "to", "check"))
    put = lambda a, b: pages.write_pages(spark.range(a, b), at_, F.floor(F.col("id") / 10).cast("int"), ["id"])

    def run():
        q = sink.start(pages.stream(spark, at_, "id long", batch=2, wait=0), to, check, once=False)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    put(0, 50)
    run()
    assert len(sink.listed(to)) == 3
    put(50, 72)
    run()
    run()
    got = sink.committed(spark, to, "id long")
    assert sorted(r.id for r in got.collect()) == list(range(72)) and got.where("batch >= 3").count() == 22


FAULTS = ["_write", "_prepare", "_rename"]


@pytest.mark.parametrize("when", ["before", "after"])
@pytest.mark.parametrize("step", FAULTS)
def test_a_fault_leaves_the_old_rows_or_the_new(spark, monkeypatch, step, when):
    path = scratch.folder(spark, "place")
    versions.write_all_or_nothing(spark.range(3), path)
    real = getattr(versions.Place, step)

    def broken(self, *args):
        if when == "after":
            real(self, *args)
        raise OSError("fault")

    with monkeypatch.context() as m:
        m.setattr(versions.Place, step, broken)
        with pytest.raises(OSError, match="fault"):
            versions.write_all_or_nothing(spark.range(5), path)
    assert versions.read_whole(spark, path).count() == (5 if (step, when) == ("_rename", "after") else 3)
    versions.write_all_or_nothing(spark.range(7), path)
    assert versions.read_whole(spark, path).count() == 7


def test_versions(spark):
    place = versions.Place(spark, scratch.folder(spark, "place"))
    with pytest.raises(FileNotFoundError):
        place.read("a")
    assert place.commit({"a": spark.range(1), "b": spark.range(2)}) == 1
    assert place.commit({"a": spark.range(3)}, follows=1) == 2
    with pytest.raises(versions.Conflict):
        place.commit({"a": spark.range(4)}, follows=1)
    assert [place.read(t, v).count() for t, v in (("a", 1), ("a", 2), ("b", 2))] == [1, 3, 2]
    # two writers at once: the entry that comes second is put behind the first
    entry = place._prepare({"a": "x"})
    assert not place._rename(entry, 2)
    place.vacuum()
    assert place.versions() == [2] and place.read("a").count() == 3 and place.read("b").count() == 2
    assert json.dumps(place.folders()).count("/") == 2
