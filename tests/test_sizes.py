"""What shows on larger or odd tables alone."""

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from lattica.functions import markup
from lattica.sources import media, pages, scratch
from lattica.streaming import sink, state


@pytest.mark.parametrize("name", ["i01_channels", "i05_box_blur", "i06_bilinear", "s20_image_round_trip"])
def test_pixels_are_cut_as_floats(spark, tmp_path, name):
    """Values whose product by 1000 is a whole number as a float and a little less as a double."""
    x = np.arange(1, 2000, dtype=np.float32) / np.float32(1000)
    odd = x[np.floor(x * np.float32(1000)) != np.floor(x.astype(float) * 1000)]
    assert len(odd) > 100
    rows = np.resize(odd, (40, 16))
    pq.write_table(pa.table({"vec_id": list(range(40)), "embedding": pa.array(rows.tolist(), pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = duck.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[n] for n in names) for r in queries()[name](spark, str(tmp_path)).collect()) == sorted(want.fetchall())


def test_a_mailbox_is_read_in_splits(spark, tmp_path):
    letter = lambda i: f"From a Thu Jan  1 00:00:00 2024\nMessage-ID: <{i}@x>\nSubject: {i}\n\n" + "word\n" * (i % 50) + f">From me\n>>From you {i}\n"
    (tmp_path / "a.mbox").write_text("no message\n" + "".join(map(letter, range(300))))
    (tmp_path / "b.mbox").write_text("".join(map(letter, range(300, 600))))
    (tmp_path / "c.mbox").write_text("no message at all\n")
    want = {(f"<{i}@x>", str(i), "word\n" * (i % 50) + f"From me\n>From you {i}") for i in range(600)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "5000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = media.mailbox(spark, str(tmp_path))
            rows = got.collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(rows) == 600 and {(r.message_id, r.subject, r.body) for r in rows} == want
    assert got.rdd.getNumPartitions() > 10


def test_elements_of_few_pages_are_held_at_once(spark, monkeypatch):
    df, taken = spark.createDataFrame([], "id long, html string"), []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: taken.append(f))
    markup.cells(df, "li")
    html = [f"<li>{i}" if i % 7 else None for i in range(1050)]
    pages = pa.RecordBatch.from_pydict({"id": list(range(1050)), "html": html, "x": html})
    out = list(taken[0](iter([pages])))
    assert max(b.num_rows for b in out) <= 100
    assert [(r["id"], [c["text"] for c in r["cells"]]) for b in out for r in b.to_pylist()] == [(i, [str(i)] if i % 7 else []) for i in range(1050)]


def test_pages_are_counted_once(spark, tmp_path, monkeypatch):
    asked = []
    real = pages.Endpoint._at
    monkeypatch.setattr(pages.Endpoint, "_at", lambda self, start, page: asked.append(page) or real(self, start, page))
    for i in range(60):
        (tmp_path / f"page={i}").mkdir()
    e = pages.Endpoint({"address": str(tmp_path)})
    assert [e.known(i) for i in range(60)] == [60] * 60 and e.known(70) == 70 and e.known(3) == 60
    (tmp_path / "page=60").mkdir()
    assert e.known(0) == 61 and len(asked) < 200


def test_refused_pages_are_asked_for_again(spark):
    at = scratch.folder(spark, "pages")
    pages.write_pages(spark.range(95), at, F.floor(F.col("id") / 10).cast("int"), ["id"])
    assert sorted(r.id for r in pages.read(spark, at, "id long", pages=10, tries=3, wait=0, failures=2).collect()) == list(range(95))
    with pytest.raises(Exception, match="503"):
        pages.read(spark, at, "id long", pages=10, tries=2, wait=0, failures=2).collect()


def test_retries_pass_no_page_through_the_driver(spark, monkeypatch):
    monkeypatch.setattr(pages, "served", None)
    assert queries()["t15_retries"](spark, "/root/testdata/sf0.001").count() == 50


def test_batches_of_a_page_stream_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(2000).selectExpr("id page_id", "concat('u', id) url", "'ab' html").write.parquet(str(tmp_path / "pages.parquet"))
    folders, real = [], scratch.folder
    monkeypatch.setattr(scratch, "folder", lambda spark, name: folders.append(real(spark, name)) or folders[-1])
    got = queries()["s15_page_stream"](spark, str(tmp_path))
    assert sorted(r.page_id for r in got.collect()) == list(range(2000))
    assert len(sink.listed(folders[1])) < 30 and sink.listed(folders[1])[0]["rows"] == 60


def test_reviews_send_few_messages():
    calls = []

    class Fake:
        def __init__(self):
            self.held = {}

        def __getattr__(self, name):
            act = {"exists": lambda: bool(self.held), "get": lambda: self.held.get(0), "update": lambda v: self.held.update({0: v}), "containsKey": lambda k: k in self.held, "getValue": self.held.get, "updateValue": lambda k, v: self.held.update({k: v}), "removeKey": self.held.pop}[name]
            return lambda *a: calls.append(name) or act(*a)

    class Handle:
        getMapState = getValueState = lambda self, *a: Fake()

    p = state.Reviews()
    p.init(Handle())
    run = lambda ratings: list(p.handleInputRows((1,), iter([pd.DataFrame({"review": list("abcde"), "seq": range(5), "rating": ratings})]), None))[0].values.tolist()[0]
    assert run([1.0, 2.0, 3.0, 4.0, None]) == [1, 10, 4] and len(calls) <= 6
    calls.clear()
    assert run([5.0, None, 3.0, 4.0, 1.0]) == [1, 13, 4] and len(calls) <= 13
