"""Whole pipeline on planted rows; names with dots; rows without ids; damaged archives."""

import random

import pyarrow.parquet as pq
import pyarrow as pa

from lattica.llm import common, decontaminate, secret_scan, suffix_dedup, warc_fixity


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(i, "token = abc123xyz" if i == 1 else f"text {i}", "x", "y") for i in range(4)], ["doc_id", "text", "a.b", "c`d"])
    bench = spark.createDataFrame([(0, "text 2")], "item_id long, text string")
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()}[1] == "[SECRET]"
    out = decontaminate.clean(docs, bench)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {0, 1, 3} and out.first()["a.b"] == "x"


def test_rows_without_id_have_parts_of_their_own(spark):
    docs = spark.createDataFrame([(None, f"row {i} " * 20) for i in range(300)], "doc_id long, text string")
    got = suffix_dedup.remove(docs).collect()
    assert len(got) == 300 and all(r.n_removed == 0 for r in got)


def test_buckets_grow_with_the_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    assert common.buckets_for(docs, 1 << 16) > common.buckets_for(docs) >= 2 * common.partitions(spark)
    assert common.buckets_for(spark.createDataFrame([(1,)], "x long").rdd.toDF()) >= 2


def test_damaged_archives(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(6)], "page_id long, url string, html string")
    whole = bytes(warc_fixity.archives(pages, 64).first().content)
    records = [(s, e) for s, e, h, _ in warc_fixity.split_records(whole)]
    assert len(records) == 6 and records[-1][1] == len(whole)
    (s, e), last = records[2], records[-1]
    broken = whole[:s] + b"XX" + whole[s + 2 : last[1] - 7]
    (tmp_path / "a.warc").write_bytes(broken)
    got = sorted((r.start, r.end, r.damaged) for r in warc_fixity.read_warc(spark, str(tmp_path)).collect())
    assert [x[:2] for x in got if not x[2]] == records[:2] + records[3:5] and [x[:2] for x in got if x[2]] == [(s, e), (last[0], len(broken))]
    assert got[0][0] == 0 and all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_pipeline_on_planted_rows(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [prose(30) for _ in range(3)]
    rows = [(i, prose(80)) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[1][1].replace(rows[1][1].split()[40], "edited", 1))]  # copies
    rows += [(200, prose(20) + " " + items[0] + " " + prose(20))]  # a leak
    rows += [(300, prose(40) + " password = hunter2hunter2 " + prose(40))]  # a secret
    rows += [(400, "too short"), (401, (prose(10) + " ") * 20), (402, None), (403, "")]  # rejected
    table = lambda names, rows, kinds: pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows), kinds)})
    docs = [(d, t, "en", f"s{d % 2}", len(t or "")) for d, t in rows]
    pq.write_table(table(("doc_id", "text", "lang", "source", "n_chars"), docs, (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64())), tmp_path / "documents.parquet")
    pq.write_table(table(("doc_id", "quality", "toxic"), [(0, 1, 0)], (pa.int64(), pa.int32(), pa.int32())), tmp_path / "labels.parquet")
    pq.write_table(table(("item_id", "text"), list(enumerate(items)), (pa.int64(), pa.string())), tmp_path / "benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {x.doc_id for x in out}
    assert not ids & {100, 101, 200, 400, 401, 402, 403} and ids <= {*range(60), 300}
    # two sources of about equal size at weights 3 and 1: of the one nearly all twice, of the other less than all
    text = dict(rows)
    for x in out:
        if x.doc_id == 300:
            assert "hunter2" not in x.text and "[SECRET]" in x.text and x.n_chars == len(x.text)
        else:
            assert x.text == text[x.doc_id]
    words = {s: sum(len(x.text.split()) for x in out if x.source == s) for s in ("s0", "s1")}
    size = {s: sum(len(t.split()) for d, t in rows if f"s{d % 2}" == s and (d < 60 or d == 300)) for s in words}
    total = 1.5 * sum(size.values())
    want = {"s0": min(2 * size["s0"], total * 0.75), "s1": total - min(2 * size["s0"], total * 0.75)}
    assert all(abs(words[s] - want[s]) <= 90 for s in want)
    # an empty table goes through
    pq.write_table(pq.read_table(tmp_path / "documents.parquet").slice(0, 0), tmp_path / "documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
