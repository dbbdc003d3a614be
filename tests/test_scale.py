"""Prefix scans, the sweep join, the automaton and deep pages against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.operators import automaton, keyed, relational, scan, sweep
from lattica.plans import paging


def table(spark, seed, n=400, parts=5):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(12)]) if seed % 2 else i, rng.choice([None, None, "a", "b", "b"]), i, rng.choice([None, 1.5, 2.5, float(rng.randint(0, 50))])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "o int, v string, id int, x double").repartition(parts)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


@pytest.mark.parametrize("seed", [1, 2])
def test_scans_over_the_table(spark, seed):
    rows, df = table(spark, seed)
    rows = in_order(rows)
    want, seen = {}, None
    for r in rows:
        seen = r[1] if r[1] is not None else seen
        want[r[2]] = seen
    got = {r.id: r.c for r in scan.carried(df, ["o", "id"], "v", "c").collect()}
    assert got == want
    first = next(r[1] for r in rows if r[1] is not None)
    assert {r.id: r.v for r in relational.fill_forward(df, [], ["o", "id"], "v").collect()} == {k: first if v is None else v for k, v in want.items()}
    lengths = []
    for r in rows:
        if lengths and lengths[-1][0] == r[1]:
            lengths[-1][1] += 1
        else:
            lengths.append([r[1], 1])
    got = sorted((r.run, r.v, r.length) for r in relational.runs(df, [], ["o", "id"], "v").collect())
    assert got == [(i, v, n) for i, (v, n) in enumerate(lengths, 1)]
    top, above = None, []
    for r in rows:
        if top is None or (r[3] is not None and r[3] > top):
            above.append(r[2])
        top = r[3] if top is None else max(top, r[3]) if r[3] is not None else top
    assert sorted(r.id for r in relational.above_high_water(df, [], ["o", "id"], "x").collect()) == sorted(above)
    ok = F.col("id") % 97 != 96
    bad = next(i for i, r in enumerate(rows) if r[2] % 97 == 96)
    assert sorted(r.id for r in relational.take_while(df, [], ["o", "id"], ok).collect()) == sorted(r[2] for r in rows[:bad])
    assert relational.take_while(df, [], ["o", "id"], F.lit(True)).count() == len(rows)
    assert [r.n for r in scan.numbered(df, ["o", "id"], "n", 0).orderBy("n").collect()] == list(range(len(rows)))
    empty = df.limit(0)
    assert scan.runs(empty, ["o"], "v").count() == scan.fill_forward(empty, ["o"], "v").count() == scan.above_high_water(empty, ["o"], "x").count() == 0


def test_no_single_task_for_a_frequent_value(spark):
    df = spark.range(4000).select(F.lit(1).alias("o"), "id", F.lit("v").alias("v"))
    rows, part, _ = scan.ranged(df, ["o"])
    sizes = [r["count"] for r in rows.groupBy(part).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2000
    assert [(r.run, r.length) for r in scan.runs(df, ["o"], "v").collect()] == [(1, 4000)]


@given(st.integers(1, 60), st.data())
@settings(max_examples=100, deadline=None)
def test_least_updates(size, data):
    ups = data.draw(st.lists(st.tuples(st.integers(0, size - 1), st.integers(0, size - 1), st.integers(0, 9)), max_size=12))
    want = np.full(size, np.iinfo(np.int64).max)
    level, start, value = [], [], []
    for a, b, p in ups:
        a, b = min(a, b), max(a, b)
        want[a : b + 1] = np.minimum(want[a : b + 1], p)
        k = (b - a + 1).bit_length() - 1
        for s in (a, b - (1 << k) + 1):
            level.append(k), start.append(s), value.append(p)
    got = sweep.passed_down(size, *(np.array(x, dtype=np.int64) for x in (level, start, value)))
    assert (got == want).all()


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_bands_of_any_width(spark, monkeypatch, block):
    monkeypatch.setattr(sweep, "BLOCK", block)
    rng = random.Random(block)
    tiers = [(i, lo := float(rng.randint(-50, 100)), lo + rng.choice([-1.0, 0.0, 1.0, 7.0, 1e3, 1e9]), rng.randint(0, 5)) for i in range(60)]
    tiers += [(100, None, 5.0, 0), (101, 5.0, None, 0), (102, 0.0, 0.0, 9)]
    rows = [(i, rng.choice([None, float(rng.randint(-60, 130)), rng.uniform(-60, 130), 5e8])) for i in range(300)] + [(1000 + i, 3.0) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(4)
    table = spark.createDataFrame([(p, lo, hi, i) for i, lo, hi, p in tiers], "pos int, lo double, hi double, tier int")
    got = {r.k: (r.pos, r.tier) for r in relational.band_join(df, "v", table, "lo", "hi", "pos").collect()}
    want = {}
    for k, v in rows:
        hits = [(p, i) for i, lo, hi, p in tiers if None not in (v, lo, hi) and lo <= v <= hi]
        if hits:
            want[k] = min(hits)[0]
    assert {k: p for k, (p, _) in got.items()} == want
    of = {i: (lo, hi) for i, lo, hi, _ in tiers}
    assert all(of[i][0] <= dict(rows)[k] <= of[i][1] for k, (_, i) in got.items())


@given(st.lists(st.text("abé", min_size=1, max_size=5), max_size=8, unique=True), st.lists(st.one_of(st.none(), st.text("abé", max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_automaton(words, texts):
    rows, which = automaton.Automaton([w.encode() for w in words]).find(pa.array(texts, pa.string()))
    assert set(zip(rows.tolist(), which.tolist())) == {(i, j) for i, t in enumerate(texts) for j, w in enumerate(words) if t and w in t} and len(set(zip(rows.tolist(), which.tolist()))) == len(rows)


def test_words_of_any_length(spark):
    long = "".join(random.Random(1).choices("abc", k=3000))
    texts = ["go home", "a", "", None, "x" * 700 + "go" + "y" * 700, long + "zz", "été", "h"] + ["go go"] * 50
    words = ["go", "o", "home", "", "é", "t", None, long, "go", "nothing", long[5:2500]]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, t string, x int")
    table = spark.createDataFrame([(w,) for w in words], "w string")
    want = sorted((i, w) for i, t in enumerate(texts) for w in {w for w in words if w is not None} if t is not None and w in t)
    for most in (1 << 20, 64):
        got = keyed.containing(df, "t", table, "w", most)
        assert got.columns == ["id", "t", "x", "w"] and sorted((r.id, r.w) for r in got.collect()) == want
    assert keyed.containing(df, "t", table.where("false"), "w").count() == 0


@pytest.mark.parametrize("spec", ["o,-id", "-o,id", "-x,v,id", "v,-x,id"])
def test_pages_of_any_depth(spark, spec):
    rows, df = table(spark, 1, 3000)
    every = [tuple(r) for r in paging.ordered(df, spec).collect()]
    for offset in (0, 7, 1500, 2990, 5000):
        assert [tuple(r) for r in paging.rows_at(df, spec, offset, 20, most=100, buckets=8, sample=500).collect()] == every[offset : offset + 20]
    at, page = None, []
    for i in range(4):
        last = dict(zip(df.columns, every[1500 - 1 + 20 * i]))
        assert [tuple(r) for r in paging.rows_after(df, spec, last, 20).collect()] == every[1500 + 20 * i : 1520 + 20 * i]


def test_helper_names_do_not_clash(spark):
    a = spark.createDataFrame([(1, 2, 3, 4)], "__k int, __n int, x int, xr int")
    b = spark.createDataFrame([(2, 5, 6)], "__n int, __k int, v int")
    assert relational.populate(a, b, "__n", "__n", ["v"]).collect()[0].v == 6
    assert relational.last_wins(a, "x", "__k").columns == a.columns
    assert relational.children(a, b, "__n", "__n", ["v"], "kids").collect()[0].kids[0].v == 6
    assert relational.increment(a, b, "__n", "__n", "v", "x", "xr").collect()[0][2:] == (-3, 10)
    text = spark.createDataFrame([(1, "a", True), (1, "c", True), (1, "d", False), (2, "b", None), (2, "a", False)], "k int, o string, m boolean")
    assert sorted((r.k, r.o) for r in relational.first_or_last_marked(text, "k", "o", F.col("m")).collect()) == [(1, "c"), (2, "a")]


def test_tree_of_a_million_values():
    from time import process_time

    from lattica.functions import sequential as S

    values = np.random.default_rng(1).permutation(1_000_000).tolist()
    began = process_time()
    assert 40 < S.height(values) < 70 and process_time() - began < 10
    assert S.height(list(range(5000))) == S.height([1] * 5000) == 4999 and S.height([]) == -1 and S.height(["b", "a", "c"]) == 1


@pytest.mark.parametrize("whole", [True, False])
def test_patches_in_large_images(whole):
    from lattica.functions import sequential as S

    rng = np.random.default_rng(2)
    for (h, w), (ph, pw), tile in (((512, 512), (24, 40), 128), ((9, 300), (3, 2), 16), ((5, 5), (5, 5), 512), ((40, 30), (1, 1), 8)):
        image = rng.integers(0, 256, (h, w)).astype(float) if whole else rng.normal(size=(h, w))
        y, x = (h - ph) * 2 // 3, (w - pw) // 2
        patch = image[y : y + ph, x : x + pw].copy()
        if whole and ph * pw > 1:
            patch[0, 0] += 3
        want = min((((image[i : i + ph, j : j + pw] - patch) ** 2).mean(), i, j) for i in range(h - ph + 1) for j in range(w - pw + 1)) if h * w < 3000 else (((image[y : y + ph, x : x + pw] - patch) ** 2).mean(), y, x)
        got = S.match(image, patch, tile)
        assert got[1:] == want[1:] and abs(got[0] - want[0]) < 1e-9
    assert S.match(np.full((300, 300), 7.0), np.full((4, 4), 5.0)) == (4.0, 0, 0)


@pytest.mark.parametrize(
    ("html", "tag", "want"),
    [
        ("<ul><li>a<ul><li>b<li>c</ul>d<li>e</ul>", "li", [(0, "abcd"), (1, "b"), (1, "c"), (0, "e")]),
        ("<table><tr><td>1<td><table><tr><td>2</table>3<tr><th>4</table>", "td", [(0, "1"), (0, "23"), (1, "2")]),
        ("<p>a<b>b<p>c<div>d</div>e", "p", [(0, "ab"), (0, "c")]),
        ("<LI title='a>b' x=\"</li>\">q</LI ><!-- <li>no --><script>'<li>'</script><li>r", "li", [(0, "q"), (0, "r")]),
        ("<li>1 < 2 &amp; 3<br>4</b></li><li", "li", [(0, "1 < 2 &amp; 34")]),
        ("<li>open <!-- never", "li", [(0, "open")]),
        ("<title>a<b></title><p>x", "title", [(0, "a<b>")]),
        ("", "li", []),
    ],
)
def test_elements(html, tag, want):
    from lattica.functions import markup

    assert markup.elements(html, tag) == want


def test_long_and_broken_pages_take_linear_time(spark):
    from time import process_time

    from lattica.functions import markup

    began = process_time()
    for html in ("<a" * 200_000, "<li>x" * 100_000, "<li>" + "<b>" * 50_000, "<a href='" * 100_000, "<!--" * 200_000, "a<" * 200_000, "<i>" * 50_000 + "</b>" * 50_000):
        markup.elements(html, "li")
    assert process_time() - began < 20
    df = spark.createDataFrame([(1, "<li>a</li>"), (2, None), (3, "")], "id int, html string")
    assert [(r.id, [c.text for c in r.cells]) for r in markup.cells(df, "LI").orderBy("id").collect()] == [(1, ["a"]), (2, []), (3, [])]
