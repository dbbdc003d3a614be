"""Sheets, paged scans, caches and sequential functions against plain versions."""

import random
import zipfile

from pyspark.sql import functions as F

from lattica.functions import sequential as S
from lattica.operators import relational as R
from lattica.plans import registry
from lattica.sources import paged, sheets
from lattica.streaming import cache


def book(path, rows):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    cell = lambda r, c, v: "" if v is None else f'<c r="{chr(65 + c)}{r}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{chr(65 + c)}{r}" t="inlineStr"><is><t>{v}</t></is></c>' if v[:1] != "$" else f'<c r="{chr(65 + c)}{r}" t="s"><v>0</v></c>'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(x)) + "</row>" for r, x in enumerate(rows, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>shared</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')


def test_sheets(spark, tmp_path):
    book(tmp_path / "a.xlsx", [["k", "v"], ["x", 1], [None, 2], ["y", "$"]])
    book(tmp_path / "b.xlsx", [["x", None], []])
    s = sheets.sheet(spark, str(tmp_path))
    assert {(r.file, r.row, r.value) for r in sheets.column(s, "B").collect()} == {("a.xlsx", 1, "v"), ("a.xlsx", 2, "1"), ("a.xlsx", 3, "2"), ("a.xlsx", 4, "shared"), ("b.xlsx", 1, "None"), ("b.xlsx", 2, "None")}
    assert {r["key"]: r["values"] for r in sheets.key_values(s, "A", "B").collect()} == {"k": ["v"], "x": ["1", "None"], "y": ["shared"]}
    assert {r["key"]: r["values"] for r in sheets.key_values(s, "A", "B", compat=True).collect()} == {"k": ["v"], "x": ["1", "None"], "y": ["2"]}
    assert sorted((r.p, r.q or "") for r in sheets.body(s, ["p", "q"]).where("p is not null").collect()) == [("x", "1"), ("y", "shared")]
    assert sheets.positional(s, 3).columns == ["file", "row", "_c0", "_c1", "_c2"] and sheets.sheet(spark, str(tmp_path), "Two").count() == 0
    assert [sheets.column_index(x) for x in ("A", "Z", "AA", "ab")] == [0, 25, 26, 27]


def test_paged(spark):
    assert sorted(r.x for r in paged.numbered(spark, 5, lambda p: [(10 * p + i,) for i in range(p)], "x long").collect()) == sorted(10 * p + i for p in range(1, 6) for i in range(p))
    assert paged.numbered(spark, None, lambda p: [(p,)], "x long").count() == 1

    def fetch(start, token):
        n = token or 0
        return [(start, 3 * n + i) for i in range(3)], n + 1 if n < 4 else None

    assert paged.followed(spark, ["a", "b"], fetch, "s string, x long").count() == 30
    assert sorted(r.x for r in paged.followed(spark, ["a"], fetch, "s string, x long", most=7).collect()) == list(range(7))
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return 5

    assert paged.retry(flaky, 3, 0) == 5
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "page long, nxt long")
    assert paged.linked(edges, 150, "page", "nxt").count() == 150


class Slow:
    """A list from the most recent to the least."""

    def __init__(self, most):
        self.most, self.list = most, []

    def step(self, op, cid, size, policy):
        own = [x for x in self.list if x[0] == cid]
        self.list = own + [x for x in self.list if x[0] != cid]
        free = self.most - sum(s for _, s in self.list)
        if op == "get":
            return "hit" if own else "miss"
        if op == "update":
            if not own or size > free + own[0][1]:
                return "miss"
            self.list[0] = (cid, size)
            return "updated"
        if own:
            return "present"
        if size > self.most:
            return "refused"
        while self.most - sum(s for _, s in self.list) < size:
            self.list.pop(-1 if policy == "lru" else 0)
        self.list.insert(0, (cid, size))
        return "inserted"


def test_cache(spark, tmp_path):
    rng = random.Random(3)
    ops = [(k, i, rng.choice(["put", "put", "get", "update"]), rng.randrange(12), rng.choice([None, 10, 60, 90, 250]), rng.choice(["lru", "mru"])) for k in range(3) for i in range(200)]
    want = {}
    for k in range(3):
        slow = Slow(200)
        for _, i, op, cid, size, policy in (o for o in ops if o[0] == k):
            want[k, i] = (slow.step(op, cid, size or 0, policy), 200 - sum(s for _, s in slow.list), len(slow.list))
    df = spark.createDataFrame(ops, "key long, seq long, op string, cid long, size long, policy string")
    assert {(r.key, r.seq): (r.outcome, r.remaining, r["items"]) for r in cache.simulate(df).collect()} == want
    for part in range(2):
        df.where(f"seq div 100 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {}
    files = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = cache.stream(files).writeStream.foreachBatch(lambda b, _: got.update({(r.key, r.seq): (r.outcome, r.remaining, r["items"]) for r in b.collect()})).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert got == want


def test_tree_height():
    def slow(values):
        tree, top = {}, -1
        for v in values:
            at, d = (), 0
            while at in tree:
                at, d = at + (v >= tree[at],), d + 1
            tree[at] = v
            top = max(top, d)
        return top

    rng = random.Random(1)
    for n in range(40):
        values = [rng.randrange(9) for _ in range(n)]
        assert S.height(values) == slow(values)


def test_chunks(spark):
    assert S.chunks(["a" * 600]) == ["", "a" * 600] and S.chunks([]) == []
    assert S.chunks(["one.", "", " two. ", "@T", "three."]) == ["one. two.", "@T", "three."]
    assert S.chunks(["a" * 250, "b" * 250]) == ["a" * 250 + " " + "b" * 250]
    assert S.chunks(["a" * 300, "b" * 250]) == ["a" * 300, "b" * 250]
    got = spark.createDataFrame([(["x.", None, "y."],), (None,)], "s array<string>").select(S.chunked(F.col("s")).alias("c")).collect()
    assert [r.c for r in got] == [["x. y."], None]


def test_images_and_templates(spark, tmp_path):
    df = spark.createDataFrame([([[0, 9, 1], [2, 7, 3]], [[9], [7]], [[1], [1], [1]])], "i array<array<int>>, p array<array<int>>, q array<array<int>>")
    r = df.select(S.best_match(F.col("i"), F.col("p")).alias("a"), S.best_match(F.col("i"), F.col("q")).alias("b"), S.resize(F.col("i"), 1, 2).alias("c")).first()
    assert tuple(r.a) == (0.0, 0, 1) and tuple(r.b) == (float("inf"), 0, 0) and r.c == [[0, 5]]
    names = spark.createDataFrame([("a", 1), ("b", None)], "n string, x int")
    S.write_documents(names, str(tmp_path / "d"), F.col("n"), S.render("{{n}}={{ x }}", {"n": F.col("n"), "x": F.col("x")}))
    assert {(r.name, r.value) for r in spark.read.text(str(tmp_path / "d")).collect()} == {("a", "a=1"), ("b", "b=")}


def test_queries_without_sql(spark):
    for name in set(registry.QUERIES) - set(registry.ORACLE):
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_bands_and_references_of_repeated_rows(spark):
    tiers = spark.createDataFrame([(1, 0.0, 10.0, "a"), (0, 5.0, 30.0, "b"), (2, 100.0, 100.0, "c")], "pos int, lo double, hi double, tier string")
    rows = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 7.0), (3, 10.0), (4, 50.0), (5, None), (6, 100.0)], "k int, v double")
    got = sorted((r.k, r.tier) for r in R.band_join(rows, "v", tiers, "lo", "hi", "pos").collect())
    assert got == [(1, "a"), (1, "a"), (2, "b"), (3, "b"), (6, "c")]
    assert R.band_join(rows, "v", tiers.where("false"), "lo", "hi", "pos").count() == 0
    names = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "id int, name string")
    refs = spark.createDataFrame([(1, [2, 1]), (1, [2, 1]), (1, [1, 9]), (2, []), (3, None), (None, [1])], "k int, ids array<int>")
    got = R.populate_array(refs, "ids", names, "id", "name", "names", "k")
    assert got.columns == ["k", "ids", "names"]
    assert sorted((str(r.k), r.names) for r in got.collect()) == [("1", ["x"]), ("1", ["y", "z", "x"]), ("1", ["y", "z", "x"]), ("2", []), ("3", []), ("None", ["x"])]
