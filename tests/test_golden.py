"""Values worked out by hand."""

from pyspark.sql import functions as F

from lattica.functions import calculator as K
from lattica.functions import columns as C
from lattica.operators import relational as R
from lattica.plans import query as Q
from lattica.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_calculator():
    assert abs(K.evaluate("4 + 3.65 - 2 / 2") - 6.65) < 1e-9
    assert abs(K.evaluate("23 / 12 - 223 + 5.25 * 4 * 3423") - 71661.91666666667) < 1e-6
    assert abs(K.evaluate("8 / 4 * ( 3 - 2.45 * ( 4 - 2 ^ 3 ) ) + 3") - 28.6) < 1e-9
    assert K.evaluate("7 ^ 2 ^ 3") == 117649.0
    assert [K.evaluate(x) for x in ("4 + + 3 + 2", "4  3 + 2", "( 3.5 ) ( 15 )", "", None, "1 / 0")] == [None] * 6
    assert " ".join(K.postfix("2 * ( ( 5 + -3 ) ^ 2 + ( 1 + 4 ) )")) == "2.0 5.0 -3.0 + 2.0 ^ 1.0 4.0 + + *"
    assert K.run("x1 = 5;x2 = 7 * ( x1 - 1 );x1 = x2 - x1;return x2 + x1 ^ 3") == (12195.0, {"x1": 23.0, "x2": 28.0})
    assert K.run("A = 1;B = A + 9;2C = A + B") == (None, {})


def test_columns(spark):
    lit = F.lit
    assert one(spark, C.additive_hash(lit("key1"))) == 378 and one(spark, C.weighted_hash(lit("key1"))) == 868
    assert [one(spark, C.is_number(lit(x))) for x in (" 2.560 ", "7 56", "2.56p")] == [True, False, False]
    assert [one(spark, C.is_identifier(lit(x))) for x in ("volume", "4volume", "volume2", "vol%2")] == [True, False, True, False]
    a = F.array(*[lit(x) for x in (100, 5, 10, 15, 20, 25)])
    assert one(spark, C.fold(a, lambda x, y: F.floor(x / 5).cast("int") + y * y)) == 714
    assert one(spark, C.fold(F.array().cast("array<int>"), lambda x, y: x + y)) is None
    b = F.array(*[lit(x) for x in range(10, 17)])
    assert one(spark, C.slice_at(b, 2, 3)) == [12, 13, 14] and one(spark, C.slice_at(b, 0, 8)) is None and one(spark, C.slice_at(b, 5, 0)) == []
    assert one(spark, C.replicate(F.array(lit(-7.5), lit(1.0), lit(3.0)))) == [-7.5, -7.5, 1.0, 3.0, 3.0, 3.0]
    assert one(spark, C.wrap(lit("aa bb ccccccc d"), 5)) == ["aa bb", "ccccccc", "d"]
    assert one(spark, C.usd(lit(-1234.5))) == "-$1,234.50" and one(spark, C.phone(lit("(11) 9-9"))) == "+551199"
    assert one(spark, C.breadcrumb(lit("a/b/c/d"))) == "b, c" and one(spark, C.slug(lit(" Men's Shoes "))) == "men-s-shoes"
    assert one(spark, C.query_string(F.create_map(lit("a"), lit("x y")))) == "a=x+y"
    assert one(spark, C.json_or_text(lit("user: bob"), "name", "user:")) == "bob"


def test_images(spark):
    lit = lambda v: F.array(*[lit(x) for x in v]) if isinstance(v, list) else F.lit(v)
    assert one(spark, C.gray(lit([[[100, 180, 240]]]))) == [[163]]
    assert one(spark, C.gray(lit([[[200, 0, 14], [15, 6, 50]]]))) == [[61, 14]]
    assert one(spark, C.convolve(lit([[0, 128, 255]]), [[1 / 9] * 3] * 3)) == [[14, 128, 241]]
    image = lit([[0, 64], [128, 255]])
    assert [one(spark, C.bilinear(image, F.lit(y), F.lit(x))) for y, x in ((0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (0.5, 1.0))] == [0, 255, 112, 160]
    grid = lit([[1, 2, 3], [4, 5, 6]])
    assert one(spark, C.rotate(grid, "R")) == [[4, 1], [5, 2], [6, 3]] and one(spark, C.rotate(grid, "L")) == [[3, 6], [2, 5], [1, 4]]
    pixels = lit([[[1, 2, 3], [4, 5, 6]]])
    assert one(spark, C.combine(C.channels(pixels))) == [[[1, 2, 3], [4, 5, 6]]]


def test_relational(spark):
    words = spark.createDataFrame(list(enumerate(["mom", "omm", "mmo", "sat", "kind", "ats"])), "pos int, word string")
    assert {r.key: r.words for r in R.anagrams(words, "word", "pos").collect()} == {"mmo": ["mom", "omm", "mmo"], "ast": ["sat", "ats"], "dikn": ["kind"]}
    names = spark.createDataFrame([(x,) for x in "Arch Manjaro Manjaro Mint Mint Mint Ubuntu Ubuntu Ubuntu".split()], "x string")
    assert {tuple(r) for r in R.modes(names, "x").collect()} == {("Mint", 3), ("Ubuntu", 3)}
    assert R.same_set(words, words) and R.subset(words.limit(1), words)


def test_pages(spark):
    df = spark.range(120).withColumn("name", F.concat(F.lit("n"), F.col("id")))
    p = Q.page(df, {"id": {"gte": 10}, "page": "3", "limit": "20", "sort": "-id", "fields": "id"})
    assert p.results == 110 and p.meta() == {"currentPage": 3, "limit": 20, "numberOfPages": 6, "nextPage": 4, "prevPage": 2}
    assert [r.id for r in p.data.collect()] == list(range(79, 59, -1))
    assert Q.page(df, {"keyword": "N1$"}, ["name"], default_sort="id").envelope()["data"] == [{"id": 1, "name": "n1"}]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CNAME,t1,prox.,\nA,h,1.2.3.4,60\n")
    assert [tuple(r) for r in files.delimited(spark, str(tmp_path / "a.csv"), "type string,host string,value string,ttl string").collect()] == [("CNAME", "t1", "prox.", ""), ("A", "h", "1.2.3.4", "60")]
    (tmp_path / "w.txt").write_text("a b\n\n  c \n")
    assert [r.word for r in files.words(spark, str(tmp_path / "w.txt")).collect()] == ["a", "b", "c"]
    (tmp_path / "k.json").write_text('{"p": {"price": 2.5}, "q": {"price": null}}')
    assert {tuple(r) for r in files.keyed_json(spark, str(tmp_path / "k.json"), "price:double").collect()} == {("p", 2.5), ("q", None)}
    assert files.seen(spark, str(tmp_path / "none"), "Link").count() == 0
