"""Files, images, constraints and streams: what the queries' SQL cannot show."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import calculator as K
from lattica.functions import columns as C
from lattica.operators import constraints, keyed
from lattica.sources import files, media, scratch
from lattica.streaming import events as E


def filtered(image, kind):
    """A PNG with one filter for all lines, by the format's definition."""
    h, w = image.shape[:2]
    flat = image.reshape(h, -1).astype(int)
    c = flat.shape[1] // w
    out = b""
    for y in range(h):
        line = []
        for i in range(w * c):
            a, b, d = (flat[y, i - c] if i >= c else 0), (flat[y - 1, i] if y else 0), (flat[y - 1, i - c] if y and i >= c else 0)
            p = a + b - d
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            line.append((flat[y, i] - (0, a, b, (a + b) // 2, best)[kind]) % 256)
        out += bytes([kind, *line])
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_png():
    r = np.random.default_rng(1)
    for shape in ((5, 7), (4, 3, 3), (1, 1)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode(image)) == image).all()
        for kind in range(5):
            assert (media.decode(filtered(image, kind)) == image).all()
    assert (media.decode(b"P5\n# c\n2 1\n255\nab") == [[97, 98]]).all() and media.decode(b"x") is None and media.decode(None) is None


def test_images_from_files(spark):
    at = scratch.folder(spark, "images")
    rows = spark.createDataFrame([("a.png", [[1, 2], [3, 4]]), ("b.png", [[255]])], "name string, image array<array<int>>")
    media.write_files(rows.withColumn("content", media.png("image")), at, "name", "content")
    assert {r.path.rsplit("/", 1)[1]: r.image for r in media.images(spark, at).collect()} == {"a.png": [[1, 2], [3, 4]], "b.png": [[255]]}
    assert media.images(spark, at + "/b.png", "RGB").first().image == [[[255, 255, 255]]]


def test_kernels(spark):
    """A kernel that doesn't sum to 1 is divided by its sum."""
    x = spark.createDataFrame([([[10, 20], [30, 40]],)], "i array<array<int>>")
    assert x.select(C.convolve(F.col("i"), [[1] * 3] * 3).alias("o")).first().o == x.select(C.convolve(F.col("i"), [[1 / 9] * 3] * 3).alias("o")).first().o
    assert x.select(C.convolve(F.col("i"), [[0, 0, 0], [0, 4, 0], [0, 0, 0]]).alias("o")).first().o == [[10, 20], [30, 40]]


def test_failures(spark):
    x = spark.createDataFrame([(1, 2.0), (2, None)], "id long, v double")
    with pytest.raises(Exception, match="no id 3"):
        files.by_id(x, "id", 3).collect()
    with pytest.raises(Exception, match="v is null"):
        constraints.require(x, F.col("v") > 0, "v is null").collect()
    got = constraints.check(x, {"v": constraints.Rule(required=True), "id": constraints.Rule(most=1, unique=True)}).orderBy("id").collect()
    assert [r.errors for r in got] == [[], ["v is required", "id is more than 1"]]


def test_snapshots_of_a_program():
    assert K.snapshots("a = 2 ; a = 2 ; b = a + 1 ; return b") == [("a = 2", {"a": 2.0}), ("b = a + 1", {"a": 2.0, "b": 3.0}), ("return b", {"a": 2.0, "b": 3.0})]
    assert K.snapshots("a = 2 ; b = c ; d = 1") == [("a = 2", {"a": 2.0})] and K.snapshots(None) == []


def test_quota_and_numbers(spark):
    x = spark.range(500).withColumn("g", F.col("id") % 3)
    a = {r.id for r in keyed.quota_sample(x, F.col("g"), 7, 1, "id").collect()}
    assert len(a) == 21 and a == {r.id for r in keyed.quota_sample(x.repartition(7), F.col("g"), 7, 1, "id").collect()} != {r.id for r in keyed.quota_sample(x, F.col("g"), 7, 2, "id").collect()}
    assert [r.n for r in keyed.numbered(x, [F.desc("id")], "n").orderBy(F.desc("id")).collect()] == list(range(1, 501))
