"""Importance resampling, hard negatives and token-id files against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import hard_negatives, importance, queries, token_ids
from lattica.llm.common import flat

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
DATA = "/root/testdata/sf0.001"


# importance resampling
def grams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(docs, bench):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, x in docs:
        for f in grams(x)[1]:
            s[bucket(f)] += 1
    for x in bench:
        for f in grams(x)[1]:
            t[bucket(f)] += 1
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10000) / ((s[b] + 1) * (t.sum() + 10000))))
    rows = []
    for d, x in docs:
        n, f = grams(x)
        w = sum(gain(bucket(y)) for y in f)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    return rows, drawn


def test_importance(spark):
    rng = random.Random(3)
    vocabulary = ["The", "the", "a", "été", "x1", "longword" * 9, "z" * 70, "日本", "Of"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocabulary, k=n))
    docs = [(i, text(rng.choice([0, 1, 2, 5, 25, 60]))) for i in range(150)]
    docs += [(7, docs[7][1]), (7, text(30)), (None, text(40)), (None, None), (500, None), (501, ""), (502, "the " * 70_000), (503, text(40)), (504, None)]
    docs += [(600 + i, "same words as before " * 6) for i in range(300)]
    bench = [text(9) for _ in range(20)] + [None, "", "same words as before"]
    table = spark.createDataFrame([(d, x, 1, "s") for d, x in docs], "doc_id long, text string, bucket int, `weight` string").repartition(5)
    target = spark.createDataFrame([(i, x) for i, x in enumerate(bench)], "item_id long, text string")
    got = importance.resample(table, target).collect()
    rows, drawn = plain_resample(docs, bench)
    key = lambda r: str(r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=key) == sorted((r[:4] for r in rows), key=key)
    assert [(r.doc_id, r.score) for r in sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])] == [(r[0], r[3]) for r in drawn]
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_importance_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    assert [(r.doc_id, r.n_features, r["rank"]) for r in importance.resample(docs, none).collect()] == [(1, 6, None)]


@given(st.binary(max_size=40), st.binary(max_size=90))
@settings(max_examples=60, deadline=None)
def test_crc_of_joined_texts(a, b):
    one = np.array([zlib.crc32(a)], dtype=np.uint32)
    assert int(importance.after(one, np.array([len(b)]))[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


# hard negatives
def plain_negatives(rows, least=30, most=90):
    sound = [(v, l, [math.floor(256 * x) for x in e]) for v, l, e in rows if v is not None and l is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    long = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for i, (v, l, e) in enumerate(sound):
        if v % 100:
            continue
        scores = [(-long(sum(x * y for x, y in zip(e, f))), w, j, m) for j, (w, m, f) in enumerate(sound) if j != i]
        for s, p, _, _ in sorted(x for x in scores if x[3] == l)[:5]:
            window = sorted(x for x in scores if x[3] != l and least * -s <= 100 * -x[0] <= most * -s)[:10]
            out += [(v, p, k, x[1], -s, -x[0]) for k, x in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e3])
def test_hard_negatives(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), [float(x) for x in np.float32(scale * (rng.normal(size=6) + (0.5 if i % 2 else 0)))]) for i in range(600)]
    rows += [(700 + i, 1 if i < 40 else 2, [0.5 * scale] * 6) for i in range(400)]  # copies, with equal scores
    rows += [(1100, None, [1.0] * 6), (1200, 1, None), (1300, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1400, 1, [float("nan")] * 6), (1500, 1, [float("inf")] * 6), (1600, 1, []), (1700, 1, [1.0]), (None, 1, [1.0] * 6), (100, 1, [0.25] * 6), (100, 1, [0.25] * 6)]
    table = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, label int, embedding array<double>, row int").repartition(7)
    got = hard_negatives.mine(table, group_rows=150, sample_rows=200)
    assert sorted(tuple(r) for r in got.collect()) == plain_negatives(rows)
    assert hard_negatives.mine(table.limit(0)).count() == 0


def test_hard_negatives_beyond_long(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), int(i % 2), [float(x) for x in rng.normal(size=4) * (1e12 if i % 3 else 1e5)]) for i in range(0, 300, 5)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert sorted(tuple(r) for r in hard_negatives.mine(table).collect()) == plain_negatives(rows)


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = np.floor(256 * rng.normal(size=(500, 8)))
    books = hard_negatives.codebooks(v[:300], 2)
    codes, left = hard_negatives.quantise(v, books)
    score, off = hard_negatives.bounds(v[:50], codes, left, books, np.sqrt((v**2).sum(axis=1)))
    assert (np.abs(score - v[:50] @ v.T) <= off).all() and off.mean() < 0.3 * np.abs(v[:50] @ v.T).mean()


# token ids
@given(st.lists(st.one_of(st.integers(0, 60_000), st.sampled_from([0, 1, 2**32 - 1])), max_size=700), st.sampled_from([8, 128, 256]), st.sampled_from([0.0, 0.5, 0.95, 1.0]), st.data())
@settings(max_examples=80, deadline=None)
def test_file_round_trip(ids, block, quantile, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(ids)), max_size=4)))
    starts = np.array([0, *cuts, len(ids)])
    content = token_ids.encode(np.array(ids, dtype=np.uint32), [None, *range(len(cuts))], starts, 3, block, quantile)
    f = token_ids.IdFile(content + b"\n")
    assert f.ids().tolist() == ids and f.part == 3 and f.known.tolist() == [0] + [1] * len(cuts)
    assert [x for k in range(f.n_docs) for x in f.document(k).tolist()] == ids
    a, b = sorted(data.draw(st.tuples(st.integers(0, len(ids)), st.integers(0, len(ids)))))
    assert f.ids(a, b).tolist() == ids[a:b]


ODD = ["It's 'tis they'RE don'", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "<|endoftext|>x", "É éa̸ ≮ ≠x", "a b　c d", "ΑΣ Σ", "x" * 3000, "3a4, b'c-'s -'s '-s", "İstanbul ßẞ", "\x00a\x1fb\x7fc a\x85b", "한국 각 日本語", "é", ",́a", "A,B.C;D", "\t\n\r\x0b\x0c ", "don’t", "aﬁb", "🙂🙂a.", "a" + "." * 500 + "b"]


@given(st.lists(st.sampled_from([*ODD, *"aB1'.,<|>- \n", "'s", "'RE", "́", "É"]), max_size=12))
@settings(max_examples=150, deadline=None)
def test_pieces_are_encoded_as_texts(parts):
    check(["".join(parts), " ".join(parts), ""])


def check(texts):
    with open(WORD_BPE, encoding="utf-8") as f:
        encoder = token_ids.Encoder(f.read(), True)
    plain = Tokenizer.from_file(WORD_BPE)
    column = pa.array(texts, pa.string())
    for t in flat(column):
        ids, count = encoder(t, column.slice(t.first, len(t)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [plain.encode(x or "", add_special_tokens=False).ids for x in texts[t.first : t.last]]


def test_odd_texts_are_encoded_whole():
    check([*ODD, None, "", *ODD])


def plain_digest(rows):
    tokenizer, out, before = Tokenizer.from_file(WORD_BPE), [], 0
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 1]
        out.append((d, before, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        before += len(ids)
    return out


def test_token_ids_of_whole_tables(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_token_ids(spark, DATA).collect()) == sorted(plain_digest(rows))


def test_token_ids_of_odd_rows(spark, tmp_path):
    rows = [(i, ODD[i % len(ODD)]) for i in range(-20, 60)] + [(100, None), (101, ""), (102, "long text, " * 40_000), (None, "no id"), (None, None)] + [(200, "copy")] * 300
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, part int").repartition(6)
    for by_pieces in (True, False):
        at = str(tmp_path / f"ids-{by_pieces}")
        token_ids.write(docs, at, WORD_BPE, by_pieces=by_pieces)
        got = token_ids.digest(spark, at).collect()
        want = plain_digest(rows)
        named = lambda x: sorted(r for r in x if r[0] is not None)
        assert named(tuple(r) for r in got) == named(want) and sorted(r[2:] for r in map(tuple, got) if r[0] is None) == sorted(r[2:] for r in want if r[0] is None)
    ids = {r.doc_id: r.ids for r in token_ids.read(spark, at).where("doc_id between 100 and 102").collect()}
    assert ids[100] == ids[101] == [1] and len(ids[102]) > 100_000
    assert {r.doc_id: r.ids for r in token_ids.some(spark, at, 101, 102).collect()} == {k: ids[k] for k in (101, 102)}
    empty = str(tmp_path / "none")
    token_ids.write(docs.limit(0), empty, WORD_BPE)
    assert token_ids.digest(spark, empty).count() == 0 and token_ids.read(spark, empty).count() == 0


def test_extra_columns_of_embeddings(spark):
    t = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = sorted(map(tuple, hard_negatives.mine(t).collect()))
    assert want and sorted(map(tuple, hard_negatives.mine(t.withColumns({"row": F.lit(1), "at": F.lit("x"), "scores": F.lit(0)})).collect())) == want
