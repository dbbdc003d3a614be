"""The Jaccard join: repeated ids, regions that are cut more than once, columns with clashing names."""

import random

import numpy as np
import pytest

from lattica.llm import jaccard_join, quality_rules
from test_operators import brute_components, key, linked, shingle_set


def texts(seed, n, bases=4, words=120, most=60):
    """Variants of a few texts, at all distances from them, so that regions are large and pivots part them badly."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    start = [[r.choice(vocabulary) for _ in range(words)] for _ in range(bases)]
    for i in range(1, bases):
        start[i][:words // 2] = start[0][: words // 2]
    out = []
    for i in range(n):
        t = list(r.choice(start))
        cut = r.randint(0, most)
        a = r.randrange(len(t) - cut + 1)
        t[a : a + cut] = [r.choice(vocabulary) for _ in range(cut)]
        out.append((i, " ".join(t)))
    return out


def compared(spark, rows):
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_components(rows), key=key)


def test_ids_with_several_texts(spark):
    a, b, c, d = [" ".join(f"{p}{i}" for i in range(40)) for p in "abcd"]
    compared(spark, [(1, a), (5, a), (2, b), (5, b)])
    compared(spark, [(1, a), (5, a), (2, b), (5, b), (7, c), (7, a), (9, c), (9, d), (9, ""), (11, d), (11, "alone"), (12, "alone"), (3, None), (3, d), (None, d)])


@pytest.mark.parametrize("most, pivots, depth", [(8, 4, 2), (8, 32, 4), (16, 2, 1)])
def test_cut_regions_are_exact(spark, monkeypatch, most, pivots, depth):
    cut = []
    real = jaccard_join._cut
    monkeypatch.setattr(jaccard_join, "_cut", lambda large, own, d: cut.append(d) or real(large, own, d))
    for k, v in (("MOST_REGION", most), ("MOST_PIVOTS", pivots), ("MOST_DEPTH", depth)):
        monkeypatch.setattr(jaccard_join, k, v)
    rows = texts(3, 150)
    compared(spark, rows)
    assert max(cut) >= 1 or depth == 1  # two levels


def test_cells_of_linked_documents_meet():
    """Whatever the pivots: linked documents are in one core, in a core and its guests, or share a cell."""
    r = random.Random(5)
    hits = 0
    for _ in range(20):
        base = [r.sample(range(300), 60) for _ in range(3)]
        own = []
        for _ in range(40):
            b = list(r.choice(base))
            for _ in range(r.randint(0, 25)):
                b[r.randrange(len(b))] = r.randrange(3000)
            own.append(np.unique(np.array(b, dtype=np.uint64)))
        chosen = r.sample(range(40), r.randint(2, 9))
        found = jaccard_join.voronoi(chosen, [own[i] for i in chosen], np.arange(40), own)
        core = {n: c for k, c, n, _ in found if k == jaccard_join.CORE}
        guest = {(n, c) for k, c, n, d in found if k == jaccard_join.OPEN and d <= 0.4 + 1e-9}
        cells = {n: {(k, c) for k, c, m, _ in found if m == n and k != jaccard_join.CORE} for n in range(40)}
        for x in range(40):
            for y in range(x):
                if linked(set(own[x].tolist()), set(own[y].tolist())):
                    hits += 1
                    both = x in core and y in core and core[x] == core[y]
                    one = (x in core and (y, core[x]) in guest) or (y in core and (x, core[y]) in guest)
                    assert both or one or cells[x] & cells[y]
    assert hits > 200


def test_clashing_columns(spark):
    names = ["__gone", "gone", "gonex", "q", "q_t", "Qx", "__q", "__w", "a.b", "c`d", "n", "node", "level"]
    text = " ".join(f"word{i}" for i in range(50))
    docs = spark.createDataFrame([(i, text if i < 2 else text.replace("word", f"other{i}"), "en", *[f"{n}{i}" for n in names]) for i in range(5)], ["doc_id", "text", "lang", *names])
    got = jaccard_join.keep_one(docs)
    assert got.columns == docs.columns and {x.doc_id for x in got.collect()} == {0, 2, 3, 4} and got.where("doc_id = 1").isEmpty()
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns
    for x in kept.collect():
        assert all(x[n] == f"{n}{x.doc_id}" for n in names)


def test_few_good_documents_prove_a_cutoff(spark):
    """Each language has too few labels for a test of every rule and cutoff, but enough for one sequence; all rules together stay within alpha."""
    r = random.Random(2)
    prose = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(40))
    rows = [(i, prose(), "abcd"[i % 4]) for i in range(1400)] + [(5000 + i, " ".join(w + "###" for w in prose().split()), "abcd"[i % 4]) for i in range(40)] + [(6000 + i, prose().upper(), "abcd"[i % 4]) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1400)] + [(6000 + i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    got = quality_rules.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).collect()
    lang = {d: x for d, _, x in rows}
    assert all(not x.kept for x in got if 5000 <= x.doc_id < 6000)
    for s in "abcd":
        good = [x for x in got if lang[x.doc_id] == s and (x.doc_id < 1400 or 6000 <= x.doc_id < 6004)]
        assert sum(not x.kept for x in good) <= 0.02 * len(good)
