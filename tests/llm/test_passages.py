"""Fuzzy passages: layers of smaller documents with their pieces, texts that share a doc_id, and all windows of small tables by brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lattica.llm import chain_dedup

SCHEMA = "doc_id long, text string"


def planted(layers, rates, pairs, seed):
    """(rows, {larger document: (smaller, layers, rate)}): passages of 100 words in two documents, edited in one, their pieces in smaller documents."""
    rng = random.Random(seed)
    filler = lambda n: [f"w{rng.randrange(6000)}" for _ in range(n)]
    decoys, true = {}, []
    for sizes in layers:
        for rate in rates:
            for _ in range(pairs):
                p = filler(100)
                for k, m in enumerate(sizes):
                    decoys.setdefault(k, []).extend(filler(30) + p[a : a + m] + filler(30) for a in range(0, 96, m - 4))
                e = list(p)
                for i in rng.sample(range(100), int(rate * 100)):
                    e[i] = f"x{rng.randrange(6000)}"
                true.append((filler(40) + p + filler(40), filler(40) + e + filler(40), len(sizes), rate))
    texts = [x for k in sorted(decoys) for x in decoys[k]]
    n = len(texts)
    texts += [x for t in true for x in t[:2]]
    return [(i, " ".join(x)) for i, x in enumerate(texts)], {n + 2 * i + 1: (n + 2 * i, *t[2:]) for i, t in enumerate(true)}


def test_pieces_in_smaller_documents_hide_no_passage(spark):
    rows, want = planted([(12,), (12, 40), (12, 25, 40)], [0.05, 0.1, 0.15], 20, 3)
    got = {(r.doc_id, r.other_doc_id) for r in chain_dedup.passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    every, found = Counter(c for _, *c in map(lambda v: (v[0], v[1:]), want.values()) for c in c), Counter(v[1:] for d, v in want.items() if (d, v[0]) in got)
    assert len(every) == 9 and all(found[c] >= 0.9 * n for c, n in every.items()), found


def test_texts_that_share_an_id_all_count(spark):
    rng = random.Random(4)
    p, q, other = ([f"w{rng.randrange(9999)}" for _ in range(80)] for _ in range(3))
    t = " ".join
    rows = [(1, t(p)), (2, t(p)), (2, "zzz " + t(other)), (3, t(q)), (3, t(q) + " end"), (4, t(other)), (5, None), (None, t(p)), (2, t(p))]
    got = {(r.doc_id, r.other_doc_id, r.n_equal) for r in chain_dedup.passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(2, 1, 80), (4, 2, 80)}


@pytest.mark.parametrize("seed", [1, 2])
def test_all_windows_by_brute_force(spark, seed):
    """Of the words in windows of 50 of which 45 are those of a smaller document, place by place, nearly all lie in passages; each passage is what it says.

    What is lost are passages of little more than 50 words whose edits leave no common key, and edges beyond another reference's passage.
    """
    rng = random.Random(seed)
    filler = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    docs = [filler(rng.randint(60, 200)) for _ in range(60)]
    for d in range(5, 60):
        for _ in range(rng.randint(0, 2)):
            source = docs[rng.randrange(d)]
            a = rng.randrange(max(1, len(source) - 60))
            p = list(source[a : a + rng.randint(55, 110)])
            for i in rng.sample(range(len(p)), int(len(p) * rng.choice([0, 0.04, 0.08]))):
                p[i] = f"x{rng.randrange(400)}"
            k = rng.randrange(len(docs[d]))
            docs[d][k:k] = p
    rows = [(i, " ".join(x)) for i, x in enumerate(docs)]
    got = chain_dedup.passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    covered = {d: np.zeros(len(x), dtype=bool) for d, x in enumerate(docs)}
    for r in got:
        x, y = docs[r.doc_id][r.first_word : r.end_word], docs[r.other_doc_id][r.other_first_word : r.other_end_word]
        best = np.zeros((len(x) + 1, len(y) + 1), dtype=int)
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                best[i + 1, j + 1] = best[i, j] + 1 if u == v else max(best[i, j + 1], best[i + 1, j])
        assert r.other_doc_id < r.doc_id and min(len(x), len(y)) >= 50 and r.n_equal <= best[-1, -1] and r.identity == r.n_equal / max(len(x), len(y)) >= 0.8
        covered[r.doc_id][r.first_word : r.end_word] = True
    windows = lost = 0
    for d, x in enumerate(docs):
        need = np.zeros(len(x), dtype=bool)
        for y in docs[:d]:
            same = np.array([[u == v for v in y] for u in x])
            for k in range(-len(x) + 50, len(y) - 49):
                hits = np.concatenate([[0], np.cumsum(same.diagonal(k))])
                for a in np.flatnonzero(hits[50:] - hits[:-50] >= 45):
                    at = a + max(0, -k)
                    need[at + 5 : at + 45] = True
        windows += need.sum()
        lost += (need & ~covered[d]).sum()
    assert windows > 2000 and lost <= 0.05 * windows


def test_alignment_reads_excerpts_of_both_texts(spark, tmp_path, monkeypatch):
    """Documents that share a passage with one long text bring its words about the passage to their alignment, not all of it."""
    rng = random.Random(8)
    filler = lambda n: [f"w{rng.randrange(99999)}" for _ in range(n)]
    long, size = filler(20_000), tmp_path / "sizes"
    rows = [(0, " ".join(long))] + [(i, " ".join(filler(30) + long[900 * i : 900 * i + 60] + filler(30))) for i in range(1, 21)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain = type(docs).mapInArrow

    def metered(self, f, *more, **named):
        def run(batches):
            def seen():
                for b in batches:
                    with size.open("a") as out:
                        out.write(f"{b.nbytes}\n")
                    yield b

            return f(seen())

        return plain(self, run if f.__name__ == "aligned" else f, *more, **named)

    monkeypatch.setattr(type(docs), "mapInArrow", metered)
    got = {(r.doc_id, r.other_doc_id, r.first_word, r.other_first_word, r.n_equal) for r in chain_dedup.passages(docs).collect()}
    assert got == {(i, 0, 30, 900 * i, 60) for i in range(1, 21)}
    assert sum(map(int, size.read_text().split())) < 10 * 4 * 20_000  # 20 times the long text came before


def test_small_steps_of_alignments_are_those_of_plain_versions():
    rng = np.random.default_rng(5)
    for _ in range(400):
        x, y = (rng.integers(0, 6, rng.integers(0, 160)).astype(np.uint32) for _ in range(2))
        if rng.random() < 0.5:
            y = np.where(rng.random(len(x)) < 0.2, 9, x).astype(np.uint32)
        i, j = int(rng.integers(0, len(x) + 1)), int(rng.integers(0, len(y) + 1))
        n = min(len(x) - i, len(y) - j)
        e = x[i : i + n] == y[j : j + n]
        assert chain_dedup.equal(x, y, i, j) == (int(np.argmin(e)) if not e.all() else n)
        some = np.cumsum(e[:16])
        want = int(np.argmax(e[:16])) if ((some >= 2) & (2 * some > np.arange(len(some)))).any() else None
        assert chain_dedup.ahead(x, y, i, j) == (None if want is None else (want, want))
        a, b = x[max(i - 50, 0) : i + 55], y[max(j - 98, 0) : j + 103]
        known = np.concatenate([[0], np.cumsum(np.isin(a, b))])
        assert chain_dedup.hopeless(x, y, i, j, 50) == (len(a) < 50 or 2 * int((known[50:] - known[:-50]).max()) < 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array([bytes(4 * n) for n in (5, 0, 30, 2, 2, 0, 0, 50, 1)], pa.binary())], names=["id", "spelt"])
    cut = list(chain_dedup.pieces(batch.slice(1), 1, 100))
    assert [x for p in cut for x in p.column(0).to_pylist()] == list(range(1, 9)) and len(cut) > 2
    assert all(p.num_rows == 1 or sum(map(len, p.column(1).to_pylist())) <= 100 for p in cut)
    assert [v.tobytes() for p in cut for v in chain_dedup.views(p.column(1))] == batch.column(1).to_pylist()[1:]
