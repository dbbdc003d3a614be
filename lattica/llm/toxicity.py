"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic of the weights
of its words; the document's is the noisy-or of its sentences'. Weights are fitted to
document labels alone, through the noisy-or, on a bounded sample of labelled rows
(`most_docs`); words enter the model if their link with the label is beyond chance.
The sentence with the highest score is the offending one.

Null and empty texts have no sentence and score 0; texts are scored whole; repeated
rows score alike; of repeated label rows the highest counts; without labelled rows of
both kinds every score is 0. Labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import Texts, flat, words

_STRIP = np.ones(256, dtype=bool)
_STRIP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n"]] = True

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_sentences", T.LongType()), T.StructField("worst_sentence", T.LongType()), T.StructField("worst_score", T.DoubleType())])


@dataclass
class Model:
    """Sorted word hashes with their weights, and the score of a sentence without any."""

    vocabulary: np.ndarray
    weight: np.ndarray
    bias: float


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def sentences(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the sentence of each (numbered through all of t, those with words only), and the range of each document's sentences."""
    w = words(t, strip=_STRIP)
    stops = np.concatenate([[0], np.cumsum(_STOP[t.buf])])[w.start]
    doc = np.repeat(np.arange(len(t)), np.diff(w.ptr))
    new = np.ones(len(stops), dtype=bool)
    new[1:] = (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])
    number = np.cumsum(new) - 1
    count = np.concatenate([[0], np.cumsum(new)])
    return w.hash, number, count[w.ptr]


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], label: np.ndarray, least_docs: int | None = None, z: float = 5.0, steps: int = 300) -> Model:
    """bags: per document (word hashes, sentence of each from 0, number of sentences). Full-batch gradient descent (Adam) on the noisy-or's likelihood.

    least_docs: different documents that a word of the model is in (default: 4, up to 8 for larger samples). Equal documents count once for that.
    """
    y = label.astype(bool)
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -60.0)
    if not len(bags) or y.all() or not y.any():
        return none
    least_docs = least_docs or int(min(8, max(4, len(bags) // 300)))
    once = {b[0].tobytes(): i for i, b in enumerate(bags)}.values()
    seen = [np.unique(bags[i][0]) for i in once]
    every = np.concatenate(seen)
    owner = np.repeat(y[list(once)], [len(s) for s in seen])
    vocabulary, at = np.unique(every, return_inverse=True)
    docs, bad = np.bincount(at), np.bincount(at, weights=owner)
    rate = y.mean()
    score = (bad - docs * rate) / np.sqrt(np.maximum(docs * rate * (1 - rate), 1e-9))
    vocabulary = vocabulary[(docs >= least_docs) & (score >= z)]
    if not len(vocabulary):
        return none
    col, row, n_sent, base = [], [], [], 0
    for h, s, n in bags:
        i = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        hit = vocabulary[i] == h
        pair = np.unique(np.stack([s[hit] + base, i[hit]]), axis=1) if hit.any() else np.zeros((2, 0), np.int64)
        row.append(pair[0])
        col.append(pair[1])
        n_sent.append(n)
        base += n
    row, col, n_sent = np.concatenate(row).astype(np.int64), np.concatenate(col).astype(np.int64), np.array(n_sent)
    doc_of = np.repeat(np.arange(len(bags)), n_sent)
    hot, at = np.unique(row, return_inverse=True)  # sentences with a word of the vocabulary
    hot_doc = doc_of[hot]
    plain = n_sent - np.bincount(hot_doc, minlength=len(bags))
    w, b = np.zeros(len(vocabulary)), -7.0
    m, v = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    for step in range(1, steps + 1):
        zs = b + np.bincount(at, weights=w[col], minlength=len(hot))
        log_clean = -np.bincount(hot_doc, weights=_softplus(zs), minlength=len(bags)) - plain * _softplus(np.array(b))
        log_clean = np.minimum(log_clean, -1e-12)
        pull = np.where(y, -np.exp(log_clean) / -np.expm1(log_clean), 1.0)  # dLoss/dz = pull * sigmoid(z)
        gs = pull[hot_doc] / (1 + np.exp(-zs))
        g = np.bincount(col, weights=gs[at], minlength=len(vocabulary)) / len(bags) + 1e-5 * w
        gb = (gs.sum() + (pull * plain).sum() / (1 + np.exp(-b))) / len(bags)
        grad = np.append(g, gb)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return Model(vocabulary, w, float(b))


def score(model: Model, t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per document of t: noisy-or score, number of sentences, index and score of the worst sentence (-1 and 0 without any)."""
    h, sentence, ptr = sentences(t)
    count = np.diff(ptr)
    z = np.full(int(ptr[-1]), model.bias)
    if len(model.vocabulary) and len(h):
        i = np.minimum(np.searchsorted(model.vocabulary, h), len(model.vocabulary) - 1)
        hit = np.flatnonzero(model.vocabulary[i] == h)
        if len(hit):
            pair = np.unique(sentence[hit] * len(model.vocabulary) + i[hit])
            np.add.at(z, pair // len(model.vocabulary), model.weight[pair % len(model.vocabulary)])
    total = -np.expm1(-np.concatenate([[0.0], np.cumsum(_softplus(z))])[ptr[1:]] + np.concatenate([[0.0], np.cumsum(_softplus(z))])[ptr[:-1]])
    worst, top = np.full(len(t), -1, np.int64), np.zeros(len(t))
    if len(z):
        doc = np.repeat(np.arange(len(t)), count)
        order = np.lexsort((-np.arange(len(z)), z, doc))  # the last of a document is its worst, the first of equals
        last = ptr[1:][count > 0] - 1
        best = order[last]
        worst[count > 0] = best - ptr[:-1][count > 0]
        top[count > 0] = 1 / (1 + np.exp(-z[best]))
    return np.clip(total, 0.0, 1.0), count, worst, top


def train(docs: DataFrame, labels: DataFrame, most_docs: int = 8000) -> Model:
    """Fit on rows of docs that have a label. most_docs bounds the sample in expectation: rows are taken by a hash of doc_id."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(F.max("toxic").cast("int").alias("toxic"))
    n = marks.count()
    share = F.pmod(F.xxhash64(F.lit("sample"), "doc"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, most_docs / max(n, 1)))
    some = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks.where(share)), F.col("doc_id") == F.col("doc"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            label = batch.column(1).to_pylist()
            for t in flat(batch.column(0)):
                h, s, ptr = sentences(t)
                bounds = np.searchsorted(s, ptr)
                for d in range(len(t)):
                    a, b = bounds[d], bounds[d + 1]
                    for o, x in zip(out, (h[a:b].tobytes(), (s[a:b] - ptr[d]).astype(np.int32).tobytes(), int(ptr[d + 1] - ptr[d]), label[t.first + d])):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["h", "s", "n", "toxic"])

    rows = some.select("text", "toxic").mapInArrow(bags, "h binary, s binary, n int, toxic int").toArrow()
    got = [(np.frombuffer(h, np.uint64), np.frombuffer(s, np.int32).astype(np.int64), n) for h, s, n in zip(*[rows.column(i).to_pylist() for i in range(3)])]
    return fit(got, np.array(rows.column(3).to_pylist(), dtype=int))


def apply(docs: DataFrame, model: Model, held_out: str = "false", cut: float = 0.7) -> DataFrame:
    """Per row of docs: score, predicted, and its worst sentence. held_out: a SQL condition on doc_id that is reported."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score(model, t) for t in flat(batch.column(1))]
            s, n, worst, top = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(worst.astype(np.int64)), pa.array(top, pa.float64())], names=SCHEMA.names)

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", f"coalesce({held_out}, false) held_out")
    return slim.mapInArrow(each, SCHEMA)
