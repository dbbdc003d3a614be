"""Many words in many texts at once: goto and fail arrays as one table of next states, walked in step over stretches of all texts of a batch.

Words of any length are found as bytes of UTF-8, which is the same as characters. An empty word is in every text; null
words and texts match nothing. Words are dealt to automata of at most `most_bytes` of words each; every automaton is one
pass over the texts.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.names import fresh

_STRETCH = 512


class Automaton:
    """Next states by byte class; `word` is the word that ends in a state or -1, `link` the next shorter state with a word."""

    def __init__(self, words: list[bytes]):
        self.longest = max(map(len, words), default=0)
        self.kind = np.zeros(256, dtype=np.int32)
        used = sorted({b for w in words for b in w})
        self.kind[used] = np.arange(1, len(used) + 1)
        kids: list[dict[int, int]] = [{}]
        ends = [-1]
        for i, w in enumerate(words):
            at = 0
            for c in self.kind[list(w)].tolist():
                nxt = kids[at].get(c)
                if nxt is None:
                    nxt = kids[at][c] = len(kids)
                    kids.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = i
        self.word = np.array(ends)
        self.next = np.zeros((len(kids), len(used) + 1), dtype=np.int32)
        self.link = np.zeros(len(kids), dtype=np.int32)
        fail = [0] * len(kids)
        todo = deque([0])
        while todo:
            s = todo.popleft()
            f = fail[s]
            if s:
                self.next[s] = self.next[f]
                self.link[s] = f if self.word[f] >= 0 else self.link[f]
            for c, kid in kids[s].items():
                fail[kid] = int(self.next[f, c]) if s else 0
                todo.append(kid)
            for c, kid in kids[s].items():
                self.next[s, c] = kid
        self.ends = (self.word >= 0) | (self.link > 0)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, word) of each distinct pair in which the text holds the word, ordered by text and word."""
        column = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = column.buffers()
        at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
        raw = self.kind[np.frombuffer(data, np.uint8)[: at[-1]]] if data is not None and at[-1] else np.zeros(0, np.int32)
        # stretches begin so much before their own bytes that no word is cut
        before, step = max(self.longest - 1, 0), max(_STRETCH, 4 * self.longest)
        size = np.diff(at)
        n = -(-size // step)
        text = np.repeat(np.arange(len(size)), n)
        own = at[:-1][text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        first, last = np.maximum(own - before, at[:-1][text]), np.minimum(own + step, at[1:][text])
        order = np.argsort(first - last, kind="stable")
        text, first, length = text[order], first[order], (last - first)[order]
        state = np.zeros(len(text), dtype=np.int32)
        found = []
        for j in range(int(length[0]) if len(length) else 0):
            k = int(np.searchsorted(-length, -j, "left"))  # longer than j
            state[:k] = self.next[state[:k], raw[first[:k] + j]]
            hit = np.flatnonzero(self.ends[state[:k]])
            if len(hit):
                found.append(text[hit] * len(self.word) + state[hit])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        out = []
        while len(pairs):
            t, s = np.divmod(pairs, len(self.word))
            w = self.word[s]
            out.append((t[w >= 0], w[w >= 0]))
            s = self.link[s]
            pairs = np.unique((t * len(self.word) + s)[s > 0])
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        t, w = (np.concatenate(x) for x in zip(*out))
        both = np.unique(t.astype(np.int64) * (int(w.max(initial=0)) + 1) + w)
        return np.divmod(both, int(w.max(initial=0)) + 1)


def containing(df: DataFrame, column: str, words: DataFrame, word: str, most_bytes: int = 1 << 20) -> DataFrame:
    """Rows whose column contains a word of a table, once for each distinct word, which stands beside them."""
    spark = df.sparkSession
    distinct = words.select(F.col(word).cast("string").alias("w")).where("w is not null").distinct()
    total = distinct.agg(F.coalesce(F.sum(F.octet_length("w") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * total // most_bytes) if total > most_bytes else 1)
    x = fresh(df, words)
    plain = df.withColumn(x, F.col(column).cast("string"))
    schema = plain.schema
    out = []
    for b in range(blocks):
        mine = sorted(r.w for r in distinct.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == b).collect())
        sent = spark.sparkContext.broadcast((Automaton([w.encode() for w in mine if w]), [w for w in mine if w], "" in mine))

        def each(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            automaton, named, everywhere = sent.value
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                rows, which = automaton.find(texts)
                if everywhere:
                    here = np.flatnonzero(np.asarray(pc.is_valid(texts)))
                    rows, which = np.concatenate([rows, here]), np.concatenate([which, np.full(len(here), len(named))])
                if len(rows):
                    found = pa.array([*named, ""], pa.string()).take(pa.array(which))
                    part = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], names=batch.schema.names)

        out.append(plain.mapInArrow(each, schema))
    found = reduce(DataFrame.unionAll, out)
    return found.withColumnRenamed(x, word) if word not in df.columns else found.drop(word).withColumnRenamed(x, word)
