"""LM scoring: prediction by partial matching, pretrained on part of the corpus.

The trie holds byte contexts up to a given order (2 to 6) with the counts of what followed them, of
all training texts. A symbol's probability is that of method C: its count over total
plus distinct, else the escape estimate times the next shorter context, in which all
symbols of the longer are excluded; last comes a uniform order. As the trie is frozen
while scoring, these sums are resolved once for every context. Beside it stands an
add-one word model of exact counts.

Counts of words and of strings of order + 1 bytes are summed by hash bucket, without a limit;
a bucket has all strings of a 2-byte context, so it resolves orders 2 and up alone, and
orders 1 and 0 (65536 counts at most) are told to all. Words at or above a count that
at most `most_words` reach, and resolved contexts that at most `most_contexts` reach,
are broadcast; all others are looked up bucket by bucket, with the same result.

Null and empty texts consist of the end symbol alone. Texts are scored whole,
repeated rows alike; a null doc_id is held out (its remainder is unknown); an empty
table gives no rows. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import Texts, buckets_for, by_bucket, flat, joined, mix, ranges, segment_sum, stash, words

PAD, END = 0xFE, 0xFF  # bytes that UTF-8 never uses
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BINS = 40
#: Bytes of text that are taken at once: each needs some 100 bytes of memory.
PIECE = 1 << 19
#: Rows whose rare words and strings are gathered at once.
ROWS = 2500


def framed(t: Texts, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each behind `order` PAD and before one END; and where the symbols to predict begin and end (offsets a document)."""
    size = np.diff(t.at)
    at = np.concatenate([[0], np.cumsum(size + order + 1)])
    out = np.full(at[-1], PAD, dtype=np.uint8)
    body = np.ones(at[-1], dtype=bool)
    for k in range(order):
        body[at[:-1] + k] = False
    body[at[1:] - 1] = False
    out[body] = _LOWER[t.buf]
    out[at[1:] - 1] = END
    return out, at


def strings(b: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of order + 1 bytes at each place, as numbers, and which do not reach over a document's start."""
    n = max(len(b) - order, 0)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | b[k : k + n]
    ok = np.ones(n, dtype=bool)
    for k in range(order):
        inner = at[1:-1] - order + k
        ok[inner[inner >= 0]] = False
    return code, ok


def codes(b: np.ndarray, at: np.ndarray, order: int, docs: np.ndarray) -> np.ndarray:
    """The strings that end at each predicted symbol of the documents that docs (a mask) names."""
    code, ok = strings(b, at, order)
    return code[ok & np.repeat(docs, np.diff(at))[order:]]


Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def level(code: np.ndarray, count: np.ndarray, order: int) -> Level:
    """Contexts of an order, where each one's symbols begin, the symbols and their counts; code: strings that end in context and symbol."""
    u, inv = np.unique(code.astype(np.int64) & ((1 << (8 * order + 8)) - 1), return_inverse=True)
    n = np.bincount(inv, weights=count, minlength=len(u))
    ctx, first = np.unique(u >> 8, return_index=True)
    return ctx, np.append(first, len(u)), u & 255, n


def levels(code: np.ndarray, count: np.ndarray, low: list[Level], order: int) -> list[Level]:
    """The orders of a bucket's strings down to 2, before the lower orders."""
    return [*(level(code, count, k) for k in range(order, 1, -1)), *low]


def resolve(contexts: np.ndarray, levels: list[Level]) -> Iterator[np.ndarray]:
    """log10 probabilities of all 256 symbols after each context, in runs of 2048 contexts; levels: from the highest order to 0."""
    for first in range(0, len(contexts), 2048):
        part = contexts[first : first + 2048].astype(np.int64)
        p = np.zeros((len(part), 256))
        free = np.ones((len(part), 256), dtype=bool)
        left = np.ones(len(part))
        for order, (ctx, ptr, sym, n) in zip(range(len(levels) - 1, -1, -1), levels):
            if not len(ctx):
                continue
            own = part & ((1 << (8 * order)) - 1)
            i = np.minimum(np.searchsorted(ctx, own), len(ctx) - 1)
            size = np.where(ctx[i] == own, ptr[i + 1] - ptr[i], 0)
            r, e = np.repeat(np.arange(len(part)), size), ranges(ptr[i], size)
            s = sym[e]
            ok = free[r, s]
            r, s, c = r[ok], s[ok], n[e][ok]
            total = np.bincount(r, weights=c, minlength=len(part))
            kinds = np.bincount(r, minlength=len(part))
            whole = total + kinds
            p[r, s] = left[r] * c / whole[r]
            free[r, s] = False
            left = np.where(kinds > 0, left * kinds / np.maximum(whole, 1), left)
        free[:, PAD] = False
        p += np.where(free, (left / np.maximum(free.sum(axis=1), 1))[:, None], 0.0)
        yield np.log10(np.maximum(p, 1e-30)).astype(np.float32)


def log_probability(logp: np.ndarray, contexts: np.ndarray, place: np.ndarray, column: np.ndarray, t: Texts, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the log10 probability of its symbols whose context is among the sorted contexts (with their rows in logp, and the column of each symbol); the strings at the others, and the text of each."""
    b, at = framed(t, order)
    code, own = strings(b, at, order)
    i = np.flatnonzero(own)
    row = lookup(contexts, place + 1, (code[i] >> np.uint64(8)).astype(np.int64)) - 1
    known = row >= 0
    each = np.zeros(len(b))
    each[order:][i[known]] = logp.reshape(-1)[row[known] * logp.shape[1] + column[(code[i[known]] & np.uint64(255)).astype(np.int64)]]
    rare = i[~known]
    return segment_sum(each, at), code[rare], np.searchsorted(at, rare + order, "right") - 1


def string_buckets(code: np.ndarray) -> np.ndarray:
    """What the bucket of a string depends on: its 2-byte context."""
    return mix((code >> np.uint64(8)) & np.uint64(0xFFFF))


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=counts, minlength=len(u)).astype(np.int64)


COUNTS = "bucket int, kind int, keys binary, counts binary, n long, total long, bins array<long>"


def gather(docs: DataFrame, train: str, buckets: int, order: int) -> DataFrame:
    """Counts of the words (kind 0) and strings (kind 1) of training texts, summed, a row for each bucket and kind; bins: how many words or contexts have a count from each power of two."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = np.array(batch.column(1).to_pylist(), dtype=bool)
            found: list[list] = [[], []]
            for t in flat(batch.column(0), PIECE):
                use = mask[t.first : t.last]
                w = words(t)
                found[0].append(np.unique(w.hash[np.repeat(use, np.diff(w.ptr))], return_counts=True))
                found[1].append(np.unique(codes(*framed(t, order), order, use), return_counts=True))
                if sum(len(x[0]) for x in found[1][1:]) > max(len(found[1][0][0]), 1 << 18):
                    found[1] = [_merged(*(np.concatenate(x) for x in zip(*found[1])))]
            rows: list[list] = [[], [], [], []]
            for kind, dtype in ((0, np.uint64), (1, np.uint64)):
                if not found[kind]:
                    continue
                k, n = _merged(np.concatenate([x[0] for x in found[kind]]).astype(dtype), np.concatenate([x[1] for x in found[kind]]))
                by, cut = by_bucket(string_buckets(k) if kind else k, buckets)
                for b in np.flatnonzero(np.diff(cut)):
                    part = by[cut[b] : cut[b + 1]]
                    for o, x in zip(rows, (int(b), kind, k[part].tobytes(), n[part].astype(np.uint32).tobytes())):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.binary())], names=["bucket", "kind", "keys", "counts"])

    def total(key: tuple, rows: pa.Table) -> pa.Table:
        k, n = _merged(joined(rows["keys"], np.uint64), joined(rows["counts"], np.uint32))
        of = _merged(k >> np.uint64(8), n)[1] if key[1].as_py() else n
        bins = np.bincount(np.log2(np.maximum(of, 1)).astype(int), minlength=BINS)[:BINS]
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "kind": pa.array([key[1].as_py()], pa.int32()), "keys": pa.array([k.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "n": pa.array([len(k)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64()), "bins": pa.array([bins.tolist()], pa.list_(pa.int64()))})

    slim = docs.selectExpr("cast(text as string) text", f"coalesce({train}, false) train")
    parts = slim.mapInArrow(local, "bucket int, kind int, keys binary, counts binary")
    return stash(parts.groupBy("bucket", "kind").applyInArrow(total, COUNTS), "ppm-counts")


def _least(counts: DataFrame, kind: int, most: int) -> int:
    """The lowest power of two that the counts of at most `most` words (kind 0) or contexts (kind 1) reach."""
    bins = np.array(counts.where(F.col("kind") == kind).select(F.posexplode("bins")).groupBy("pos").agg(F.sum("col")).orderBy("pos").toPandas().iloc[:, 1], dtype=np.int64)
    above = np.cumsum(bins[::-1])[::-1] if len(bins) else np.zeros(0)
    return 1 << int(np.argmax(above <= most)) if len(above) else 1


def _picked(counts: DataFrame, kind: int, pick: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """What pick makes of each bucket's keys and counts, as two binary columns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, y = pick(np.frombuffer(k, np.uint64), np.frombuffer(n, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["x", "y"])

    return counts.where(F.col("kind") == kind).select("keys", "counts").mapInArrow(each, "x binary, y binary").toArrow()


def frequent_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the words that are broadcast."""
    least = _least(counts, 0, most)
    got = _picked(counts, 0, lambda k, n: (k[n >= least], n[n >= least]))
    k, n = joined(got["x"], np.uint64), joined(got["y"], np.int64)
    order = np.argsort(k)
    return k[order], n[order]


def low_orders(counts: DataFrame) -> list[Level]:
    """Orders 1 and 0: sums over all buckets of the 65536 2-byte strings at most."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = _merged(joined(pa.chunked_array([batch.column(0)]), np.uint64) & np.uint64(0xFFFF), joined(pa.chunked_array([batch.column(1)]), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n)], names=["code", "n"])

    got = counts.where("kind = 1").select("keys", "counts").mapInArrow(local, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = np.array(got["code"].to_pylist(), dtype=np.int64), np.array(got["n"].to_pylist(), dtype=np.int64)
    return [level(code, n, 1), level(code, n, 0)]


def columns_of(low: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that training texts have, and one that they lack for all others, as these share one probability after each context; and the place there of each of the 256 (PAD, which is never asked for, goes with the others)."""
    seen = np.unique(low[-1][2])
    others = np.setdiff1d(np.arange(256), [*seen.tolist(), PAD])[:1]
    place = np.full(256, len(seen))
    place[seen] = np.arange(len(seen))
    return np.append(seen, others if len(others) else PAD), place


def frequent_contexts(counts: DataFrame, low: list[Level], most: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The contexts that are broadcast, sorted, where the row of each is, and the resolved rows, of the columns of `columns_of` alone."""
    least = _least(counts, 1, most)
    kept = columns_of(low)[0]

    def pick(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ctx, total = _merged(code >> np.uint64(8), n)
        ctx = ctx[total >= least].astype(np.int64)
        return ctx, np.concatenate([np.zeros((0, len(kept)), np.float32), *(p[:, kept] for p in resolve(ctx, levels(code, n, low, order)))])

    got = _picked(counts, 1, pick)
    contexts = joined(got["x"], np.int64)
    place = np.argsort(contexts)
    return contexts[place], place, joined(got["y"], np.float32).reshape(-1, len(kept))


def lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """values of the wanted among sorted keys, 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, values[i], 0)


def _answers(kind: int, wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray, low: list[Level], order: int) -> np.ndarray:
    """Of a bucket: counts of the wanted words, or log10 probabilities of the wanted strings."""
    if kind == 0:
        return lookup(keys, counts, wanted)
    u, back = np.unique(wanted, return_inverse=True)
    ctx, of = np.unique(u >> np.uint64(8), return_inverse=True)
    out, symbol = np.zeros(len(u)), (u & np.uint64(255)).astype(np.int64)
    for i, p in enumerate(resolve(ctx, levels(keys, counts, low, order))):
        here = np.flatnonzero((of >= 2048 * i) & (of < 2048 * (i + 1)))
        out[here] = p[of[here] - 2048 * i, symbol[here]]
    return out[back]


def score(docs: DataFrame, train: str = "crc32(cast(doc_id as string)) % 7 != 2", most_words: int = 1 << 19, most_contexts: int = 1 << 16, buckets: int | None = None, order: int = 3) -> DataFrame:
    """Per row of docs (doc_id, text): the token counts and base_score of the word model, and score, the trie's log10 probability."""
    spark = docs.sparkSession
    buckets = buckets or buckets_for(docs)
    if not 2 <= order <= 6:
        raise ValueError("order is 2 to 6")
    counts = gather(docs, train, buckets, order)
    n_docs = docs.where(f"coalesce({train}, false)").count()
    known = counts.where("kind = 0").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    n, v = known[0] + n_docs, known[1] + (n_docs > 0)
    low = low_orders(counts)
    column = columns_of(low)[1]
    sent = spark.sparkContext.broadcast((*frequent_words(counts, most_words), *frequent_contexts(counts, low, most_contexts, order)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, contexts, place, logp = sent.value
        row = TaskContext.get().partitionId() << 33
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            first = row
            parts: list[tuple] = []
            rare: tuple[list, list] = ([], [])
            for t in flat(batch.column(1), PIECE):
                w = words(t)
                c = lookup(keys, values, w.hash)
                doc = np.repeat(np.arange(len(t)), np.diff(w.ptr)) + row
                unsure = c == 0
                base = segment_sum(np.log10(c + 1.0), w.ptr) + np.log10(n_docs + 1.0)
                p, code, of = log_probability(logp, contexts, place, column, t, order)
                rare[0].append((w.hash[unsure], doc[unsure]))
                rare[1].append((code, of + row))
                parts.append((np.diff(w.ptr) + 1, segment_sum((c > 0).astype(np.int64), w.ptr) + (n_docs > 0), base, p))
                row += len(t)
            if not parts:
                continue
            tokens, sure, base, s = (np.concatenate(x) for x in zip(*parts))
            asks: list[list] = [[], [], [], []]
            for kind in (0, 1):
                h, d = (np.concatenate(x) for x in zip(*rare[kind]))
                by, cut = by_bucket(string_buckets(h) if kind else h, buckets)
                for b in np.flatnonzero(np.diff(cut)):
                    x = by[cut[b] : cut[b + 1]]
                    for o, y in zip(asks, (int(b), kind, h[x].tobytes(), d[x].tobytes())):
                        o.append(y)
            m, k = len(tokens), len(asks[0])
            yield pa.RecordBatch.from_arrays(
                [
                    *[pa.concat_arrays([pa.nulls(m, t), pa.array(x, t)]) for x, t in zip(asks, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                    *[pa.concat_arrays([x, pa.nulls(k, x.type)]) for x in (pa.array(np.arange(first, first + m)), batch.column(0), batch.column(2))],
                    *[pa.concat_arrays([pa.array(x.astype(t)), pa.nulls(k, pa.from_numpy_dtype(t))]) for x, t in ((tokens, np.int64), (sure, np.int64), (base, np.float64), (s, np.float64))],
                ],
                names=["bucket", "kind", "asked", "rows", "row", "doc_id", "held_out", "n_tokens", "sure", "base", "score"],
            )

    slim = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", f"not coalesce({train}, false) held_out")
    scored = stash(slim.mapInArrow(each, "bucket int, kind int, asked binary, rows binary, row long, doc_id long, held_out boolean, n_tokens long, sure long, base double, score double"), "ppm-scored")

    def rest(key: tuple, asked: pa.Table, counted: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("part", "rows", "base", "score", "found"), (pa.int32(), *[pa.binary()] * 4))})
        kind = key[1].as_py()
        h, d = joined(asked["asked"], np.uint64), joined(asked["rows"], np.int64)
        got = _answers(kind, h, joined(counted["keys"], np.uint64), joined(counted["counts"], np.int64), low, order)
        if kind == 0:
            d, got = d[got > 0], np.log10(got[got > 0] + 1.0)
        u, inv = np.unique(d, return_inverse=True)
        more, nothing = np.bincount(inv, weights=got, minlength=len(u)), np.zeros(len(u))
        base, p, found = (nothing, more, nothing) if kind else (more, nothing, np.bincount(inv, minlength=len(u)).astype(float))
        by, cut = by_bucket(u.astype(np.uint64), max(buckets // 2, 1))
        some = np.flatnonzero(np.diff(cut))
        blobs = [by[cut[b] : cut[b + 1]] for b in some]
        return pa.table({"part": pa.array(some.astype(np.int32)), **{c: pa.array([y[x].tobytes() for x in blobs], pa.binary()) for c, y in (("rows", u), ("base", base), ("score", p), ("found", found))}})

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        u, inv = np.unique(joined(rows["rows"], np.int64), return_inverse=True)
        base, p, found = (np.bincount(inv, weights=joined(rows[c], np.float64), minlength=len(u)) for c in ("base", "score", "found"))
        return pa.table({"at": pa.array(u), "more_base": pa.array(base), "more_score": pa.array(p), "found": pa.array(found.astype(np.int64))})

    asked = scored.where("bucket is not null").select("bucket", "kind", "asked", "rows").groupBy("bucket", "kind")
    answer = asked.cogroup(counts.select("bucket", "kind", "keys", "counts").groupBy("bucket", "kind")).applyInArrow(rest, "part int, rows binary, base binary, score binary, found binary")
    answer = answer.groupBy("part").applyInArrow(summed, "at long, more_base double, more_score double, found long")
    out = scored.where("bucket is null").join(answer, F.col("row") == F.col("at"), "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("sure") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))
