"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Every document gets counts from its whole text. Six rules have eight cutoffs each, from
mild to strict; at level j a document is rejected if any rule's j-th cutoff rejects it, so
each level rejects what the one before does and more. Labelled good documents are the
holdout: for each stratum (lang) and level the exact binomial tail P(Bin(n, alpha) <=
false rejections) is the p-value of "this level rejects more than alpha of the good".
Levels are tested from mild to strict up to the first that is not proved (a fixed
sequence needs no correction), strata share delta (Bonferroni). So, with probability
1-delta, all rules together reject at most alpha of the good documents of every stratum.

Null and empty texts have counts 0 and fail the base rule; a null lang is a stratum
of its own; repeated label rows of one doc_id count once, as the lower quality;
repeated documents get the same verdict. Without labels nothing but the base rule
rejects. Other columns, whatever their names, are carried by `keep` and ignored by
`verdicts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import free, quoted, stash

GAP = r"[\x20\x09-\x0D]+"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
#: Rule: (a count, what it is divided by, cutoffs from mild to strict, whether high values are bad).
RULES = {
    "symbols": ("n_symbols", "word_chars", (0.6, 0.4, 0.3, 0.2, 0.15, 0.1, 0.07, 0.05), True),
    "dup_lines": ("n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3), True),
    "repeats": ("n_repeat_words", "n_words", (0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.15, 0.12), True),
    "capitals": ("n_capitals", "word_chars", (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3), True),
    "long_words": ("word_chars", "n_words", (40, 30, 25, 20, 17, 15, 13, 12), True),
    "short_words": ("word_chars", "n_words", (1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0), False),
}
LEVELS = 8
#: At most so many strata, and so many ids of labelled documents, are broadcast.
BROADCAST_ROWS, BROADCAST_IDS = 50_000, 1 << 20


def counts(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct `name` of counts over each whole text; no column of docs begins with `name`.

    Equal 8-word windows are found by 64-bit hash within one row: no shuffle.
    """
    own = [quoted(c) for c in docs.columns]
    t, w, lines_, h, s, p = (f"{name}_{x}" for x in "twlhsp")
    x = docs.select(*own, F.coalesce(F.col("text").cast("string"), F.lit("")).alias(t))
    lines = F.filter(F.split(t, "\n"), lambda v: v.rlike(r"[^\x20\x09-\x0D]"))
    x = x.select(*own, t, F.array_remove(F.split(t, GAP), "").alias(w), lines.alias(lines_))
    x = x.withColumn(h, F.transform(w, lambda v: F.xxhash64(v)))
    # (used more than once, so that the optimiser does not copy the hashes' expression into the lambda)
    windows = F.when(F.size(h) >= 8, F.transform(F.sequence(F.lit(1), F.size(h) - 7), lambda i: F.xxhash64(F.slice(h, i, 8))))
    counted = {
        "n_words": F.size(w),
        "word_chars": F.coalesce(F.length(F.array_join(w, "")), F.lit(0)),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
        "n_capitals": F.length(F.regexp_replace(t, r"[^A-Z]+", "")),
        "n_lines": F.size(lines_),
        "n_dup_lines": F.size(lines_) - F.size(F.array_distinct(lines_)),
    }
    x = x.select(*own, *[c.cast("bigint").alias(f"{name}_{k}") for k, c in counted.items()], windows.alias(h))
    pairs = F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i")))))
    x = x.withColumn(s, pairs).drop(h)
    at = lambda j: F.get(F.col(s), j)["h"]
    found = F.filter(F.transform(s, lambda e, j: F.when((e["h"] == at(j - 1)) | (e["h"] == at(j + 1)), e["i"])), lambda i: i.isNotNull())
    x = x.withColumn(p, F.array_sort(found)).drop(s)
    start = F.struct(F.lit(-8).alias("last"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(p, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(8), i - a["last"])).alias("n")), lambda a: a["n"])
    x = x.withColumn(f"{name}_n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop(p)
    # one row of one array: the optimiser does not copy the counts' expressions into each use of them beyond a generator
    return x.select(*own, F.explode(F.array(F.struct(*[F.col(f"{name}_{c}").alias(c) for c in COUNTS]))).alias(name))


def base_failed(q: str) -> Column:
    return (F.col(f"{q}.n_words") < 20) | (100 * F.col(f"{q}.n_repeat_words") > 30 * F.col(f"{q}.n_words"))


def level(q: str) -> Column:
    """The mildest level that rejects a document with counts q; null if none does."""
    first = []
    for count, by, cuts, high in RULES.values():
        measure = F.col(f"{q}.{count}") / F.greatest(F.col(f"{q}.{by}"), F.lit(1))
        first.append(F.coalesce(*[F.when(measure > c if high else measure < c, j) for j, c in enumerate(cuts)]))
    return F.least(*first)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly, summed in logarithms so that large n cannot underflow to 0 terms."""
    q = F.lit(p / (1 - p))
    first = n * F.log(F.lit(1 - p))
    step = lambda a, j: F.struct(
        (a["term"] + F.log((n - j + 1) / j * q)).alias("term"),
        (F.greatest(a["sum"], a["term"] + F.log((n - j + 1) / j * q)) + F.log1p(F.exp(-F.abs(a["sum"] - a["term"] - F.log((n - j + 1) / j * q))))).alias("sum"),
    )
    total = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("term"), first.alias("sum")), step, lambda a: F.exp(a["sum"]))
    return F.when(k >= n, F.lit(1.0)).otherwise(total)


def thresholds(counted: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, cut) of rows (doc_id, lang, q): the strictest level that is proved; strata without one are not listed."""
    quality = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc")).agg(F.min("quality").alias("quality"))
    good = counted.join(quality.where("quality = 1"), F.col("doc_id") == F.col("doc")).where(~base_failed("q"))
    falsely = [F.count_if(F.col("level") <= j).alias(f"k{j}") for j in range(LEVELS)]
    per = good.select(F.col("lang").alias("stratum"), level("q").alias("level")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *falsely)
    per = stash(per, "rules-holdout")
    strata = per.count()
    tests = F.array(*[F.struct(F.lit(j).alias("cut"), F.col(f"k{j}").alias("k")) for j in range(LEVELS)])
    # a stricter level has more false rejections and a greater p-value: those proved are a beginning of the sequence
    proved = per.select("stratum", "n", F.explode(tests).alias("t")).where(binomial_tail(F.col("t.k"), F.col("n"), alpha) * strata <= delta)
    return proved.groupBy("stratum").agg(F.max("t.cut").alias("cut"))


def _judged(counted: DataFrame, cuts: DataFrame, q: str) -> DataFrame:
    """counted with whether the base rule and whether any rule rejects: q_failed, q_kept."""
    cuts = cuts.select(F.col("stratum").alias(f"{q}_of"), F.col("cut").alias(f"{q}_cut"))
    if cuts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    x = counted.join(cuts, F.col("lang").cast("string").eqNullSafe(F.col(f"{q}_of")), "left")
    bad = F.coalesce(level(q) <= F.col(f"{q}_cut"), F.lit(False))
    return x.withColumn(f"{q}_failed", base_failed(q)).withColumn(f"{q}_kept", ~base_failed(q) & ~bad)


def verdicts(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Per row of docs (doc_id, text, lang): its counts, whether it fails the base rule, and whether it is kept."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counted = stash(counts(slim, "q").drop("text"), "rules-counts")
    cuts = stash(thresholds(counted, labels, alpha, delta), "rules-cutoffs")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return _judged(counted, cuts, "q").select("doc_id", *[F.col(f"q.{c}").alias(c) for c in names], F.col("q_failed").alias("base_failed"), F.col("q_kept").alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns. Cutoffs are fitted on the labelled rows of docs."""
    marked = labels.where("quality = 1").select(F.col("doc_id").cast("bigint").alias("of")).distinct()
    if marked.count() <= BROADCAST_IDS:  # else whole texts would be shuffled
        marked = F.broadcast(marked)
    fit = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").join(marked, F.col("doc_id") == F.col("of"), "left_semi")
    cuts = stash(thresholds(stash(counts(fit, "q").drop("text"), "rules-counts"), labels, alpha, delta), "rules-cutoffs")
    q = free(docs, start="q")
    return _judged(counts(docs, q), cuts, q).where(f"{q}_kept").select(*[quoted(c) for c in docs.columns])
