"""Secret scans: keyed patterns plus a sliding-window entropy scan with allow-list suppression.

Three patterns give the base spans. The method adds spans of kind `entropy`: over
every run of key-like characters a window slides, its Shannon entropy kept by
incremental counts, and windows over the threshold of their character class are
joined and widened to whole tokens (pieces between `/`, `_`, `=` and `-`). Tokens on the
allow-list are cut out of a run before, what is left of it is scanned. Spans are code
points, end exclusive.

A threshold is what all but 2 % of random 20-character strings of the class reach.
Windows with marks, with one digit or of letters in both cases need more, as paths and
names in prose reach that too; letters of one case count only where vowels are few.

Null and empty texts have no spans; texts are never cut; repeated rows are scanned
each for itself; a null doc_id is carried along; other columns are ignored by
`scan` and carried by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import arrow_rows
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Bits per character that a window must reach, by class: hexadecimal; digits and letters of one case, of both; letters of one case, of both; all others.
THRESHOLDS = {"hex": 2.95, "base36": 3.45, "base62": 3.68, "single": 3.28, "letters": 3.9, "mixed": 3.9}
#: Tokens that are no secrets: UUIDs, those that say they are examples, and the key of a well-known manual.
ALLOW = (r"(?i)(?<![0-9a-z])[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9a-z])", r"(?i)example|placeholder|changeme|dummy|sample", r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY")
#: Characters between tokens.
BETWEEN = "/_=-"
_BETWEEN = re.compile("[/_=-]")

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]],
    T.StructField("base_sha256", T.StringType()),
    T.StructField("spans", T.StringType()),
    T.StructField("n_entropy", T.LongType()),
])

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the three patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _class(n_hex: int, n_lower: int, n_upper: int, n_digit: int, n_vowel: int, width: int) -> str | None:
    letters = n_lower + n_upper
    both = bool(n_lower and n_upper)
    if not letters:
        return None
    if n_digit and n_hex == width:
        return "hex"
    if n_digit > 1 and (both or letters + n_digit == width):
        return "base62" if both else "base36"
    if n_digit:
        return "mixed"
    if letters < width:
        return None
    if not both:
        return "single" if 5 * n_vowel <= width else None
    return "letters" if 4 * min(n_lower, n_upper) >= width else None


def hot_windows(s: str, width: int, thresholds: dict[str, float]) -> Iterator[tuple[int, int]]:
    """Joined windows of s whose entropy reaches the threshold of their class.

    H = log2(width) - sum(c*log2 c)/width, so a step of the window changes two terms.
    """
    logs = [0.0, 0.0] + [c * math.log2(c) for c in range(2, width + 1)]
    counts: dict[str, int] = dict.fromkeys(s, 0)
    flags = {c: (c in "0123456789abcdefABCDEF", "a" <= c <= "z", "A" <= c <= "Z", "0" <= c <= "9", c in "aeiouAEIOU") for c in counts}
    total = 0.0
    n_hex = n_lower = n_upper = n_digit = n_vowel = 0
    start = end = -1
    for i, c in enumerate(s):
        if i >= width:
            old = s[i - width]
            k = counts[old]
            total += logs[k - 1] - logs[k]
            counts[old] = k - 1
            a, b, d, e, f = flags[old]
            n_hex, n_lower, n_upper, n_digit, n_vowel = n_hex - a, n_lower - b, n_upper - d, n_digit - e, n_vowel - f
        k = counts[c]
        total += logs[k + 1] - logs[k]
        counts[c] = k + 1
        a, b, d, e, f = flags[c]
        n_hex, n_lower, n_upper, n_digit, n_vowel = n_hex + a, n_lower + b, n_upper + d, n_digit + e, n_vowel + f
        if i < width - 1:
            continue
        kind = _class(n_hex, n_lower, n_upper, n_digit, n_vowel, width)
        if kind and math.log2(width) - total / width >= thresholds[kind] - 1e-9:
            if start >= 0 and i - width + 1 > end:
                yield start, end
                start = -1
            if start < 0:
                start = i - width + 1
            end = i + 1
    if start >= 0:
        yield start, end


def marks(s: str) -> list[int]:
    """Where the characters between tokens are."""
    return [m.start() for m in _BETWEEN.finditer(s)]


def widened(s: str, at: Sequence[int], i: int, j: int) -> tuple[int, int]:
    """[i, j) of s up to the ends of the tokens that it begins and ends in; at: the marks of s."""
    if s[i] not in BETWEEN:
        k = bisect_left(at, i)
        i = at[k - 1] + 1 if k else 0
    if s[j - 1] not in BETWEEN:
        k = bisect_left(at, j)
        j = at[k] if k < len(at) else len(s)
    return i, j


def allowed(s: str, allow: Sequence[re.Pattern]) -> list[tuple[int, int]]:
    """Stretches of whole tokens of s that the allow-list names, in order."""
    found = [m.span() for a in allow for m in a.finditer(s) if m[0]]
    at = marks(s) if found else []
    return sorted({widened(s, at, *x) for x in found})


def entropy_spans(text: str, base: Sequence[Span], width: int, thresholds: dict[str, float], allow: Sequence[re.Pattern]) -> list[Span]:
    """Linear in the text but for a search among marks and among base spans for each hot stretch."""
    found: list[Span] = []
    starts, ends = [s for s, _, _ in base], [*accumulate((e for _, _, e in base), max)]
    for m in CANDIDATE.finditer(text):
        at = 0
        for i, j in [*allowed(m[0], allow), (len(m[0]), len(m[0]))]:
            # marks beside an allowed token belong to neither
            piece = m[0][at:i].rstrip(BETWEEN) if j > i else m[0][at:]
            last = m.start() + at
            if at:
                last += len(piece) - len(piece.lstrip(BETWEEN))
                piece = piece.lstrip(BETWEEN)
            at = max(at, j)
            own = None
            for x, y in hot_windows(piece, width, thresholds):
                own = marks(piece) if own is None else own
                x, y = widened(piece, own, x, y)
                if found and found[-1][2] >= last + x:
                    x = found.pop()[0] - last
                k = bisect_right(starts, last + x)
                if not k or ends[k - 1] < last + y:
                    found.append((last + x, 3, last + y))
    return found


def joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def all_spans(text: str, width: int = 20, thresholds: dict[str, float] | None = None, allow: Sequence[str] = ALLOW) -> list[Span]:
    base = base_spans(text)
    return sorted(base + entropy_spans(text, base, width, thresholds or THRESHOLDS, [re.compile(a) for a in allow]))


def scan(docs: DataFrame, width: int = 20, thresholds: dict[str, float] | None = None, allow: Sequence[str] = ALLOW) -> DataFrame:
    """One row per row of docs (doc_id, text): counts and spans of the secrets in its whole text."""
    limits = thresholds or THRESHOLDS

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = [re.compile(a) for a in allow]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py() or ""
                base = base_spans(t)
                more = entropy_spans(t, base, width, limits, skip)
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((doc, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=SCHEMA.names)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(each, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]", width: int = 20, thresholds: dict[str, float] | None = None, allow: Sequence[str] = ALLOW) -> DataFrame:
    """docs with every secret span of text replaced by mark (overlapping spans by one), all other columns as they are."""
    limits, at = thresholds or THRESHOLDS, docs.columns.index("text")

    def clean(text: str, skip: list[re.Pattern]) -> str:
        base = base_spans(text)
        out, done = [], 0
        for s, _, e in sorted(base + entropy_spans(text, base, width, limits, skip)):
            if s >= done:
                out += [text[done:s], mark]
            done = max(done, e)
        return "".join(out) + text[done:] if out else text

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = [re.compile(a) for a in allow]
        for batch in batches:
            texts = pa.array([None if t is None else clean(t, skip) for t in batch.column(at).to_pylist()], batch.column(at).type)
            columns = [texts if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return arrow_rows(docs, each)
