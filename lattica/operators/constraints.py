"""Schema constraints of a table: clean columns first, then list what each row breaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.names import fresh

#: Fixed formats.
OBJECT_ID = r"^[0-9a-fA-F]{24}$"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
NUMERIC = r"^[+-]?([0-9]*\.)?[0-9]+$"
MOBILE = r"^(\+?20|0)?1[0125][0-9]{8}$"


@dataclass(frozen=True)
class Rule:
    required: bool = False
    trim: bool = False
    lower: bool = False
    default: object = None
    least: float | None = None
    most: float | None = None
    min_length: int | None = None
    max_length: int | None = None
    one_of: Sequence | None = None
    matches: str | None = None
    unique: bool = False


def cleaned(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Trimmed, lower-cased, and defaults for nulls, in that order."""
    out = {}
    for name, r in rules.items():
        c = F.col(name)
        c = F.trim(c) if r.trim else c
        c = F.lower(c) if r.lower else c
        out[name] = c if r.default is None else F.coalesce(c, F.lit(r.default))
    return df.withColumns(out)


def _broken(name: str, r: Rule) -> list[tuple[Column, str]]:
    c = F.col(name)
    tests = [
        (r.required, c.isNull() | (c.cast("string") == ""), "is required"),
        (r.least is not None, c < F.lit(r.least), f"is less than {r.least}"),
        (r.most is not None, c > F.lit(r.most), f"is more than {r.most}"),
        (r.min_length is not None, F.length(c.cast("string")) < F.lit(r.min_length), "is too short"),
        (r.max_length is not None, F.length(c.cast("string")) > F.lit(r.max_length), "is too long"),
        (r.one_of is not None, ~c.isin(*(r.one_of or [None])), "is not allowed"),
        (r.matches is not None, ~c.cast("string").rlike(r.matches or ""), "has the wrong format"),
    ]
    return [(test, f"{name} {text}") for on, test, text in tests if on]


def check(df: DataFrame, rules: Mapping[str, Rule], errors: str = "errors") -> DataFrame:
    """Cleaned rows with an array of messages. Of equal values of a unique column all rows are told; a null breaks `required` alone."""
    out, x = cleaned(df, rules), fresh(df)
    found = [(test, text) for name, r in rules.items() for test, text in _broken(name, r)]
    for name, r in rules.items():
        if r.unique:
            # counts are summed before the shuffle, and only values that repeat are joined back
            taken = out.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(f"{x}_{name}")).agg(F.count(F.lit(1)).alias(x)).where(F.col(x) > 1).drop(x)
            out = out.join(taken, F.col(name) == F.col(f"{x}_{name}"), "left")
            found.append((F.col(f"{x}_{name}").isNotNull(), f"{name} is taken"))
    out = out.withColumn(errors, F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in found])))
    return out.drop(*[f"{x}_{name}" for name, r in rules.items() if r.unique])


def require(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """df; running it fails with the message if a row is not ok. Unknown is not ok."""
    first = df.columns[0]
    return df.withColumn(first, F.when(F.coalesce(ok, F.lit(False)), F.col(first)).otherwise(F.raise_error(F.lit(message)).cast(dict(df.dtypes)[first])))
