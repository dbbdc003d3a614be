"""The arithmetic language: tokens apart by spaces, + - * / ^ (all from the left), parentheses, names, statements by `;`.

Values are computed in Arrow batches; an invalid text gives null.
"""

from __future__ import annotations

import operator
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NUMBER = re.compile(r"-?\d+(\.\d*)?$|-?\.\d+$")
_NAME = re.compile(r"[^\W\d_][^\W_]*$")
_RANK = {"+": 1, "-": 1, "*": 2, "/": 2, "^": 3}
_APPLY = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "^": operator.pow}


def postfix(text: str | None) -> list[str] | None:
    """Reverse Polish tokens; null if operands and operators don't alternate or parentheses don't match."""
    out: list[str] = []
    waiting: list[str] = []
    operand = True
    for t in (text or "").split():
        if operand:
            if t == "(":
                waiting.append(t)
            elif _NUMBER.match(t):
                out.append(str(float(t)))
                operand = False
            else:
                return None
        elif t == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif t in _RANK:
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= _RANK[t]:
                out.append(waiting.pop())
            waiting.append(t)
            operand = True
        else:
            return None
    if operand or "(" in waiting:
        return None
    return out + waiting[::-1]


def evaluate(text: str | None) -> float | None:
    stack: list[float] = []
    for t in postfix(text) or ():
        if t in _APPLY:
            b, a = stack.pop(), stack.pop()
            try:
                v = _APPLY[t](a, b)
            except (ZeroDivisionError, OverflowError):
                return None
            if isinstance(v, complex):
                return None
            stack.append(v)
        else:
            stack.append(float(t))
    return stack[0] if stack else None


def bind(text: str, values: dict[str, float]) -> str | None:
    """Names replaced by their values; null if one has none."""
    out = []
    for t in text.split():
        if _NAME.match(t):
            if t not in values:
                return None
            t = str(values[t])
        out.append(t)
    return " ".join(out)


def snapshots(program: str | None) -> list[tuple[str, dict[str, float]]]:
    """Each statement with the names' values after it; of equal statements the last counts, at the place of the first. Ends before one that is not valid."""
    values: dict[str, float] = {}
    out: dict[str, dict[str, float]] = {}
    for statement in filter(None, (s.strip() for s in (program or "").split(";"))):
        if not statement.startswith("return "):
            name, eq, expr = statement.partition("=")
            name, bound = name.strip(), bind(expr, values)
            value = evaluate(bound) if eq and bound and _NAME.match(name) else None
            if value is None:
                break
            values[name] = value
        out[statement] = dict(values)
    return list(out.items())


def run(program: str | None) -> tuple[float | None, dict[str, float]]:
    """(value of the return statement, names at the end); null and no names if a statement is not valid."""
    values: dict[str, float] = {}
    for statement in filter(None, (s.strip() for s in (program or "").split(";"))):
        if statement.startswith("return "):
            bound = bind(statement[7:], values)
            return (evaluate(bound) if bound else None), values
        name, eq, expr = statement.partition("=")
        name, bound = name.strip(), bind(expr, values)
        value = evaluate(bound) if eq and bound and _NAME.match(name) else None
        if value is None:
            return None, {}
        values[name] = value
    return None, values


@F.pandas_udf(T.DoubleType())
def calculate(text: pd.Series) -> pd.Series:
    return text.map(evaluate).astype("float64")


@F.pandas_udf(T.StringType())
def to_postfix(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (p := postfix(t)) is None else " ".join(p))


@F.pandas_udf(T.DoubleType())
def run_program(text: pd.Series) -> pd.Series:
    return text.map(lambda t: run(t)[0]).astype("float64")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("statement", T.StringType()), T.StructField("names", T.MapType(T.StringType(), T.DoubleType()))])))
def run_snapshots(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"statement": s, "names": v} for s, v in snapshots(t)])


@F.pandas_udf(T.BooleanType())
def is_valid(text: pd.Series) -> pd.Series:
    return text.map(lambda t: postfix(t) is not None)
