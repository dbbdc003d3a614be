"""Carts: arrays of lines (id, product, color, price, count); arrays of structs with an id; stacks and lists as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# carts; every change drops coupon and discount, so totals are computed anew
def add(lines: Column, line: Column) -> Column:
    """One more of a line's product and color: the first such line counts one more, else the line is appended."""
    same = lambda x: (x["product"] == line["product"]) & (x["color"] == line["color"])
    at = F.array_position(F.transform(lines, same), True)
    return F.when(at > 0, F.transform(lines, lambda x, i: F.when(i == at - 1, x.withField("count", x["count"] + 1)).otherwise(x))).otherwise(F.concat(lines, F.array(line)))


def set_count(lines: Column, id_: Column, count: Column) -> Column:
    return F.transform(lines, lambda x: F.when(x["id"] == id_, x.withField("count", count)).otherwise(x))


def remove(lines: Column, id_: Column) -> Column:
    return F.filter(lines, lambda x: x["id"] != id_)


# elements by id
def element(a: Column, id_: Column) -> Column:
    """The first element with that id; null without one."""
    return F.get(F.filter(a, lambda x: x["id"] == id_), F.lit(0))


def position(a: Column, id_: Column) -> Column:
    """From 0; -1 without one."""
    return (F.array_position(F.transform(a, lambda x: x["id"]), id_) - 1).cast("int")


def patch(a: Column, id_: Column, **new: Column) -> Column:
    """Fields of the elements with that id replaced by what is given; null and blank leave the old value."""
    fill = lambda x, name, v: F.coalesce(F.nullif(v, F.lit("")), x[name])

    def one(x: Column) -> Column:
        for name, v in new.items():
            x = x.withField(name, fill(x, name, v))
        return x

    return F.transform(a, lambda x: F.when(x["id"] == id_, one(x)).otherwise(x))


# stacks: the top is the last element
def push(a: Column, v: Column) -> Column:
    return F.concat(a, F.array(v))


def peek(a: Column) -> Column:
    """Null if empty."""
    return F.get(a, F.size(a) - 1)


def pop(a: Column) -> Column:
    """An empty stack stays empty."""
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def capacity(n: Column, start: int = 4) -> Column:
    """Room of an array that starts with `start` places and doubles when full, after n appends."""
    return F.when(n <= start, F.lit(start)).otherwise((start * F.pow(F.lit(2.0), F.ceil(F.log2(n / start)))).cast("int"))


# linked lists: the front is the first element
def insert_front(a: Column, v: Column) -> Column:
    return F.concat(F.array(v), a)


def variants(parent: Column, stock: Column) -> Column:
    """Stock as text: 0 where missing, else trimmed."""
    return F.coalesce(F.trim(stock), F.lit("0"))
