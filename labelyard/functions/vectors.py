"""Expressions on arrays of numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column | str, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` evaluated once for a row. Where Spark puts a column's expression in
    place of its name, as in a filter that it pushes down, each use of the name evaluates it again, and
    one inside a lambda function does so for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def argmax(v: Column | str) -> Column:
    """Place (from 0) of the largest value; the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def total(v: Column | str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def scaled(v: Column | str, factor: Column | float) -> Column:
    return F.transform(v, lambda x: x * factor)


def mixed(a: Column | str, b: Column | str, share: Column | float) -> Column:
    """(1 - share) a + share b, place by place."""
    return F.zip_with(a, b, lambda x, y: (1 - share) * x + share * y)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column | str) -> Column:
    """The vector at length 1; a zero vector gives nulls."""
    size = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return once(v, lambda v: once(size(v), lambda size: F.transform(v, lambda x: F.try_divide(x.cast("double"), size))))


def softmax(v: Column | str) -> Column:
    e = lambda v: once(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return once(once(v, e), lambda e: once(total(e), lambda size: F.transform(e, lambda x: x / size)))


def margin(v: Column | str) -> Column:
    """The largest value less the second."""
    down = F.sort_array(v, asc=False)
    return down[0] - down[1]


def bits(v: Column | str, size: int) -> Column:
    """A long whose bits, the first highest, say whether each value exceeds the next (the last is
    compared with the first)."""
    step = lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(F.when(F.get(v, i) > F.get(v, (i + 1) % size), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0).cast("long"), step)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
