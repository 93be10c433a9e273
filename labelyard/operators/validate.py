"""Validators: each returns the rows that break a rule; ``require`` raises if there are any."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import once


def require(violations: DataFrame, what: str) -> None:
    """Raises ValueError with an example if there is a violation. One action."""
    if found := violations.take(1):
        raise ValueError(f"{what}: {found[0].asDict()}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")


def require_rows(df: DataFrame, expected: int | None = None) -> None:
    """Raises if the table is empty, or if its rows aren't ``expected``."""
    if expected is None:
        if df.isEmpty():
            raise ValueError("no rows")
    elif (n := df.count()) != expected:
        raise ValueError(f"{n} rows, expected {expected}")


def duplicate_keys(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def outside_domain(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Rows whose value is null or not allowed."""
    return df.filter(~F.coalesce(F.col(column).isin(list(allowed)), F.lit(False)))


def simplex_violations(df: DataFrame, probs: str, size: int, tolerance: float = 2e-5) -> DataFrame:
    """Rows whose probabilities aren't ``size`` finite numbers in [0, 1] that sum to 1."""
    total = lambda p: F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    odd = lambda p: F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    broken = once(probs, lambda p: (F.size(p) != size) | odd(p) | (F.abs(total(p) - 1) > tolerance))
    return df.filter(F.coalesce(broken, F.lit(True)))


def missing_parents(child: DataFrame, parent: DataFrame, *keys: str) -> DataFrame:
    return child.join(parent, list(keys), "left_anti")


def key_set_difference(df: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, n_found, n_expected) of keys that don't occur once in each."""
    a, b = (x.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for x, n in ((df, "n_found"), (expected, "n_expected")))
    return a.join(b, key, "full").na.fill(0).filter("n_found <> 1 or n_expected <> 1")


def out_of_order(df: DataFrame, position: str, order: str) -> DataFrame:
    """Rows whose stored position isn't their place (from 0) by ``order``. Places come from range
    partitions and their offsets, not from one global window."""
    from .manifest import positions

    return positions(df, order, name="_place").filter(F.col(position) != F.col("_place")).withColumnRenamed("_place", "expected")
