"""Expressions on file names, paths and labels."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sorts behind every frame number.
LAST_FRAME = 10**12


def filename_number(name: Column | str) -> Column:
    """The stem as a number if it has digits only, else null."""
    return F.regexp_extract(name, r"^([0-9]+)[.][^.]*$", 1).try_cast("bigint")


def infer_split(path: Column | str) -> Column:
    """train, val or test, whichever stands first in this order among the path's parts; else
    unknown."""
    parts = F.split(path, "/")
    out = F.lit("unknown")
    for name in ("test", "val", "train"):
        out = F.when(F.array_contains(parts, name), name).otherwise(out)
    return out


def frame_key(frame: Column, name: Column) -> Column:
    """The frame as a number, else the digits of the name, else a number behind all others."""
    digits = F.nullif(F.regexp_replace(name, "[^0-9]", ""), F.lit("")).try_cast("bigint")
    return F.coalesce(frame.try_cast("double").try_cast("bigint"), digits, F.lit(LAST_FRAME))


def frame_number(frame: Column, name: Column) -> Column:
    """The frame as a whole number, else the stem of the name as one; a row that has neither fails
    the job and is named."""
    number = F.coalesce(F.trim(frame.cast("string")).try_cast("bigint"), F.regexp_extract(name, r"([^/]*?)([.][^./]*)?$", 1).try_cast("bigint"))
    return F.coalesce(number, F.raise_error(F.concat(F.lit("no frame number: "), F.coalesce(name, F.lit("null")))).cast("bigint"))


def casefold(name: Column | str) -> Column:
    """``name`` without case by the full folding of Unicode, as sorting and comparing file names
    takes it; Spark's lower() keeps letters apart that only folding joins."""

    @F.pandas_udf("string")
    def run(names: pd.Series) -> pd.Series:
        return names.str.casefold()

    return run(name)


def encode(label: Column | str, labels: Sequence[str]) -> Column:
    """Place (from 0) of the label, null if it isn't one."""
    value = F.col(label) if isinstance(label, str) else label
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), value), F.lit(0).cast("long")).cast("int") - 1


def decode(i: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*map(F.lit, labels)), i)


def or_else(value: Column, other: Column) -> Column:
    """``other`` where the value is null or blank."""
    return F.coalesce(F.nullif(value, F.lit("")), other)
