"""Joins whose hot keys are split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot with more than one in so many of all rows, so there are fewer hot keys than that.
SHARES = 1000
#: Rows that aren't worth a part of their own.
LEAST = 100


def key_counts(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that aren't null."""
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def part_rows(total: int) -> int:
    """Rows of one part; a key with more is hot."""
    return max(total // SHARES, LEAST)


def join_split(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined (inner or left) with ``table``, which has few rows for each key.

    The rows of a hot key are dealt by the hash of ``by`` in parts of about one in SHARES of all
    rows, and the key's rows in ``table`` are repeated for each part. ``counts``: the keys' numbers
    of rows (key, n), where they are known. Rows with a null key match nothing and aren't moved.
    """
    counts = key_counts(rows, key) if counts is None else counts
    share = part_rows(counts.agg(F.sum("n")).first()[0] or 0)
    # fewer than SHARES rows
    hot = F.broadcast(counts.filter(F.col("n") > share).select(F.col(key).alias("_hot"), F.ceil(F.col("n") / share).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    some = rows.filter(F.col(key).isNotNull()) if how == "left" else rows
    left = some.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.array(F.pmod(F.xxhash64(by), parts).cast("int")))).drop("_hot", "_parts")
    right = table.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_hot", "_parts")
    joined = left.join(right, [key, "_part"], how).drop("_part")
    return joined.unionByName(rows.filter(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else joined
