"""Sampling with replacement by weight."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .persist import cut

#: A weight is taken in steps of the largest weight / STEPS, a positive one as one step at least.
STEPS = 1 << 24


def _placed(df: DataFrame, *order: str) -> DataFrame:
    """``df`` in range partitions of its order, written, with ``_id`` in that order and ``_part``."""
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumn("_part", F.shiftright("_id", 33))


def _inside(last: int) -> WindowSpec:
    return Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, last)


def running_sum(df: DataFrame, *order: str, value: str, name: str = "before") -> DataFrame:
    """Adds the sum of the whole numbers ``value`` of all rows before, in a total order: range
    partitions are summed up inside and get the sum of those before, so that no task sees all."""
    rows = _placed(df, *order)
    sums = rows.groupBy("_part").agg(F.sum(value).alias("_n"))
    # a row for each partition
    before = F.broadcast(sums.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before")))
    own = F.coalesce(F.sum(value).over(_inside(-1)), F.lit(0))
    return rows.withColumn(name, own).join(before, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_id", "_part", "_before")


def carried(df: DataFrame, *order: str, value: str) -> DataFrame:
    """``df`` with each null of ``value`` replaced by the last value before it, in a total order.
    A partition begins with the last value of those before it."""
    rows = _placed(df, *order)
    ends = rows.groupBy("_part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_id"))).alias("_end"))
    # a row for each partition
    prior = F.broadcast(ends.select("_part", F.last("_end", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_prior")))
    last = F.last(value, ignorenulls=True).over(_inside(0))
    return rows.withColumn(value, last).join(prior, "_part").withColumn(value, F.coalesce(value, "_prior")).select(*df.columns)


def point(draw: Column, total: int, seed: int) -> Column:
    """A whole number below ``total``: 120 bits of an md5, modulo ``total``."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), draw.cast("string")).cast("binary"))
    high, low = (F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(19,0)") for at in (1, 16))
    return ((high * F.lit(Decimal(1 << 60)) + low) % F.lit(Decimal(total))).cast("long")


def weighted_sample(rows: DataFrame, key: str, weight: str, draws: int | None = None, seed: int = 42) -> DataFrame:
    """(draw, columns of ``rows``): for each draw from 0 to ``draws`` (None: as many as rows) the row
    that it hits, with replacement and with a probability in proportion to its weight.

    Rows lie side by side on a line, each as long as its weight, in order of ``key``; a draw is a
    point on it. Rows and points are sorted together in range partitions and each point takes the
    row that begins last before it. So a row that takes a third of all draws and a million rows that
    take none are both spread over tasks. Rows with a null, negative, zero or NaN weight are never
    drawn; draws from nothing give no rows. A draw's point depends on its number and the seed alone.
    """
    w = F.when(~F.isnan(F.col(weight).cast("double")) & (F.col(weight) > 0), F.col(weight).cast("double"))
    facts = rows.agg(F.max(w).alias("top"), F.count(F.lit(1)).alias("n")).first()
    n = facts["n"] if draws is None else draws
    spark, some = rows.sparkSession, rows.limit(0) if facts["top"] is None else rows
    units = F.greatest(F.lit(1), F.round(w / F.lit(facts["top"] or 1.0) * STEPS)).cast("long")
    line = running_sum(some.filter(w.isNotNull()).select(F.struct(*rows.columns).alias("_row"), F.col(key).alias("_key"), units.alias("_units")), "_key", "_units", value="_units", name="_at")
    total = line.agg(F.sum("_units")).first()[0]
    points = spark.range(n if total else 0).select(F.col("id").alias("draw"), point(F.col("id"), total or 1, seed).alias("_at"), F.lit(1).alias("_point"))
    both = line.select("_row", "_at", F.lit(0).alias("_point")).unionByName(points, allowMissingColumns=True)
    return carried(both, "_at", "_point", "draw", value="_row").filter("_point = 1").select("draw", "_row.*")
