"""Stratified group folds."""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import join_split
from .manifest import positions
from .persist import cut


class Dealer:
    """Deals groups into folds, one after the other: each goes to the fold with which the class
    shares of the folds differ least (the mean over classes of the standard deviation), of equals
    the one with the fewest rows, then the first. Only whole numbers are kept, less what all folds
    have, so the choice depends on how the folds differ and on nothing else."""

    def __init__(self, folds: int, totals: list[int]):
        self.folds, self.totals = folds, [max(t, 1) for t in totals]
        self.held = [[0] * len(totals) for _ in range(folds)]

    def _cost(self, fold: int, group: list[int]) -> float:
        total = 0.0
        for c, (add, of) in enumerate(zip(group, self.totals, strict=True)):
            some = [h[c] for h in self.held]
            some[fold] += add
            total += sqrt(self.folds * sum(x * x for x in some) - sum(some) ** 2) / of
        return round(total, 12)

    def place(self, group: list[int]) -> int:
        best = min(range(self.folds), key=lambda k: (self._cost(k, group), sum(self.held[k]), k))
        self.held[best] = [x + y for x, y in zip(self.held[best], group, strict=True)]
        least = [min(x) for x in zip(*self.held, strict=True)]
        self.held = [[x - y for x, y in zip(h, least, strict=True)] for h in self.held]
        return best

    def deal(self, group: list[int], times: int) -> tuple[list[int], list[int]]:
        """The folds of ``times`` equal groups: the first ones, and a cycle that the others follow.

        Once each fold has got one group in a row of as many choices as folds, the folds differ as
        before that row, so the choices repeat."""
        first: list[int] = []
        while len(first) < times:
            first.append(self.place(group))
            row = first[-self.folds :]
            if len(set(row)) == self.folds:
                for k in range((times - len(first)) % self.folds):
                    self.held[row[k]] = [x + y for x, y in zip(self.held[row[k]], group, strict=True)]
                return first, row
        return first, first[-1:]


def group_folds(rows: DataFrame, group: str, label: str, labels: int, folds: int = 4, seed: int = 42) -> DataFrame:
    """(group, fold): all rows of a group in one fold, classes spread evenly.

    Groups are reduced to class counts first; groups with equal counts are alike. The distinct
    counts, of which there are few however many groups, are dealt largest spread first in one task,
    which holds one of them at a time; a group then takes its fold by its place among its equals, in
    the order of a seeded hash. This is what dealing the groups one by one would give, at every
    size. Null groups are a group of their own; rows with other labels don't count.
    """
    counts = rows.groupBy(group).agg(F.array(*[F.count_if(F.col(label) == i) for i in range(labels)]).alias("c"))
    kind = rows.schema[group].dataType.simpleString()
    counts = counts.withColumn("key", F.array_join(F.col("c").cast("array<string>"), ",")).withColumn("h", F.xxhash64(F.col(group), F.lit(seed)))
    placed = cut(positions(counts, "key", "h", group, name="place"))
    total, sums = placed.agg(F.count(F.lit(1)), F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(labels)])).first()
    if total < folds:
        raise ValueError(f"{total} groups for {folds} folds")
    shares = [F.get("c", F.lit(i)) / F.lit(float(max(s, 1))) for i, s in enumerate(sums)]
    mean = sum(shares[1:], shares[0]) / labels
    spread = F.round(F.sqrt(sum([(s - mean) * (s - mean) for s in shares], F.lit(0.0)) / labels), 9)
    vectors = placed.groupBy("key").agg(F.first("c").alias("c"), F.count(F.lit(1)).alias("n"), F.min("place").alias("start")).withColumn("spread", spread)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dealer = Dealer(folds, list(sums))
        for some in it:
            dealt = [dealer.deal([int(x) for x in c], int(n)) for c, n in zip(some["c"], some["n"], strict=True)]
            yield pd.DataFrame({"key": some["key"], "start": some["start"], "n": some["n"], "first": [a for a, _ in dealt], "cycle": [b for _, b in dealt]})

    dealt = cut(vectors.repartition(1).sortWithinPartitions(F.desc("spread"), "c").mapInPandas(run, "key string, start long, n long, first array<int>, cycle array<int>"))
    own = join_split(placed.select(F.col(group).alias("_group"), "key", "place"), dealt, "key", by="place", counts=dealt.select("key", "n"))
    at, known = F.col("place") - F.col("start"), F.size("first")
    fold = F.when(at < known, F.get("first", at.cast("int"))).otherwise(F.get("cycle", ((at - known) % F.size("cycle")).cast("int")))
    return own.select(F.col("_group").cast(kind).alias(group), fold.alias("fold"))


def sequence_groups(rows: DataFrame, group: str, allow_provisional: bool = False) -> DataFrame:
    """Adds ``group_id`` from provisional sequences, which must be asked for explicitly."""
    if not allow_provisional:
        raise ValueError("provisional sequences need allow_provisional=True")
    return rows.withColumn("group_id", F.concat(F.lit("sequence:"), F.col(group).cast("string")))


def split(index: DataFrame, everything: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """(filename, label, side): training rows from the enabled index outside the fold, validation
    rows from all labels inside it, both only if they have a fold."""
    train = index.join(folds.filter(F.col("fold") != fold), "filename").select("filename", "label", F.lit("train").alias("side"))
    val = everything.join(folds.filter(F.col("fold") == fold), "filename").select("filename", "label", F.lit("val").alias("side"))
    return train.unionByName(val)


def fold_safe(rows: DataFrame, folds: DataFrame, fold: int) -> DataFrame:
    """Synthetic rows (foreground, background) neither of whose sources lies in the fold."""
    fg = folds.select(F.col("filename").alias("foreground"), F.col("fold").alias("fg_fold"))
    bg = folds.select(F.col("filename").alias("background"), F.col("fold").alias("bg_fold"))
    return rows.join(fg, "foreground").join(bg, "background").filter((F.col("fg_fold") != fold) & (F.col("bg_fold") != fold))

