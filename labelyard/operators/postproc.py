"""Probability post-processing: thresholds, priors, smoothing, blends and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from .manifest import ranks
from .metrics import confusion, per_class, summary
from .persist import cut


def others_argmax(probs: Column | str, majority: int) -> Column:
    """The best class but for ``majority``."""
    return vectors.argmax(F.transform(probs, lambda x, i: F.when(i == majority, F.lit(-1.0)).otherwise(x)))


def majority_threshold(probs: Column | str, majority: int, threshold: Column | float) -> Column:
    """``majority`` if its probability reaches the threshold, else the best of the others."""
    return F.when(F.get(probs, F.lit(majority)) >= threshold, F.lit(majority)).otherwise(others_argmax(probs, majority))


def threshold_grid(start: float = 0.40, stop: float = 0.99, step: float = 0.01) -> list[float]:
    return [start + i * step for i in range(int(round((stop - start) / step)) + 1)]


def crossfit_thresholds(rows: DataFrame, labels: int, majority: int, grid: Sequence[float]) -> DataFrame:
    """(fold, threshold): the one with the largest weighted F1 on the other folds, the least of
    equals. Rows meet the grid only as counts: a row's prediction changes at one grid place."""
    place = F.size(F.filter(F.array(*[F.lit(t) for t in grid]), lambda t: F.get("probs", F.lit(majority)) >= t))
    # the first `place` thresholds predict the majority, the rest the best other class
    small = cut(rows.select("fold", "true_id", others_argmax("probs", majority).alias("other"), place.alias("place")).groupBy("fold", "true_id", "other", "place").agg(F.count(F.lit(1)).alias("n")))
    each = small.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))
    counts = each.groupBy("fold", "t", "true_id", F.when(F.col("t") < F.col("place"), F.lit(majority)).otherwise(F.col("other")).alias("pred_id")).agg(F.sum("n").alias("n"))
    folds = small.select(F.col("fold").alias("held")).distinct()
    # at most folds x grid x labels^2 counts
    others = counts.join(F.broadcast(folds), counts.fold != folds.held).groupBy("held", "t", "true_id", "pred_id").agg(F.sum("n").alias("n"))
    score = summary(per_class(others, labels, "held", "t"), "nanmean", "held", "t")
    best = score.groupBy("held").agg(F.max_by("t", F.struct(F.round("weighted_f1", 9), -F.col("t"))).alias("t"))
    return best.select(F.col("held").alias("fold"), F.get(F.array(*[F.lit(t) for t in grid]), F.col("t")).alias("threshold"))


def support_split(rows: DataFrame, fraction: float = 0.6, least: int = 4) -> DataFrame:
    """Adds ``is_support``: of each group of ``least`` rows or more, the first
    max(2, min(round(n * fraction), n - 2)) by frame; rounding is half to even."""
    some = ranks(rows, ["group_id"], "frame", "filename").filter(F.col("rank_n") >= least)
    take = F.greatest(F.lit(2), F.least(F.bround(F.col("rank_n") * fraction).cast("long"), F.col("rank_n") - 2))
    return some.withColumn("is_support", F.col("rank") <= take).drop("rank", "rank_n")


def class_shares(rows: DataFrame, labels: int, *keys: str) -> DataFrame:
    """(keys..., shares): shares of the true classes with one added to each count."""
    counts = [(F.count_if(F.col("true_id") == i) + 1).cast("double") for i in range(labels)]
    return rows.groupBy(*keys).agg(F.array(*counts).alias("c")).select(*keys, F.transform("c", lambda x: x / vectors.total("c")).alias("shares"))


def with_prior(probs: Column | str, own: Column | str, all_: Column | str, strength: Column | float) -> Column:
    """argmax(log max(p, 1e-8) + strength (log own - log all))"""
    lift = F.zip_with(own, all_, lambda a, b: F.log(a) - F.log(b))
    return vectors.argmax(F.zip_with(probs, lift, lambda p, x: F.round(F.log(F.greatest(p, F.lit(1e-8))) + strength * x, 9)))


def seen_prior(rows: DataFrame, labels: int, strengths: Sequence[float]) -> DataFrame:
    """Predictions of query rows for each strength: (event columns..., strength, pred_id)."""
    split = cut(support_split(rows))  # read for both sides
    own = class_shares(split.filter("is_support"), labels, "group_id").withColumnRenamed("shares", "own")
    everything = class_shares(rows, labels).withColumnRenamed("shares", "everything")
    query = split.filter("not is_support").drop("pred_id").join(own, "group_id").crossJoin(F.broadcast(everything))
    query = query.withColumn("strength", F.explode(F.array(*[F.lit(float(s)) for s in strengths])))
    return query.withColumn("pred_id", with_prior("probs", "own", "everything", F.col("strength"))).drop("own", "everything")


def exact_median(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., median): the mean of the middle two values, found by rank and not in one task's
    memory."""
    ranked = ranks(rows.select(*keys, value), keys, value)
    middle = F.col("rank").isin(F.floor((F.col("rank_n") + 1) / 2), F.floor(F.col("rank_n") / 2) + 1)
    return ranked.filter(middle).groupBy(*keys).agg(F.avg(value).alias("median"))


def group_median(rows: DataFrame, key: str, value: str = "probs") -> DataFrame:
    """(key, median): the exact median of each place, the mean of the middle two."""
    medians = exact_median(rows.select(key, F.posexplode(value).alias("i", "x")), [key, "i"], "x")
    return medians.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "median"))), lambda s: s["median"]).alias("median"))


def smoothed(rows: DataFrame, shares: Sequence[float]) -> DataFrame:
    """Predictions of query rows from (1 - share) p + share median of their group's support."""
    split = cut(support_split(rows))  # read for both sides, and twice to find ranges
    centre = group_median(split.filter("is_support"), "group_id")
    query = split.filter("not is_support").drop("pred_id").join(centre, "group_id").withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    mixed = F.zip_with("probs", "median", lambda p, m: F.round((1 - F.col("share")) * p + F.col("share") * m, 9))
    return query.withColumn("pred_id", vectors.argmax(mixed)).drop("median")


def blended(a: DataFrame, b: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(filename, true_id, weight, pred_id, changed) of files of both models."""
    both = a.select("filename", "true_id", "fold", F.col("probs").alias("pa"), F.col("pred_id").alias("first_id")).join(b.select("filename", F.col("probs").alias("pb")), "filename")
    both = both.withColumn("weight", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    pred = vectors.argmax(F.zip_with("pa", "pb", lambda x, y: F.round((1 - F.col("weight")) * x + F.col("weight") * y, 9)))
    return both.select("filename", "true_id", "fold", "weight", pred.alias("pred_id"), (pred != F.col("first_id")).alias("changed"))


def class_scaled(rows: DataFrame, target: int, factors: Sequence[float]) -> DataFrame:
    """Predictions with one class's probability times each factor, not normalised again."""
    each = rows.drop("pred_id").withColumn("factor", F.explode(F.array(*[F.lit(float(f)) for f in factors])))
    return each.withColumn("pred_id", vectors.argmax(F.transform("probs", lambda p, i: F.round(F.when(i == target, p * F.col("factor")).otherwise(p), 9))))


def margin_rule(probs: Column, pred: Column, target: int, a: int, b: int, factor: float, margin: float) -> Column:
    """A row predicted ``target`` goes to the likelier of a and b if the scaled probability doesn't
    lead them by ``margin``."""
    pa, pb = F.get(probs, F.lit(a)), F.get(probs, F.lit(b))
    short = F.round(F.get(probs, F.lit(target)) * factor - F.greatest(pa, pb), 9) < margin
    return F.when((pred == target) & short, F.when(pa >= pb, a).otherwise(b)).otherwise(pred)


def best_parameter(scores: DataFrame, parameter: str, metric: str) -> DataFrame:
    """The row with the largest metric, of equals the one with the least parameter."""
    return scores.orderBy(F.desc(F.round(metric, 9)), F.asc(parameter)).limit(1)


def balanced_softmax_loss(logits: Column, prior: Column, target: Column, smoothing: float) -> Column:
    """Cross-entropy of logits + log prior with label smoothing."""
    z = F.zip_with(logits, prior, lambda x, p: x + F.log(p))
    log_sum = F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x)))
    mean = vectors.total(z) / F.size(z)
    return log_sum - (1 - smoothing) * F.get(z, target) - smoothing * mean


def power_weights(rows: DataFrame, label: str, alpha: float) -> DataFrame:
    """Adds ``weight``: (rows of the label) ** -alpha."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("label_n"))
    return rows.join(counts, label).withColumn("weight", F.pow(F.col("label_n").cast("double"), F.lit(-alpha)))


def scene_weights(rows: DataFrame, label: str, target: int, scene: str) -> DataFrame:
    """Adds ``weight``: rows of the target class count equally by scene, others 1."""
    some = rows.filter(F.col(label) == target)
    n = some.groupBy(scene).agg(F.count(F.lit(1)).alias("scene_n"))
    size = n.agg(F.sum("scene_n").alias("total_n"), F.count(F.lit(1)).alias("scenes"))
    weight = F.when(F.col(label) == target, F.col("total_n") / (F.col("scenes") * F.col("scene_n"))).otherwise(1.0)
    return rows.join(n, scene, "left").crossJoin(F.broadcast(size)).withColumn("weight", weight).drop("scene_n", "total_n", "scenes")


def uniform(*keys: Column | str, seed: int) -> Column:
    """A number in [0, 1) that depends on keys and seed only: the first 32 bits of their md5, which
    other engines have too."""
    digest = F.md5(F.concat_ws(":", *keys, F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def prior_random(rows: DataFrame, labels: int, seed: int = 42) -> DataFrame:
    """Adds ``pred_id`` drawn from the class shares of the other folds."""
    counts = cut(rows.groupBy("fold", "true_id").agg(F.count(F.lit(1)).alias("n")))
    folds = counts.select(F.col("fold").alias("held")).distinct()
    sums = counts.join(F.broadcast(folds), counts.fold != folds.held).groupBy("held").agg(F.array(*[F.coalesce(F.sum(F.when(F.col("true_id") == i, F.col("n"))), F.lit(0)) for i in range(labels)]).alias("c"))
    below = F.transform("c", lambda x, i: F.aggregate(F.slice("c", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y))
    sums = sums.select(F.col("held").alias("fold"), below.alias("below"))
    drawn = uniform("filename", seed=seed) * F.element_at("below", -1)
    return rows.drop("pred_id").join(F.broadcast(sums), "fold").withColumn("pred_id", F.size(F.filter("below", lambda x: x <= drawn)).cast("int")).drop("below")


def uniform_random(rows: DataFrame, labels: int, seed: int = 42) -> DataFrame:
    """Adds ``pred_id`` drawn from all labels alike."""
    return rows.withColumn("pred_id", F.floor(uniform("filename", seed=seed) * labels).cast("int"))


def early_stop(history: DataFrame, run: str, epoch: str, metric: str, patience: int) -> DataFrame:
    """Adds ``improved``, ``stale`` and ``stopped`` (an epoch after which training had ended)."""
    w = Window.partitionBy(run).orderBy(epoch)
    before = F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = history.withColumn("improved", F.coalesce(F.col(metric) > before, F.lit(True)))
    last = F.max(F.when(F.col("improved"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("stale", F.col(epoch) - last)
    ended = F.min(F.when(F.col("stale") >= patience, F.col(epoch))).over(Window.partitionBy(run))
    return rows.withColumn("stopped", F.coalesce(F.col(epoch) > ended, F.lit(False)))


def counts_by(rows: DataFrame, labels: int, *keys: str) -> DataFrame:
    return per_class(confusion(rows, *keys), labels, *keys)
