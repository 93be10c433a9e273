"""Confusion counts and classification metrics.

Labels are ids from 0; the number of labels is given, so that absent classes count as the chosen
rule says. Everything starts from one small table of counts (keys..., true_id, pred_id, n).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean IoU: absent classes are left out (nanmean), count as 0 (zerofill), or only classes with
#: support count (present).
IOU_RULES = ("nanmean", "zerofill", "present")


def confusion(rows: DataFrame, *keys: str, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    """(keys..., true_id, pred_id, n) of pairs that occur."""
    return rows.groupBy(*keys, F.col(true).alias("true_id"), F.col(pred).alias("pred_id")).agg(F.count(F.lit(1)).alias("n"))


def grid(df: DataFrame, labels: int) -> DataFrame:
    """Every (true_id, pred_id) pair."""
    ids = df.sparkSession.range(labels).select(F.col("id").cast("int").alias("true_id"))
    return ids.select("true_id", F.explode(F.array(*[F.lit(i) for i in range(labels)])).alias("pred_id"))


def confusion_full(counts: DataFrame, labels: int) -> DataFrame:
    """The confusion with zeros for pairs that don't occur."""
    return grid(counts, labels).join(F.broadcast(counts), ["true_id", "pred_id"], "left").select("true_id", "pred_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """A row for each true label, a column for each predicted one."""
    sums = [F.coalesce(F.sum(F.when(F.col("pred_id") == i, F.col("n"))), F.lit(0)).cast("long").alias(f"pred_{x}") for i, x in enumerate(labels)]
    return confusion_full(counts, len(labels)).groupBy("true_id").agg(*sums)


def per_class(counts: DataFrame, labels: int, *keys: str) -> DataFrame:
    """Support, predicted, tp, fp, fn, precision, recall, f1 and iou (null for an absent class) of
    every class, in one aggregation."""
    n, true, pred = F.col("n"), F.col("true_id"), F.col("pred_id")
    zero = F.lit(0).cast("long")
    every = [F.struct(F.lit(i).alias("class_id"), zero.alias("_s"), zero.alias("_p"), zero.alias("_t")) for i in range(labels)]
    ends = F.array(
        F.struct(true.alias("class_id"), n.alias("_s"), zero.alias("_p"), F.when(true == pred, n).otherwise(0).alias("_t")),
        F.struct(pred.alias("class_id"), zero.alias("_s"), n.alias("_p"), zero.alias("_t")),
        *(every if keys else []),
    )
    seen = counts.select(*keys, F.explode(ends).alias("x")).select(*keys, "x.*")
    if not keys:  # classes of an empty table too
        seen = seen.unionByName(counts.sparkSession.range(1).select(F.explode(F.array(*every)).alias("x")).select("x.*"))
    sums = seen.groupBy(*keys, "class_id").agg(F.sum("_s").alias("support"), F.sum("_p").alias("predicted"), F.sum("_t").alias("tp"))
    precision = F.col("tp") / F.greatest(F.col("predicted"), F.lit(1))
    recall = F.col("tp") / F.greatest(F.col("support"), F.lit(1))
    out = sums.withColumn("fp", F.col("predicted") - F.col("tp")).withColumn("fn", F.col("support") - F.col("tp")).withColumn("precision", precision).withColumn("recall", recall)
    out = out.withColumn("f1", 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)))
    return out.withColumn("iou", F.try_divide("tp", F.col("support") + F.col("predicted") - F.col("tp")))


def mean_iou(rule: str) -> Column:
    return {"nanmean": F.avg("iou"), "zerofill": F.avg(F.coalesce("iou", F.lit(0.0))), "present": F.avg(F.when(F.col("support") > 0, F.col("iou")))}[rule]


def summary(classes: DataFrame, rule: str, *keys: str) -> DataFrame:
    """rows, accuracy, weighted_f1, macro_f1, balanced_accuracy and miou of ``per_class`` rows."""
    size = F.sum("support")
    return classes.groupBy(*keys).agg(
        size.alias("rows"), F.try_divide(F.sum("tp"), size).alias("accuracy"), F.try_divide(F.sum(F.col("f1") * F.col("support")), size).alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"), F.avg("recall").alias("balanced_accuracy"), mean_iou(rule).alias("miou"),
    )


def metrics(rows: DataFrame, labels: int, rule: str, *keys: str, true: str = "true_id", pred: str = "pred_id") -> DataFrame:
    return summary(per_class(confusion(rows, *keys, true=true, pred=pred), labels, *keys), rule, *keys)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, for comparisons."""
    return df.select(*[F.round(c, places).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


METRIC_COLUMNS = ("rows", "accuracy", "weighted_f1", "macro_f1", "balanced_accuracy", "miou")


def enriched(rows: DataFrame) -> DataFrame:
    """Adds true_prob, pred_prob, margin of the two largest and is_error."""
    down = F.sort_array("probs", asc=False)
    return rows.withColumn("true_prob", F.get("probs", F.col("true_id"))).withColumn("pred_prob", F.get("probs", F.col("pred_id"))).withColumn("margin", down[0] - down[1]).withColumn("is_error", F.col("true_id") != F.col("pred_id"))


def prediction_distribution(rows: DataFrame, labels: int) -> DataFrame:
    """Predicted count and share of every class."""
    full = per_class(confusion(rows), labels)
    size = full.agg(F.sum("predicted").alias("size"))
    return full.crossJoin(F.broadcast(size)).select("class_id", F.col("predicted").alias("n"), F.try_divide("predicted", "size").alias("share"))


def fold_audit(rows: DataFrame, labels: int, ratio: Column, group: str) -> DataFrame:
    """Rows, classes present and missing, groups and the least and largest ratio of each fold."""
    every = F.array(*[F.lit(i) for i in range(labels)])
    return rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("n_groups"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio"),
        F.array_join(F.array_except(every, F.collect_set("true_id")), ",").alias("missing"),
    )
