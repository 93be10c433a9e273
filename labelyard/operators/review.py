"""Human reviews: rules, application, audits, and comparison of result lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule_violations(decisions: DataFrame) -> DataFrame:
    """(filename, rule) of each broken rule: confirmed and uncertain keep the label, relabel changes
    it, notes aren't blank."""
    same = F.col("reviewed_label") == F.col("official_label")
    status = F.col("review_status")
    broken = F.array_compact(F.array(
        F.when((status == "confirmed") & ~same, "confirmed_changes"), F.when((status == "relabel") & same, "relabel_keeps"), F.when((status == "uncertain") & ~same, "uncertain_changes"),
        F.when(F.trim(F.coalesce("review_notes", F.lit(""))) == "", "blank_notes"),
    ))
    return decisions.select("filename", F.explode(broken).alias("rule"))


def applied(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """labels (filename, label, ...) with reviewed labels in place, and whether they changed."""
    rows = labels.join(decisions.select("filename", "reviewed_label"), "filename", "left")
    new = F.coalesce("reviewed_label", "label")
    return rows.withColumn("new_label", new).withColumn("changed", new != F.col("label")).drop("reviewed_label")


def changes(rows: DataFrame) -> DataFrame:
    """(label, new_label, n) of changed rows."""
    return rows.filter("changed").groupBy("label", "new_label").agg(F.count(F.lit(1)).alias("n"))


def passthrough(labels: DataFrame, decisions: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """A label version that takes no decision: the labels (filename, label) as they are, with
    ``label_version``, and its audit of one row: records, decisions, decisions that would have
    changed a label, and labels changed, which are none."""
    rows = labels.withColumn("label_version", F.lit(version))
    waiting = labels.join(decisions.select("filename", "reviewed_label"), "filename", "left")
    would = F.coalesce(F.col("reviewed_label") != F.col("label"), F.lit(False))
    audit = waiting.agg(F.lit(version).alias("label_version"), F.count(F.lit(1)).alias("records"), F.count("reviewed_label").alias("decisions"), F.count_if(would).alias("not_applied"), F.lit(0).cast("long").alias("changed"))
    return rows, audit


def change_impact(official: Column, reviewed: Column, pred: Column) -> Column:
    """What a changed label does to a prediction."""
    before, after = pred == official, pred == reviewed
    return F.when(official == reviewed, "unchanged").when(~before & after, "becomes_correct").when(before & ~after, "becomes_error").when(before & after, "stays_correct").otherwise("stays_error")


def positional_diff(a: DataFrame, b: DataFrame, position: str, fields: Sequence[str]) -> DataFrame:
    """(position, differs): the fields in which two lists differ at each place; a missing side
    compares as empty. Equal places are left out."""
    x = a.select(position, *[F.col(f).cast("string").alias(f"a_{f}") for f in fields])
    y = b.select(position, *[F.col(f).cast("string").alias(f"b_{f}") for f in fields])
    off = F.array_compact(F.array(*[F.when(F.coalesce(f"a_{f}", F.lit("")) != F.coalesce(f"b_{f}", F.lit("")), f) for f in fields]))
    return x.join(y, position, "full").select(position, F.array_join(off, ",").alias("differs")).filter("differs <> ''")


def submission(rows: DataFrame, label: str) -> DataFrame:
    """Records of four strings."""
    return rows.select(F.col("filename").cast("string").alias("filename"), F.col("width").cast("string").alias("width"), F.col("height").cast("string").alias("height"), F.lit(label).alias("label"))


def merge_reasons(rows: DataFrame, key: str, reason: str, order: str) -> DataFrame:
    """(key, reasons): distinct reasons in first order, joined by `||`. Repetitions go before the
    lists are made."""
    first = rows.groupBy(key, F.col(reason).alias("r")).agg(F.min(order).alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "r"))), lambda x: x["r"])
    return first.groupBy(key).agg(F.array_join(listed, "||").alias("reasons"))
