"""Detections to alerts, reviews, events and work orders, as batch operators.

Ingestion is idempotent by alert id, an alert's first decision stands, and updates to unknown states
change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .manifest import first_by

ORDER_STATES = ("pending", "in_progress", "completed")


def alerts(detections: DataFrame) -> DataFrame:
    """(alert_id, status, rule_summary, created_at) of detections (detection_id, category,
    confidence, ts), the first of each id."""
    summary = F.concat(F.coalesce("category", F.lit("unknown")), F.lit(" "), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))))
    rows = detections.select(F.concat(F.lit("ALT-"), F.col("detection_id").cast("string")).alias("alert_id"), F.lit("pending").alias("status"), summary.alias("rule_summary"), F.col("ts").alias("created_at"))
    return first_by(rows, ["alert_id"], "created_at", "rule_summary")


def with_status(alerts_: DataFrame, status: str | None) -> DataFrame:
    return alerts_ if status is None else alerts_.filter(F.col("status") == status)


def first_decisions(actions: DataFrame) -> DataFrame:
    """(alert_id, action, ts, reason): the first valid action; rejections need a reason."""
    valid = actions.filter((F.col("action") == "confirm") | ((F.col("action") == "reject") & (F.coalesce(F.trim("reason"), F.lit("")) != "")))
    first = F.min_by(F.struct("action", "ts", "reason"), F.struct("ts", "action", "reason"))
    return valid.groupBy("alert_id").agg(first.alias("d")).select("alert_id", "d.*")


def reviewed(alerts_: DataFrame, actions: DataFrame) -> DataFrame:
    """Alerts with their state after the first decision."""
    state = F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))
    return alerts_.join(first_decisions(actions), "alert_id", "left").select("alert_id", state.alias("status"), F.col("ts").alias("reviewed_at"), F.when(F.col("action") == "reject", F.col("reason")).alias("reject_reason"))


def events(reviewed_: DataFrame) -> DataFrame:
    """An event of each confirmed alert."""
    return reviewed_.filter("status = 'confirmed'").select(F.concat(F.lit("EVT-"), F.substring("alert_id", 5, 99)).alias("event_id"), "alert_id", F.lit("open").alias("status"), F.col("reviewed_at").alias("created_at"))


def work_orders(events_: DataFrame, requests: DataFrame) -> DataFrame:
    """Orders of requests (event_id, request_id, assignee) for events that exist."""
    return requests.join(events_.select("event_id"), "event_id").select(F.concat(F.lit("WO-"), F.col("request_id").cast("string")).alias("order_id"), "event_id", "assignee", F.lit("pending").alias("status"))


def refused(updates: DataFrame) -> DataFrame:
    """The updates that ``latest_orders`` leaves out: those to a null or unknown state."""
    return updates.filter(~F.coalesce(F.col("status").isin(*ORDER_STATES), F.lit(False)))


def latest_orders(updates: DataFrame) -> DataFrame:
    """The last state of each order (order_id, status, ts, feedback); the last feedback that isn't
    blank stays; completed_at only for completed orders. ``refused`` updates change nothing."""
    some = updates.filter(F.col("status").isin(*ORDER_STATES))
    said = F.when(F.coalesce(F.trim("feedback"), F.lit("")) != "", F.struct("ts", "feedback"))
    last = some.groupBy("order_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max(said).alias("f"), F.max(F.when(F.col("status") == "completed", F.col("ts"))).alias("done"))
    return last.select("order_id", "status", F.col("f.feedback").alias("feedback"), F.when(F.col("status") == "completed", F.col("done")).alias("completed_at"))


def replay(**tables: tuple[DataFrame, str, str]) -> DataFrame:
    """(kind, id, at): rows of several tables (frame, id column, time column) as one timeline."""
    out = None
    for kind, (df, key, at) in tables.items():
        rows = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(at).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out


def features(rows: DataFrame, geometry: str, *properties: str) -> DataFrame:
    """GeoJSON features of rows that have a geometry."""
    return rows.filter(F.col(geometry).isNotNull()).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(geometry).alias("geometry"), F.struct(*properties).alias("properties"))).alias("feature"))


def window_counts(rows: DataFrame, window: Column, *keys: str) -> DataFrame:
    """(start, end, keys..., n, total) of rows (ts, value) in windows; works on streams too."""
    return rows.groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")
