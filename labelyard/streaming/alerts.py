"""The alert service as Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.service import alerts as as_alerts
from ..operators.service import window_counts
from ..sources.readers import DETECTIONS


def read_detections(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """New JSON lines files of a folder as detections with an event time."""
    rows = spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", files).json(path)
    return rows.withColumn("ts", F.col("observed_at").try_cast("timestamp"))


def ingest(detections: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of alerts, each id once within the time that events may be late."""
    summary = F.concat(F.coalesce("category", F.lit("unknown")), F.lit(" "), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))))
    rows = detections.select(F.concat(F.lit("ALT-"), F.col("detection_id").cast("string")).alias("alert_id"), F.lit("pending").alias("status"), summary.alias("rule_summary"), F.col("ts").alias("created_at"))
    return rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["alert_id"])


#: Milliseconds of event time for which a decided alert is remembered.
KEEP = 30 * 24 * 3_600_000


def _decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches), ignore_index=True)
    if state.exists:
        return
    reason = rows["reason"].fillna("").str.strip()
    valid = rows[(rows["action"] == "confirm") | ((rows["action"] == "reject") & (reason != ""))]
    if len(valid):
        first = valid.sort_values(["ts", "action", "reason"]).iloc[:1]
        state.update((first["action"].iloc[0],))
        decided = int(first["ts"].iloc[0].timestamp() * 1000)
        state.setTimeoutTimestamp(max(decided, state.getCurrentWatermarkMs()) + KEEP)
        status = "confirmed" if first["action"].iloc[0] == "confirm" else "rejected"
        yield pd.DataFrame({"alert_id": [key[0]], "status": [status], "reviewed_at": first["ts"].to_numpy(), "reject_reason": [first["reason"].iloc[0] if status == "rejected" else None]})


def decisions(actions: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of first decisions from a stream of (alert_id, action, ts, reason): once decided,
    an alert's later actions change nothing while it is remembered, which is until the watermark
    lies KEEP behind the decision. Actions that are later than ``late`` go."""
    return actions.withWatermark("ts", late).groupBy("alert_id").applyInPandasWithState(_decide, "alert_id string, status string, reviewed_at timestamp, reject_reason string", "action string", "append", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, late: str = "1 hour", width: str = "15 minutes", slide: str | None = None, *keys: str) -> DataFrame:
    """Counts and totals of (ts, value) events in windows that close with the watermark."""
    return window_counts(events.withWatermark("ts", late), F.window("ts", width, slide or width), *keys)


def upsert_alerts(batch: DataFrame, _: int, path: str, days: int = 7) -> None:
    """For foreachBatch: alerts of a batch beside those in a Parquet folder, partitioned by the day
    of ``created_at``. An id is not repeated within ``days`` before and after; only these days'
    folders are read, by a filter on the partition column. Alerts without a time lie in a folder of
    their own and are compared among themselves."""
    fresh = as_alerts(batch).withColumn("day", F.to_date("created_at"))
    known = near_alerts(fresh, path, days)
    if known is not None:
        fresh = fresh.join(known.select("alert_id"), "alert_id", "left_anti").select(*fresh.columns)
    fresh.write.mode("append").partitionBy("day").parquet(path)


def near_alerts(fresh: DataFrame, path: str, days: int) -> DataFrame | None:
    """The alerts of the folder whose day is near one of ``fresh``; None if there is no folder."""
    try:
        known = fresh.sparkSession.read.schema(fresh.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # a value for each day of the calendar that a batch has
    own = [r["day"] for r in fresh.select("day").distinct().collect()]
    near = sorted({d + timedelta(days=k) for d in own if d is not None for k in range(-days, days + 1)})
    dated = F.col("day").isin(near) if near else F.lit(False)
    return known.filter(dated | F.col("day").isNull() if None in own else dated)
