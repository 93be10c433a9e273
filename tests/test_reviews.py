"""The review state machine on a stream, and pruned reads of the alert folder."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from labelyard.streaming import alerts, reviews

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ACTIONS = "alert_id string, action string, ts timestamp, reason string"


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


@pytest.fixture()
def run(spark, tmp_path):
    """Runs batches of actions one after the other, each in a start of the stream of its own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def go(*batches, **options):
        source, sink = str(tmp_path / "in"), str(tmp_path / "out")
        for rows in batches:
            spark.createDataFrame(rows, ACTIONS).coalesce(1).write.mode("append").parquet(source)
            stream = reviews.changes(spark.readStream.schema(ACTIONS).parquet(source), **options)
            query = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert query.awaitTermination(180)
        return spark.read.parquet(sink).collect()

    yield go
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_confirmed_rejected_reopened_and_expired(run):
    rows = run(
        [("ALT-1", "open", at(0), None), ("ALT-2", "open", at(0), None), ("ALT-3", "open", at(0), None), ("ALT-4", "confirm", at(0), None)],
        [("ALT-1", "confirm", at(1), None), ("ALT-2", "reject", at(1), "  "), ("ALT-2", "reject", at(1, 5), "blurred"), ("ALT-1", "reject", at(1, 6), "too late")],
        [("ALT-2", "reopen", at(2), "second look"), ("ALT-2", "confirm", at(2, 30), None), ("ALT-1", "reopen", at(2), None)],
        [("ALT-9", "open", at(40), None)],
        [("ALT-3", "reopen", at(41), "found it"), ("ALT-3", "confirm", at(42), None)],
        expire=24, keep=100,
    )
    said = {}
    for r in sorted(rows, key=lambda r: (r["at"], r["n_changes"])):
        said.setdefault(r["alert_id"], []).append((r["action"], r["before"], r["status"], r["accepted"], r["event_id"], r["n_changes"]))
    assert said["ALT-1"] == [("open", None, "pending", True, None, 1), ("confirm", "pending", "confirmed", True, "EVT-1", 2), ("reject", "confirmed", "confirmed", False, None, 2), ("reopen", "confirmed", "confirmed", False, None, 2)]
    assert said["ALT-2"] == [
        ("open", None, "pending", True, None, 1), ("reject", "pending", "pending", False, None, 1), ("reject", "pending", "rejected", True, None, 2),
        ("reopen", "rejected", "pending", True, None, 3), ("confirm", "pending", "confirmed", True, "EVT-2", 4),
    ]
    assert said["ALT-3"] == [("open", None, "pending", True, None, 1), ("expire", "pending", "expired", True, None, 2), ("reopen", "expired", "pending", True, None, 3), ("confirm", "pending", "confirmed", True, "EVT-3", 4)]
    assert said["ALT-4"] == [("confirm", None, None, False, None, 0)]


def test_decided_alerts_are_forgotten(run):
    rows = run(
        [("ALT-1", "open", at(0), None), ("ALT-1", "confirm", at(1), None)],
        [("ALT-2", "open", at(50), None)], [("ALT-2", "confirm", at(51), None)],
        [("ALT-1", "open", at(52), None)],
        expire=24, keep=10,
    )
    own = [(r["action"], r["accepted"], r["n_changes"]) for r in sorted(rows, key=lambda r: r["at"]) if r["alert_id"] == "ALT-1"]
    assert own == [("open", True, 1), ("confirm", True, 2), ("open", True, 1)]


def test_batches_do_not_change_the_result(run):
    rng, rows = random.Random(7), []
    for k in range(12):
        hour = 0
        for _ in range(rng.randrange(1, 9)):
            hour += rng.randrange(1, 3)
            rows.append((f"ALT-{k}", rng.choice(["open", "confirm", "reject", "reopen", "view"]), at(hour, k), rng.choice([None, " ", "why"])))
    rows.sort(key=lambda r: r[2])
    want, state, n = [], {}, {}
    for alert, action, ts, reason in rows:
        after = reviews.step(state.get(alert), action, reason)
        n[alert] = n.get(alert, 0) + (after is not None)
        want.append((alert, ts, action, state.get(alert), after or state.get(alert), after is not None, n[alert]))
        state[alert] = after or state.get(alert)
    cut = len(rows) // 2
    found = run(rows[:cut], rows[cut:], late="100 hours", expire=1000, keep=1000)
    assert sorted((r["alert_id"], r["at"], r["action"], r["before"], r["status"], r["accepted"], r["n_changes"]) for r in found) == sorted(want, key=lambda r: r[:3])


def test_upsert_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "alerts")

    def batch(*rows):
        return spark.createDataFrame([(i, "c", 0.5, t) for i, t in rows], "detection_id string, category string, confidence double, t string").withColumn("ts", F.to_timestamp("t"))

    alerts.upsert_alerts(batch(*[(str(k), f"2024-{m:02d}-10") for k, m in enumerate(range(1, 13))], ("n", None)), 0, path)
    fresh = alerts.as_alerts(batch(("1", "2024-02-12"))).withColumn("day", F.to_date("created_at"))
    near = alerts.near_alerts(fresh, path, 7)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan and "2024-02-05" in near._jdf.queryExecution().optimizedPlan().toString()
    assert [r["alert_id"] for r in near.collect()] == ["ALT-1"] and len(near.inputFiles()) >= 1
    assert {r["alert_id"] for r in alerts.near_alerts(fresh.withColumn("day", F.lit(None).cast("date")), path, 7).collect()} == {"ALT-n"}
    alerts.upsert_alerts(batch(("1", "2024-02-12"), ("n", None)), 1, path)
    alerts.upsert_alerts(batch(("1", "2024-06-12")), 2, path)
    assert sorted(r["alert_id"] for r in spark.read.parquet(path).collect()) == sorted(["ALT-1", *[f"ALT-{k}" for k in range(12)], "ALT-n"])
