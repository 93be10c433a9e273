"""The review of alerts as a keyed state machine on a stream."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: From a state (None: not seen) by an action to a state.
TRANSITIONS = {
    (None, "open"): "pending",
    ("pending", "confirm"): "confirmed", ("pending", "reject"): "rejected",
    ("confirmed", "reopen"): "pending", ("rejected", "reopen"): "pending", ("expired", "reopen"): "pending",
}
#: Actions that need a reason.
REASONED = ("reject", "reopen")
CHANGES = "alert_id string, at timestamp, action string, before string, status string, accepted boolean, reason string, event_id string, n_changes int"
HOUR = 3_600_000


def step(status: str | None, action: str, reason: str | None) -> str | None:
    """The state after an action; None if it isn't allowed."""
    if action in REASONED and not (reason or "").strip():
        return None
    return TRANSITIONS.get((status, action))


class Reviews(StatefulProcessor):
    """One alert: its state, and all its changes as a list.

    An alert that stays pending for ``expire`` hours of event time expires; one that is decided or
    expired is forgotten ``keep`` hours later, and may then be opened anew. Both are timers on event
    time (a state's time to live would run on the clock of the machine, and a replay would differ).
    """

    def __init__(self, expire: int, keep: int):
        self.expire, self.keep = expire * HOUR, keep * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, opened timestamp")
        self.history = handle.getListState("history", "at timestamp, action string, status string")

    def _timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _set(self, status: str, at: datetime, action: str, now: int) -> int:
        self.state.update((status, at))
        self.history.appendValue((at, action, status))
        since = max(int(at.replace(tzinfo=timezone.utc).timestamp() * 1000), now)
        self._timer(since + (self.expire if status == "pending" else self.keep))
        return sum(1 for _ in self.history.get())

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        alert, now = key[0], max(timerValues.getCurrentWatermarkInMs(), 0)
        order = {a: i for i, a in enumerate(("open", "confirm", "reject", "reopen"))}
        # one alert's actions of one batch
        some = pd.concat(list(rows), ignore_index=True)
        some = some.assign(order=some["action"].map(order).fillna(len(order)), said=some["reason"].fillna("")).sort_values(["ts", "order", "said"])
        status, out = (self.state.get() or (None,))[0] if self.state.exists() else None, []
        for action, ts, reason in zip(some["action"], some["ts"], some["reason"], strict=True):
            at, reason = pd.Timestamp(ts).to_pydatetime(), None if pd.isna(reason) else reason
            after = step(status, action, reason)
            n = self._set(after, at, action, now) if after else sum(1 for _ in self.history.get())
            event = f"EVT-{alert[4:]}" if after == "confirmed" else None
            out.append((alert, at, action, status, after or status, after is not None, reason, event, n))
            status = after or status
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = datetime.fromtimestamp(expiredTimerInfo.getExpiryTimeInMs() / 1000, timezone.utc).replace(tzinfo=None)
        status = self.state.get()[0] if self.state.exists() else None
        if status == "pending":
            n = self._set("expired", at, "expire", max(timerValues.getCurrentWatermarkInMs(), 0))
            yield pd.DataFrame([(key[0], at, "expire", "pending", "expired", True, None, None, n)], columns=[c.split()[0] for c in CHANGES.split(", ")])
        else:
            self.state.clear()
            self.history.clear()

    def close(self) -> None:
        pass


def changes(actions: DataFrame, late: str = "1 hour", expire: int = 72, keep: int = 720) -> DataFrame:
    """A stream of state changes of alerts from a stream of (alert_id, action, ts, reason): open,
    confirm, reject and reopen, the last two with a reason.

    Actions that aren't allowed come out too, with ``accepted`` false and the state as it was, so a
    caller learns of them. ``n_changes`` counts the changes that the alert has had. Actions later
    than ``late`` go. Null ids are an alert of their own. The session needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``) and UTC as its time zone.
    """
    rows = actions.select(F.col("alert_id").cast("string").alias("alert_id"), F.col("action").cast("string").alias("action"), F.col("ts").cast("timestamp").alias("ts"), F.col("reason").cast("string").alias("reason"))
    return rows.withWatermark("ts", late).groupBy("alert_id").transformWithStateInPandas(Reviews(expire, keep), StructType.fromDDL(CHANGES), "Append", "EventTime")
