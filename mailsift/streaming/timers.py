"""Event-time timers: cases that pass their time, and traces that have ended, reported when the watermark passes them.

A timer belongs to a key and fires without a further event of that key, also after a restart from the
checkpoint. State is one small record a key and goes with the case's or trace's end. Timers need the
RocksDB state store: ``spark.sql.streaming.stateStore.providerClass`` is to be set so before the stream starts.

Defined cases: events without a key or time go; events of a micro-batch are taken in order of time, then
action; events later than the watermark allows are dropped, as by any stateful operator.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mailsift.operators.review import ACTIVE, SLA_SECONDS

from .state import STEPS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OVERDUE = "case_id long, priority int, state string, due timestamp"
TRACE = "trace_id string, started timestamp, ended timestamp, n_spans long, n_errors long"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
    times = [x.split()[0] for x in schema.split(", ") if x.endswith("timestamp")]
    return out.assign(**{c: pd.to_datetime(out[c], unit="ms") for c in times})


class _Overdue(StatefulProcessor):
    """A case's state, the time it is due, and whether that was reported."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.case = handle, handle.getValueState("case", "state string, priority int, due long, reported boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.case.get()) if self.case.exists() else None
        old = now
        for e in pd.concat(list(rows)).sort_values(["ms", "action"]).itertuples(index=False):
            if now is None:
                if e.action == "open":
                    priority = 3 if pd.isna(e.priority) else int(e.priority)
                    now = "open", priority, int(e.ms) + 1000 * SLA_SECONDS.get(priority, SLA_SECONDS[3]), False
                continue
            allowed, to = STEPS.get(e.action, ((), now[0]))
            if now[0] in allowed:
                now = (to, *now[1:])
        if now is not None:
            self.case.update(now)
            waits, waited = (x is not None and x[0] in ACTIVE and not x[3] for x in (now, old))
            if waits and not waited:
                self.handle.registerTimer(now[2])
            elif waited and not waits:
                self.handle.deleteTimer(now[2])
        yield _frame([], OVERDUE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, priority, due, reported = tuple(self.case.get())
        self.case.update((state, priority, due, True))
        yield _frame([(key[0], priority, state, due)] if state in ACTIVE and not reported else [], OVERDUE)

    def close(self) -> None:
        pass


def overdue_cases(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(case_id, priority, state, due) of a stream of (case_id, ts, action, priority): each case once, when it is still active at its time.

    A case begins with the action ``open``; a resolved one has no timer, and one reopened before its time waits again.
    """
    x = events.filter("case_id is not null and ts is not null").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return x.groupBy("case_id").transformWithStateInPandas(_Overdue(), OVERDUE, "append", "eventTime")


class _Closing(StatefulProcessor):
    """A trace's first and last span, its counts, and the timer set at its end."""

    def __init__(self, idle: int) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.trace = handle, handle.getValueState("trace", "first long, last long, n long, errors long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, last, n, errors = tuple(self.trace.get()) if self.trace.exists() else (None, None, 0, 0)
        set_at = last
        for f in rows:
            low, high = int(f["ms"].min()), int(f["end_ms"].max())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
            n, errors = n + len(f), errors + int(f["error"].fillna(False).sum())
        if last != set_at:
            if set_at is not None:
                self.handle.deleteTimer(set_at + self.idle)
            self.handle.registerTimer(last + self.idle)
        self.trace.update((first, last, n, errors))
        yield _frame([], TRACE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = tuple(self.trace.get())
        self.trace.clear()
        yield _frame([(key[0], *row)], TRACE)

    def close(self) -> None:
        pass


def closed_traces(spans: DataFrame, idle_seconds: int = 30, late: str = "10 minutes") -> DataFrame:
    """One row for each trace of a stream of (trace_id, ts, duration_ms, error), ``idle_seconds`` after its last span has ended."""
    x = spans.filter("trace_id is not null and ts is not null").withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    x = x.withColumn("end_ms", F.col("ms") + F.coalesce(F.col("duration_ms"), F.lit(0)).cast("long"))
    return x.groupBy("trace_id").transformWithStateInPandas(_Closing(1000 * idle_seconds), TRACE, "append", "eventTime")
