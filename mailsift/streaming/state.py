"""Stateful stream operators: the case lifecycle and token buckets.

Both fold a key's ordered events into a state with one step function. Over a table, rows are dealt by
key and put in order inside each partition, and a task holds one key's state at a time, so a key's
history may be of any length. On a stream a key's state is held between micro-batches and ends when
nothing has come for ``idle`` milliseconds; events are put in order inside each micro-batch, so a
stream and the table of its events agree where events don't overtake each other between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailsift.operators.workflow import NEXT

#: Of each action that moves a case: the states it applies to, and the next one.
STEPS = {a: x for a, x in NEXT.items() if x[1]}
CASE = "case_id long, state string, n_accepted long, n_refused long, last_seconds double"
CASE_STATE = "state string, n_accepted long, n_refused long, last_seconds double"
BUCKET = "key long, n_allowed long, n_refused long, level double, last_seconds double"
BUCKET_STATE = "n_allowed long, n_refused long, level double, last_seconds double"


def case_step(state: tuple, action: str, seconds: float) -> tuple:
    """The state after one event; stale and illegal events are refused and counted."""
    name, accepted, refused, last = state
    allowed, to = STEPS.get(action, ((), name))
    if seconds < last or name not in allowed:
        return name, accepted, refused + 1, last
    return to, accepted + 1, refused, seconds


def bucket_step(state: tuple, cost: float, seconds: float, per_second: float, capacity: float) -> tuple:
    """A token bucket after one request: refilled by the time passed, then charged or refused."""
    allowed, refused, level, last = state
    level = min(capacity, level + max(0.0, seconds - last) * per_second)
    last = max(last, seconds)
    return (allowed + 1, refused, level - cost, last) if level >= cost else (allowed, refused + 1, level, last)


#: Milliseconds after which a key without events is forgotten by a stream: ninety days.
IDLE = 90 * 24 * 3600 * 1000


def _in_order(df: DataFrame, key: str, order: list[str], start: tuple, step, schema: str) -> DataFrame:
    """Folds each key's rows in order, over a table: only the running state of the present key is held."""
    names, columns = [x.split()[0] for x in schema.split(", ")], [key, *order]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            done = []
            for row in f.itertuples(index=False):
                if state is None or row[0] != now:
                    if state is not None:
                        done.append((now, *state))
                    now, state = row[0], start
                state = step(state, *row[1:])
            yield pd.DataFrame(done, columns=names)
        if state is not None:
            yield pd.DataFrame([(now, *state)], columns=names)

    dealt = df.filter(df[key].isNotNull()).select(*columns).repartition(key).sortWithinPartitions(*columns)
    return dealt.mapInPandas(run, schema)


def _on_stream(df: DataFrame, key: str, order: list[str], start: tuple, step, schema: str, held_schema: str, idle: int) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        state = held.get if held.exists else start
        for row in pd.concat(list(frames))[order].sort_values(order).itertuples(index=False):
            state = step(state, *row)
        held.update(state)
        held.setTimeoutDuration(idle)
        yield pd.DataFrame([(k[0], *state)], columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, held_schema, "update", GroupStateTimeout.ProcessingTimeTimeout)


def fold_cases(events: DataFrame, idle: int = IDLE) -> DataFrame:
    """Final state of each case of (case_id, seconds, action): batch or stream."""
    start = ("open", 0, 0, float("-inf"))
    step = lambda state, seconds, action: case_step(state, action, seconds)
    if events.isStreaming:
        return _on_stream(events, "case_id", ["seconds", "action"], start, step, CASE, CASE_STATE, idle)
    return _in_order(events, "case_id", ["seconds", "action"], start, step, CASE)


def token_buckets(requests: DataFrame, per_minute: float = 6.0, capacity: float = 10.0, idle: int = IDLE) -> DataFrame:
    """Requests let through and refused for each key of (key, seconds, cost): batch or stream."""
    start = (0, 0, capacity, float("-inf"))
    step = lambda state, seconds, cost: bucket_step(state, cost, seconds, per_minute / 60, capacity)
    if requests.isStreaming:
        return _on_stream(requests, "key", ["seconds", "cost"], start, step, BUCKET, BUCKET_STATE, idle)
    return _in_order(requests, "key", ["seconds", "cost"], start, step, BUCKET)
