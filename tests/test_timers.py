"""Timers of streams: they fire without a further event of their key, once, and after a restart."""

import tempfile

import pytest
from pyspark.sql import functions as F

from mailsift.streaming import timers


@pytest.fixture
def live(spark):
    """Adds a file of rows and runs the stream over what is new, from one checkpoint; gives all rows so far."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.STORE)
    source, out, mark = (tempfile.mkdtemp() for _ in range(3))

    def step(make, rows, schema):
        df = spark.createDataFrame(rows, schema)
        df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        q = make(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        return sorted(map(tuple, spark.read.schema(timers.OVERDUE if make is timers.overdue_cases else timers.TRACE).parquet(out).select("*").collect()))

    yield step
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_overdue_cases(live):
    schema = "case_id long, ts long, action string, priority int"
    t = 1_700_000_000
    first = [(1, t, "open", 1), (2, t, "open", 1), (2, t + 60, "claim", None), (2, t + 120, "resolve", None), (3, t, "open", None), (4, t, "claim", 1), (None, t, "open", 1)]
    assert live(timers.overdue_cases, first, schema) == []
    # Another case's event moves the watermark past the first one's hour; the stream has been restarted between.
    got = live(timers.overdue_cases, [(9, t + 3600 + 700, "open", 2)], schema)
    assert [(r[0], r[1], r[2], r[3].timestamp()) for r in got] == [(1, 1, "open", t + 3600)]
    got = live(timers.overdue_cases, [(1, t + 5000, "claim", None), (10, t + 90_000, "open", 3)], schema)
    assert [(r[0], r[2]) for r in got] == [(1, "open"), (3, "open"), (9, "open")]


def test_closed_traces(live):
    schema = "trace_id string, ts long, duration_ms long, error boolean"
    t = 1_700_000_000
    assert live(timers.closed_traces, [("a", t, 5000, False), ("a", t + 3, 100, True), ("b", t + 1, None, None), (None, t, 1, False)], schema) == []
    got = live(timers.closed_traces, [("b", t + 20, 1000, True), ("c", t + 40 + 600, 10, False)], schema)
    assert [(r[0], r[1].timestamp(), r[2].timestamp(), r[3], r[4]) for r in got] == [("a", t, t + 5, 2, 1)]
    got = live(timers.closed_traces, [("d", t + 5000, 10, False)], schema)
    assert [(r[0], r[3], r[4]) for r in got] == [("a", 2, 1), ("b", 2, 1), ("c", 1, 0)]
