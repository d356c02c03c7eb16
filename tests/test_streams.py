"""Streams against the same functions over tables, and the state machines' steps."""

import tempfile

from pyspark.sql import functions as F

from mailsift.sources.tables import table, view
from mailsift.operators import decide, drift
from mailsift.streaming import scoring, state, windows

SF = "/root/testdata/sf0.001"


def collected(spark, stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_windows_agree(spark):
    events = table(spark, SF, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    columns = ("event_id AS decision_id", "ts AS created_ts", "CASE WHEN event_id % 3 = 0 THEN 'BLOCK' ELSE 'ALLOW' END AS band", "event_id % 2 AS behavioral_available")
    batch = windows.band_ratios(events.selectExpr(*columns), "1 day").collect()
    live = collected(spark, windows.band_ratios(stream.selectExpr(*columns), "1 day"), "ratios", "complete").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, live))


def test_case_fold(spark):
    steps = [(1, "claim", 1.0), (1, "resolve", 2.0), (1, "claim", 3.0), (2, "resolve", 1.0), (2, "claim", 5.0), (2, "unclaim", 4.0)]
    rows = spark.createDataFrame(steps, "case_id long, action string, seconds double")
    got = {r.case_id: (r.state, r.n_accepted, r.n_refused) for r in state.fold_cases(rows).collect()}
    assert got == {1: ("resolved", 2, 1), 2: ("in_review", 1, 2)}


def test_case_stream(spark):
    d = tempfile.mkdtemp()
    rows = spark.createDataFrame([(1, "claim", 1.0), (1, "resolve", 2.0), (2, "claim", 1.0)], "case_id long, action string, seconds double")
    rows.coalesce(1).write.mode("overwrite").parquet(d)
    stream = state.fold_cases(spark.readStream.schema(rows.schema).parquet(d))
    live = collected(spark, stream, "cases", "update").groupBy("case_id").agg(F.max_by("state", "n_accepted").alias("state")).collect()
    assert {r.case_id: r.state for r in live} == {1: "resolved", 2: "in_review"}


def test_token_bucket(spark):
    rows = spark.createDataFrame([(1, 1.0, float(t)) for t in range(15)], "key long, cost double, seconds double")
    r = state.token_buckets(rows, per_minute=6.0, capacity=10.0).first()
    assert (r.n_allowed, r.n_refused) == (11, 4)


def test_alert_runs(spark):
    log = view(spark, SF, "fx_decisions")
    w = windows.band_ratios(log, "1 day")
    assert windows.alerts_for(w, "n > 0", 3, 86400).count() == w.count() - 2


def test_case_fold_of_a_long_history(spark):
    rows = spark.range(5000).selectExpr("id % 2 AS case_id", "CASE WHEN id % 4 < 2 THEN 'claim' ELSE 'unclaim' END AS action", "CAST(id AS DOUBLE) AS seconds").repartition(7)
    got = {r.case_id: (r.state, r.n_accepted, r.n_refused) for r in state.fold_cases(rows).collect()}
    assert got == {0: ("open", 2500, 0), 1: ("open", 2500, 0)}


def test_streamed_decisions_agree(spark):
    d = tempfile.mkdtemp()
    rows = spark.range(200).selectExpr("id", *(f"CAST((id * {k}) % 1000 AS DOUBLE) / 1000 AS {m}" for k, m in ((7919, "m_a"), (104729, "m_b"), (1299709, "m_c"))), "id % 3 > 0 AS available", "id % 50 AS burst_count_1h", "id % 5 = 0 AS first_seen", "id % 2 AS domain_report_count", "id % 4 AS display_name_alias_count")
    rows.repartition(4).write.parquet(f"{d}/in")
    model = decide.Fusion({"m_a": 1.0, "m_b": 2.0, "m_c": 1.5}, -2.0)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    scoring.decisions_stream(stream, model, f"{d}/decisions", f"{d}/cases", f"{d}/check").awaitTermination(180)
    want = {r.id: (r.band, r.score) for r in decide.verdicts(decide.decide(rows, model)).collect()}
    assert {r.id: (r.band, r.score) for r in scoring.read(spark, f"{d}/decisions").collect()} == want
    assert {r.case_id for r in scoring.read(spark, f"{d}/cases").collect()} == {k for k, v in want.items() if v[0] == "REVIEW"}


def test_streamed_drift(spark):
    d = tempfile.mkdtemp()
    log = view(spark, SF, "fx_decisions")
    log.write.parquet(f"{d}/in")
    reference = drift.long(drift.monitored(log))
    stream = spark.readStream.schema(log.schema).parquet(f"{d}/in")
    scoring.drift_stream(stream, reference, f"{d}/reports", f"{d}/check").awaitTermination(180)
    got = scoring.read(spark, f"{d}/reports").collect()
    assert {r.quantity for r in got} == set(drift.QUANTITIES) and all(r.psi < 0.01 for r in got)
