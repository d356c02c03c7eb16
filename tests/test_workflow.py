"""Ordered case updates against a plain loop, and the one state machine behind all forms of it."""

import random

from mailsift.functions import text as T
from mailsift.operators import workflow as W
from mailsift.streaming import state
from pyspark.sql import functions as F


def plain(cases, requests):
    now, out = dict(cases), {}
    for rid, case, expected, to in sorted(requests):
        if case in now:
            before, good = now[case], expected == now[case]
            now[case] = to if good else before
            out[rid] = (case, before, good, now[case], None if good else "stale")
    return out


def test_updates_equal_a_loop_on_a_hot_case(spark):
    r = random.Random(1)
    cases = [(1, "open"), (2, "resolved"), (3, "in_review"), (4, "odd")]
    requests = [(i, r.choice([1] * 8 + [2, 3, 4, 9]), r.choice([*W.STATES, None]), r.choice(W.STATES)) for i in range(10_000)]
    for size in (7, 1000):
        got = W.updates(spark.createDataFrame(cases, "case_id long, state string"), spark.createDataFrame(requests, "request_id long, case_id long, expected string, next string").repartition(5), size).collect()
        assert {x.request_id: (x.case_id, x.state, x.applied, x.new_state, x.refused) for x in got} == plain(cases, requests) and len(got) == len({x.request_id for x in got})


def test_three_updates_of_one_case(spark):
    asked = [(1, 7, "open", "in_review"), (2, 7, "in_review", "escalated"), (3, 7, "escalated", "resolved"), (4, 7, "open", "in_review")]
    got = W.updates(spark.createDataFrame([(7, "open")], "case_id long, state string"), spark.createDataFrame(asked, "request_id long, case_id long, expected string, next string")).orderBy("request_id").collect()
    assert [(x.state, x.applied, x.new_state) for x in got] == [("open", True, "in_review"), ("in_review", True, "escalated"), ("escalated", True, "resolved"), ("resolved", False, "resolved")]


def test_many_cases_are_not_one_python_call_each(spark):
    r = random.Random(2)
    cases = [(i, r.choice(W.STATES)) for i in range(3000)]
    requests = [(i, r.randrange(3000), r.choice(W.STATES), r.choice(W.STATES)) for i in range(9000)]
    got = W.updates(spark.createDataFrame(cases, "case_id long, state string"), spark.createDataFrame(requests, "request_id long, case_id long, expected string, next string").repartition(5), 100)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {x.request_id: (x.case_id, x.state, x.applied, x.new_state, x.refused) for x in got.collect()} == plain(cases, requests)


def test_stream_and_tables_have_one_machine(spark):
    for action, (states, to) in W.NEXT.items():
        rows = [(s, action, "admin", True, "note", "released", 0.9) for s in W.STATES]
        got = {x.state: (x.refused, x.next_state) for x in W.decided(spark.createDataFrame(rows, "state string, action string, role string, owns boolean, note string, resolution string, score double")).collect()}
        for s in W.STATES:
            assert got[s] == ((None, to or s) if s in states else ("illegal_state", None)), (action, s)
            if to:
                assert state.case_step((s, 0, 0, 0.0), action, 1.0)[0] == (to if s in states else s)


def test_compatibility_forms_come_before_lookalikes(spark):
    assert spark.range(1).select(T.canonical(F.lit("p\U0001d6c2ypal"))).first()[0] == "paypal"
