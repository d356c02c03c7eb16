"""Literal results and invariants of metrics, policy, drift, corpus and reports."""

import numpy as np
from pyspark.sql import functions as F

from mailsift.operators import behaviour, corpus, drift, metrics, policy, reports, review
from mailsift.sources.tables import view

SF = "/root/testdata/sf0.001"


def scored(spark, y, s):
    return spark.createDataFrame([(a, float(b)) for a, b in zip(y, s, strict=True)], "y int, score double")


def test_confusion_and_auc(spark):
    c = metrics.confusion(scored(spark, [1, 1, 0, 0, 1, 0], [1.0, 0, 0, 1, 1, 0])).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (2, 1, 1, 2)
    assert metrics.roc_auc(scored(spark, [0, 1, 0, 1], [0.5] * 4)).first().roc_auc == 0.5
    assert metrics.roc_auc(scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])).first().roc_auc == 1.0
    assert metrics.roc_auc(scored(spark, [1, 1], [0.1, 0.2])).first().roc_auc == 0.5
    assert metrics.pr_auc(scored(spark, [0, 0], [0.1, 0.2])).first().pr_auc == 0.0


def test_bands(spark):
    r = metrics.banded_outcome(scored(spark, [0, 0, 1, 1], [0.05, 0.55, 0.60, 0.95])).first()
    assert (r.allow, r.review, r.block) == (1, 2, 1) and r.review_rate == 0.5


def test_thresholds(spark):
    t = {r.target: r.threshold for r in metrics.threshold_for_fpr(scored(spark, [0] * 10, [i / 10 for i in range(10)]), (0.2, 0.0)).collect()}
    assert t[0.2] == 0.8 and t[0.0] > 0.9
    assert metrics.threshold_for_fpr(scored(spark, [1], [0.3]), (0.1,)).first().threshold == 0.5


def test_contradiction(spark):
    df = spark.createDataFrame([(0.95, 0.05, 0.95, 0.5, 0.5), (0.1, 0.1, 0.1, 0.1, 0.1), (0.5, 0.0, 0.79, 0.1, 0.1)], "score double, m_rules double, m_engineered double, m_charngram double, m_wordtfidf double")
    assert [r.band for r in policy.abstention(df).collect()] == ["REVIEW", "ALLOW", "REVIEW"]
    assert policy.abstention(df, escalate=True).first().band == "BLOCK"


def test_policy_costs(spark):
    perfect = scored(spark, [1, 1, 0, 0], [0.99, 0.97, 0.0, 0.01])
    assert policy.policy_best(perfect, (200.0,)).first().cost == 0.0
    f = [(r.reviews, r.p_allow_phish) for r in policy.frontier(view(spark, SF, "fx_scored")).orderBy("reviews").collect()]
    assert all(a[0] < b[0] and a[1] > b[1] for a, b in zip(f, f[1:], strict=False))


def test_drift(spark):
    rows = spark.range(400).select(F.lit("q").alias("quantity"), (F.col("id") / 400).alias("value"))
    assert drift.psi(rows, rows).first().psi == 0.0
    flag = spark.range(400).select(F.lit("f").alias("quantity"), F.lit(1.0).alias("value"))
    some = spark.range(400).select(F.lit("f").alias("quantity"), (F.col("id") % 4 > 0).cast("double").alias("value"))
    assert drift.psi(flag, some).first().severity == "significant"
    assert drift.ks(rows, rows).first().ks == 0.0


def test_splits(spark):
    rows = spark.range(500).select("id", (F.col("id") % 50).alias("g"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.concat(F.lit("t"), "id").alias("text"), (F.col("id") % 2).alias("label"))
    parted = corpus.grouped_split(rows, "g")
    assert parted.groupBy("g").agg(F.countDistinct("part").alias("n")).filter("n > 1").count() == 0
    audit = corpus.leakage_audit(parted, "text", "g", "label").first()
    assert audit.shared_texts == 0 and audit.shared_groups == 0
    broken = corpus.leakage_audit(parted.withColumn("text", F.lit("same")), "text", "g", "label").first()
    assert broken.shared_texts == 1 and not broken.passed
    timed = corpus.temporal_split(rows, "ts", "id")
    assert timed.filter("part = 'train'").agg(F.max("ts")).first()[0] < timed.filter("part = 'test'").agg(F.min("ts")).first()[0]
    auc = {r.feature: (r.auc, r.suspicious) for r in corpus.feature_auc(rows.withColumn("y", F.col("label").cast("int")), ("label", "g")).collect()}
    assert auc["label"] == (1.0, True)


def test_running_aliases_of_odd_rows(spark):
    rows = [(1, "n", 1, 10), (2, "n", 2, 10), (3, "n", 1, 20), (4, "n", None, 30), (5, "n", 3, 40), (6, "n", 3, None), (7, None, 4, 50), (8, "m", 5, 5)]
    log = spark.createDataFrame(rows, "msg_id long, display_name string, sender long, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = behaviour.running_aliases(log)
    assert {x.msg_id: x.display_name_alias_count for x in got.collect()} == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3, 6: 0, 7: 0, 8: 1}


def test_signatures_are_made_once_and_chunks_change_nothing(spark):
    text = " ".join(f"word{i * 7919 % 10007}" for i in range(900))
    docs = spark.createDataFrame([(1, text), (2, text + " x"), (3, "ab"), (4, None)], "doc_id int, text string")
    made = {r.id: r.signature for r in corpus.minhash(docs).collect()}
    rng = np.random.default_rng(64)
    a, b = (rng.integers(1, 2**61, 64, dtype=np.uint64) | np.uint64(1) for _ in range(2))
    points, h = np.array([ord(c) for c in text], np.uint64), np.uint64(0)
    for i in range(5):
        h = h * np.uint64(1_000_003) ^ points[i : len(points) - 4 + i]
    x = np.unique(h)[:, None] * a + b
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    assert made[1] == (x ^ (x >> np.uint64(32))).min(axis=0).view(np.int64).tolist() and sorted(made) == [1, 2, 3]
    found = corpus.near_duplicates(docs)
    assert "MapInPandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.id, r.first_id) for r in found.collect()] == [(2, 1)]


def test_near_duplicates(spark):
    text = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood " * 3
    docs = spark.createDataFrame([(1, text), (2, text + "x"), (3, "something else entirely, of no likeness"), (4, None), (5, "")], "doc_id long, text string")
    assert [(r.id, r.first_id) for r in corpus.near_duplicates(docs).collect()] == [(2, 1)]


def test_reports(spark):
    values = spark.createDataFrame([("clean.macro_f1", 0.90), ("clean.false_positive_rate", 0.021), ("other", 1.0)], "metric string, value double")
    gated = reports.gates(values)
    found = {r.gate: r.passed for r in gated.collect()}
    assert len(found) == 10 and found["G1"] and not found["G3"] and not found["G2"]  # what is missing fails
    assert not reports.go(gated).first().go
    whole = spark.createDataFrame([(m, float(bound)) for _, m, _, bound, _ in reports.GATES], "metric string, value double")
    assert reports.go(reports.gates(whole)).first().go
    problems = reports.verify_contract(values, ["metric", "other"]).collect()
    assert {(r.name, r.problem) for r in problems} == {("other", "missing"), ("value", "unexpected")}


def test_risk_register(spark):
    rows = [("A-UNI", 0.9, 0.3, 4)] * 4 + [("A-UNI", 0.9, 0.85, 9)] * 6 + [("A-BEH", 0.9, 0.9, 1)]
    found = {r.family: r for r in reports.risk_register(spark.createDataFrame(rows, "family string, before double, after double, queries long"), ("D-ABSTAIN",)).collect()}
    assert len(found) == len(reports.FAMILIES)
    uni, beh, lex = found["A-UNI"], found["A-BEH"], found["A-LEX"]
    assert (uni.success_rate, uni.likelihood, uni.risk, uni.median_queries, uni.uncontrolled, uni.controls_missing) == (0.4, "High", "High", 4.0, True, "D-NORM,D-ADVTRAIN")
    assert (beh.likelihood, beh.risk, beh.controls_applied, beh.uncontrolled) == ("Very low", "Very low", "D-ABSTAIN", False)
    assert (lex.success_rate, lex.risk) == (0.0, "Low")


def test_ordered_totals_stand_outliers_and_ties(spark):
    from mailsift.operators.quantiles import cumulated, quantiles

    rng = np.random.default_rng(5)
    a, b = np.concatenate([rng.random(3000), [1e9, -1e12, 0.5, 0.5]]), rng.normal(size=500).round(1)
    rows = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b] + [("c", None), (None, 1.0)], "g string, v double")
    found = {r.g: r.q for r in quantiles(rows, "v", (0.0, 0.3, 0.5, 1.0), ("g",)).collect()}
    for g, v in (("a", a), ("b", b)):
        assert np.allclose(found[g], np.quantile(v, [0.0, 0.3, 0.5, 1.0]), rtol=1e-12)
    assert quantiles(rows.filter("g = 'c'"), "v", (0.5,), ("g",)).count() == 0
    each = rows.filter("g = 'b'").groupBy("v").agg(F.count("*").alias("n"))
    assert all(r.n_upto == (b >= r.v).sum() for r in cumulated(each, "v", ("n",), descending=True).collect())
    steps = [len(cumulated(rows.filter("g = 'a'").groupBy("v").agg(F.count("*").alias("n")), "v", ("n",)).collect())]
    assert steps == [len(set(a))]


def test_ks_takes_values_as_they_are(spark):
    x, y = np.random.default_rng(1).random(400) / 1e4, np.random.default_rng(2).random(300) / 1e4 + 1e-5
    frame = lambda v: spark.createDataFrame([("q", float(i)) for i in v], "quantity string, value double")
    at = np.sort(np.concatenate([x, y]))
    gap = np.abs(np.searchsorted(np.sort(x), at, "right") / 400 - np.searchsorted(np.sort(y), at, "right") / 300).max()
    assert drift.ks(frame(x), frame(y)).first().ks == round(gap, 6)


def test_purge_keeps_active(spark):
    decisions = spark.createDataFrame([(1, "2020-01-01"), (2, "2020-01-01"), (3, "2030-01-01")], "decision_id long, created_ts string").withColumn("created_ts", F.to_timestamp("created_ts"))
    cases = spark.createDataFrame([(1, "open"), (2, "resolved")], "decision_id long, state string")
    assert {r.decision_id for r in review.retention_keep(decisions, cases, "2025-01-01").collect()} == {1, 3}
