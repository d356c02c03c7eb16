"""The trained detector: pools, quality on messages it has not seen, calibration of few rows, occlusion by single rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.operators import detector as D
from mailsift.operators import metrics
from mailsift.plans import catalogue
from mailsift.plans import detector as plans
from mailsift.sources import tables

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    """Trained over the labelled messages alone, to save time; the queries read it."""
    labels = tables.table(spark, SF, "labels").select(F.col("doc_id").alias("message_id"), F.col("toxic").alias("y"))
    found = D.train(tables.mails(spark, SF).join(labels, "message_id", "left_semi"), labels)
    plans._TRAINED[spark.sparkContext.applicationId, SF] = found
    return found


def test_pools_are_disjoint_and_hold_whole_groups(spark, model):
    rows = model.rows(spark)
    assert rows.count() == spark.read.parquet(f"{SF}/labels.parquet").count()
    assert rows.groupBy("text").agg(F.countDistinct("pool").alias("n")).filter("n > 1").count() == 0
    share = {r.pool: r["count"] / rows.count() for r in rows.groupBy("pool").count().collect()}
    assert all(abs(share[k] - v) < 0.05 for k, v in D.SHARES.items())


def test_quality_on_unseen_messages(spark, model):
    found = {r.system: r for r in catalogue.QUERIES["detector_quality"](spark, SF).collect()}
    best, tested = found["calibrated"], plans.tested(spark, SF)
    assert best.n == tested.count() and best.macro_f1 > 0.8 and best.ece < 0.12
    rows = [(r.y, r.score) for r in tested.collect()]
    tp, fp, fn = (sum((s >= 0.5) == h and y == v for y, s in rows) for h, v in ((True, 1), (True, 0), (False, 1)))
    assert (best.tp, best.fp, best.fn) == (tp, fp, fn)
    assert metrics.roc_auc(tested.select("y", "score")).first().roc_auc > 0.9


def test_every_message_is_scored(spark, model):
    scores = catalogue.QUERIES["detector_scores"](spark, SF)
    assert scores.count() == model.rows(spark).count() and scores.filter("score is null or score < 0 or score > 1 or band is null").count() == 0
    assert catalogue.QUERIES["detector_ablation"](spark, SF).count() == 4 and catalogue.QUERIES["detector_bands"](spark, SF).count() == 1
    one = catalogue.QUERIES["detector_contributions"](spark, SF).groupBy("message_id").agg(F.sum("contribution").alias("c")).join(scores, "message_id")
    off = one.select(F.max(F.abs(F.lit(1) / (1 + F.exp(-(F.col("c") + model.weights["intercept"]))) - F.col("raw"))).alias("e")).first().e
    assert off is None or off < 1e-5


def test_occlusion_equals_single_rows(spark, model):
    got: dict = {}
    for r in D.occluded(model, spark).collect():
        got.setdefault(r.message_id, []).append((r.place, r.feature, r.contribution))
    rows = model.rows(spark)
    columns = [c for c in rows.columns if c not in ("message_id", "y", "pool", "text")]
    calm = rows.filter("pool = 'fit' and y = 0").toPandas()[columns]
    zero, wide = calm.median(), calm.std(ddof=0)
    trees = model.member("m_trees")
    for i in sorted(got)[:50:10]:
        row = rows.filter(F.col("message_id") == i).toPandas()[columns].iloc[0]
        neutral = {f: v for f, v in D.occluded(model, spark).filter(F.col("message_id") == i).select("feature", "neutral").collect()}
        assert all(abs(calm[f].quantile(0.5, interpolation="lower") - v) < 1e-9 or abs(zero[f] - v) < 1e-9 for f, v in neutral.items())
        far = sorted(((abs(row[c] - calm[c].quantile(0.5, interpolation="lower")) / (wide[c] or 1.0), k) for k, c in enumerate(columns)), reverse=True)
        tried = [columns[k] for x, k in far if x > 0][:24]
        variants = [dict(row)] + [dict(row) | {c: float(calm[c].quantile(0.5, interpolation="lower"))} for c in tried]
        p = D.probability(trees, spark.createDataFrame([[float(v[c]) for c in columns] + [k] for k, v in enumerate(variants)], ", ".join(f"{c} double" for c in columns) + ", k long"), "p").orderBy("k").toPandas()["p"]
        want = sorted(((-abs(p[0] - x), c, p[0] - x) for c, x in zip(tried, p[1:], strict=True) if abs(p[0] - x) >= 1e-4))[:8]
        assert np.allclose([c for _, _, c in got[i]], [c for _, _, c in want], atol=2e-6) and {f for _, f, _ in got[i]} == {c for _, c, _ in want}


def test_few_rows_are_calibrated_by_a_sigmoid(spark):
    rows = spark.createDataFrame([(float(i % 2), 0.2 + 0.5 * (i % 2) + 0.01 * (i % 7)) for i in range(100)], "y double, raw double")
    kind, apply = D.calibrated(rows)
    out = apply(rows).collect()
    assert kind == "platt" and all((r.score > 0.5) == (r.y == 1) and 0 <= r.score <= 1 for r in out)
    assert sorted(out, key=lambda r: r.raw) == sorted(out, key=lambda r: (r.score, r.raw))
    assert D.calibrated(rows.filter("y = 1"))[0] == "none" and D.calibrated(rows.crossJoin(spark.range(3)))[0] == "isotonic"


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError):
        D.train(spark.createDataFrame([(1, "a", "b", "", "")], "message_id long, subject string, body string, sender string, reply_to string"), spark.createDataFrame([(1, 1)], "message_id long, y int"))
