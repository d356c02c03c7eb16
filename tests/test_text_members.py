"""The members that read texts: their fits and scores against those of pyspark.ml's own stages, and what a fit leaves out until it is asked for."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.sql import functions as F

from mailsift.operators import detector as D
from mailsift.operators import models
from mailsift.plans import catalogue
from mailsift.plans import detector as plans
from mailsift.sources import tables

SF = "/root/testdata/sf0.01"
TEXTS = ["Verify your account NOW, it's urgent", "minutes of the weekly meeting", "", "café Kelvin's mİnutes of", "verify verify your", "a", "the account of the meeting 42 42 42", "no word here is жжж known"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, TEXTS[i % 8] + " w" * (i % 3), float(i % 2), 1.0 + i % 5) for i in range(64)], "message_id int, text string, y double, weight double").cache()


def plain_words(features, n):
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="_w", pattern=r"[a-z0-9']+", gaps=False, toLowercase=True),
            NGram(n=2, inputCol="_w", outputCol="_w2"),
            SQLTransformer(statement="SELECT *, concat(_w, _w2) AS _terms FROM __THIS__"),
            CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=features, minDF=2.0, binary=True),
            IDF(inputCol="_tf", outputCol="_w0"),
            *models._linear(4.0, n),
        ]
    )


def plain_chars(features, n):
    models.with_functions(models.SparkSession.active())
    return Pipeline(stages=[SQLTransformer(statement=f"SELECT *, {models.HASHED}(text, {features}) AS _tf FROM __THIS__"), IDF(inputCol="_tf", outputCol="_w0", minDocFreq=3), *models._linear(4.0, n)])


@pytest.mark.parametrize("name", ["words", "chars"])
def test_fits_and_scores_are_those_of_plain_stages(spark, rows, name):
    features, n = 1 << 12, rows.count()
    got = (models.word_member if name == "words" else models.char_member)(features=features, n_rows=n).fit(rows)
    want = (plain_words if name == "words" else plain_chars)(features, n).fit(rows)
    if name == "words":
        assert sorted(got.stages[3].vocabulary) == sorted(want.stages[3].vocabulary)
    scored = {r.message_id: r.s for r in D.probability(want, rows, "s").collect()}
    by_stages = {r.message_id: r.s for r in D.probability(got, rows, "s").collect()}
    in_one_pass = {r.message_id: r.s for r in models.member_scores({"s": got}, rows, ["message_id"]).collect()}
    assert all(abs(scored[i] - by_stages[i]) < 1e-5 and abs(by_stages[i] - in_one_pass[i]) < 1e-12 for i in scored) and len(in_one_pass) == n
    plan = models.member_scores({"s": got}, rows, ["message_id"])._jdf.queryExecution().executedPlan().toString()
    assert "UDF(" not in plan and plan.count("ArrowEvalPython") == 1  # no vector is made


def test_a_vocabulary_keeps_the_most_frequent_and_then_the_first_by_name(spark):
    df = spark.createDataFrame([("b b b a",), ("b a",), ("d c",), ("c d",), ("z",)], "text string")
    assert models.vocabulary(df, "text", 10).column(0).to_pylist() == ["b", "a", "b a", "c", "d"]
    assert models.vocabulary(df, "text", 4).column(0).to_pylist() == ["b", "a", "b a", "c"]


def test_messages_without_label_are_scored_when_they_are_asked_for(spark):
    labels = tables.table(spark, SF, "labels").select(F.col("doc_id").alias("message_id"), F.col("toxic").alias("y"))
    key = spark.sparkContext.applicationId, SF
    before, plans._TRAINED[key] = plans._TRAINED.get(key), D.train(tables.mails(spark, SF), labels, trees=2, depth=2, features=1 << 10)
    try:
        model = plans._TRAINED[key]
        assert catalogue.QUERIES["detector_quality"](spark, SF).count() == 5 and len(model.rest) == 1
        known = model.labelled(spark)
        assert known.count() == labels.count() and known.filter("y is null").count() == 0
        assert model.scores(spark).count() == tables.mails(spark, SF).count() == model.rows(spark).count() and not model.rest
        assert model.scores(spark).filter("y is not null").exceptAll(known).count() == 0 and model.scores(spark).filter("score is null").count() == 0
        assert model.rows(spark).join(known, "message_id", "left_anti").filter("y is not null").count() == 0
    finally:
        plans._TRAINED.pop(key) if before is None else plans._TRAINED.update({key: before})


def test_terms_of_held_messages_are_weighed_where_they_are_read(spark):
    names = ["now", "your account", "verify", "account", "your", "zzz", "a b", "b"]
    idf, w = np.array([0.5, 1.5, 1.0, 0.7, 0.7, 2.0, 1.0, 0.0]), np.array([1.0, -1.0, 1.5, 2.0, 2.0, 9.0, -1.0, 5.0])
    texts = ["Verify your account now, verify it", "a b", "", None, "nothing known"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", models.term_contributions(F.col("text"), names, idf, w, 3).alias("x"))
    plan = got.select("i", F.explode("x").alias("x"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    found = {r.i: [(x.term, x.place, x.contribution) for x in r.x] for r in got.collect()}
    length = sum(idf[i] ** 2 for i in range(5)) ** 0.5
    want = [("verify", 1.5 / length), ("your account", -1.5 / length), ("account", 1.4 / length)]
    assert [(t, p) for t, p, _ in found[0]] == [(t, i) for i, (t, _) in enumerate(want, 1)]
    assert np.allclose([c for _, _, c in found[0]], [c for _, c in want])
    assert [(t, c) for t, _, c in found[1]] == [("a b", -1.0), ("b", 0.0)] and found[2] == found[3] == found[4] == []
