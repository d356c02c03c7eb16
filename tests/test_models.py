"""Members, fusion and calibration on rows that can be told apart."""

from pyspark.sql import functions as F

from mailsift.operators import metrics, models


def test_detector(spark):
    rows = spark.range(240).select(
        F.col("id").alias("message_id"),
        (F.col("id") % 2).cast("double").alias("y"),
        F.when(F.col("id") % 2 == 1, "verify your account password now").otherwise("minutes of the weekly meeting").alias("text"),
        (F.col("id") % 2 + F.col("id") % 7 / 100).alias("f1"),
        F.concat(F.lit("g"), F.col("id") % 40).alias("group_key"),
    )
    detector = models.fit_detector(rows, ["f1"], "group_key", trees=3, features=256)
    out = models.apply_detector(detector, rows, ["message_id", "y"])
    assert metrics.roc_auc(out.select("y", "score")).first().roc_auc == 1.0
    review, block, reason = models.thresholds(out)
    assert 0 < review <= block <= 1 and reason
    parts = models.pools(rows, "group_key").groupBy("group_key").agg(F.countDistinct("pool").alias("n"))
    assert parts.filter("n > 1").count() == 0
