"""Queries over a trained detector: it is fitted once for a session and folder, and read from where it was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators import detector as D
from mailsift.operators import evidence, metrics
from mailsift.sources.tables import mails, spread, table, view

from . import mail
from .catalogue import query

_TRAINED: dict[tuple[str, str], D.Detector] = {}


def trained(spark: SparkSession, sf_dir: str) -> D.Detector:
    """The detector of a folder's messages and labels (``toxic`` is the class to find)."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _TRAINED:
        labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), F.col("toxic").alias("y"))
        _TRAINED[key] = D.train(mails(spark, sf_dir), labels)
    return _TRAINED[key]


def tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled messages that no stage was fitted on."""
    return trained(spark, sf_dir).labelled(spark).filter("pool = 'test'")


@query("detector_scores")
def _(spark, d):
    model = trained(spark, d)
    return model.scores(spark).withColumn("band", metrics.band("score", model.review, model.block))


@query("detector_quality")
def _(spark, d):
    return D.quality(tested(spark, d), {"fused": "raw", "calibrated": "score"} | {m: m for m in D.MEMBERS})


@query("detector_ablation")
def _(spark, d):
    return D.without_each(trained(spark, d), spark)


@query("detector_bands")
def _(spark, d):
    model = trained(spark, d)
    return metrics.banded_outcome(tested(spark, d), model.review, model.block).withColumns({"review_at": F.lit(model.review), "block_at": F.lit(model.block), "reason": F.lit(model.reason), "calibration": F.lit(model.calibration)})


@query("detector_contributions")
def _(spark, d):
    return D.explained(trained(spark, d), spark)


@query("detector_occlusion")
def _(spark, d):
    return D.occluded(trained(spark, d), spark)


@query("detector_terms")
def _(spark, d):
    return evidence.terms(trained(spark, d), spark, "m_words", "m_chars")


@query("evidence_cards")
def _(spark, d):
    model, all_mails, all_links = trained(spark, d), mails(spark, d), spread(view(spark, d, "fx_links"))
    ids = evidence.held(model, spark).select("message_id")
    own, links = all_mails.join(ids, "message_id", "left_semi"), all_links.join(ids, "message_id", "left_semi")
    return evidence.cards(model, own, links, mail.rule_table(own, links))
