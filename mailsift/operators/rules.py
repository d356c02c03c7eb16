"""The rule checklist, log-odds fusion of member scores, and explanations made of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.refdata import INTERCEPT, RULES

from .metrics import band


def rule_score(features: DataFrame, id: str = "message_id") -> DataFrame:
    """(id, logit, score, fired): sigmoid of the intercept and the weights of the rules whose columns reach their least value.

    Fired rules are in order of absolute weight. A table without a rule's column is an error: its scores would be others.
    """
    if missing := sorted({r[2] for r in RULES} - set(features.columns)):
        raise ValueError(f"rules read columns that the table lacks: {missing}")
    rules = RULES
    hit = {r[0]: F.coalesce(F.col(r[2]) >= r[3], F.lit(False)) for r in rules}
    logit = F.lit(INTERCEPT)
    for rid, weight, _, _ in rules:
        logit = logit + F.when(hit[rid], weight).otherwise(0.0)
    order = sorted(rules, key=lambda r: (-abs(r[1]), r[0]))
    fired = F.array_compact(F.array(*(F.when(hit[r[0]], r[0]) for r in order)))
    x = features.select(id, F.round(logit, 9).alias("logit"), fired.alias("fired"))
    return x.withColumn("score", F.round(sigmoid(F.col("logit")), 6)).select(id, "logit", "score", "fired")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(x, F.lit(30.0)), F.lit(-30.0))))


def rule_catalogue(features: DataFrame) -> DataFrame:
    """How often each rule fires over a feature table."""
    rules = RULES
    counts = features.agg(*(F.count_if(F.col(r[2]) >= r[3]).alias(r[0]) for r in rules))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(r[0]).alias("rule"), F.lit(r[2]).alias("feature"), F.lit(r[1]).alias("weight"), F.col(r[0]).alias("n")) for r in rules))).alias("x")).select("x.*")


def fusion_logodds(scored: DataFrame, weights: dict[str, float], intercept: float, id: str = "id") -> DataFrame:
    """(id, member, contribution): each member's exact share of the log-odds, and the intercept's."""
    parts = [F.struct(F.lit(m).alias("member"), F.round(F.col(m) * w, 6).alias("contribution")) for m, w in sorted(weights.items())]
    parts.append(F.struct(F.lit("intercept").alias("member"), F.lit(float(intercept)).alias("contribution")))
    return scored.select(id, F.explode(F.array(*parts)).alias("x")).select(id, "x.*")


def disagreement(scored: DataFrame, members: tuple[str, ...] = ("m_engineered", "m_charngram", "m_wordtfidf"), limit: float = 0.25, id: str = "id") -> DataFrame:
    """(id, std, disagree): population deviation of the learned members."""
    n, values = len(members), [F.col(m) for m in members]
    mean = sum(values) / n
    std = F.sqrt(sum((v - mean) * (v - mean) for v in values) / n)
    return scored.select(id, F.round(std, 6).alias("std"), (F.round(std, 9) > limit).alias("disagree"))


def triage(features: DataFrame, id: str = "message_id") -> DataFrame:
    """Messages by urgency: band, score, rules fired; BLOCK before REVIEW before ALLOW, then by score."""
    x = rule_score(features, id).withColumn("band", band("score"))
    place = F.when(F.col("band") == "BLOCK", 0).when(F.col("band") == "REVIEW", 1).otherwise(2)
    x = x.withColumn("reasons", F.when(F.col("band") != "ALLOW", F.array_join("fired", ",")).otherwise(""))
    # A sort samples its input before it deals it; dealt by id first, the few scored columns are sampled, not all features worked out twice.
    x = x.select(id, "band", "score", "reasons", place.alias("_place")).repartition(id)
    return x.orderBy("_place", F.desc("score"), id).drop("_place")
