"""The decision path: member scores are fused, calibrated, guarded and abstained from, and end as verdicts.

One projection over the member matrix decides one message as it decides all of them. Controls can be
switched off, one by one or all, for ablation.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import policy
from .metrics import BLOCK, REVIEW, band, confusion, prf
from .rules import sigmoid


@dataclass(frozen=True)
class Controls:
    """Which steps of the path are in force."""

    calibration: bool = True
    velocity: bool = True
    abstention: bool = True

    @classmethod
    def arms(cls) -> dict[str, Controls]:
        """All, none, and each one left out."""
        none = cls(False, False, False)
        return {"all": cls(), "none": none} | {f"no_{k}": replace(cls(), **{k: False}) for k in ("calibration", "velocity", "abstention")}


@dataclass(frozen=True)
class Fusion:
    """Weights of the members in log-odds, and the slope and offset that calibrate the fused log-odds."""

    weights: dict[str, float]
    intercept: float
    slope: float = 1.0
    offset: float = 0.0


def fuse(scored: DataFrame, model: Fusion) -> DataFrame:
    """Adds logit and raw, the fused score before calibration; members that are missing count as 0.5."""
    logit = sum((F.coalesce(F.col(m), F.lit(0.5)) * w for m, w in sorted(model.weights.items())), F.lit(model.intercept))
    return scored.withColumn("logit", logit).withColumn("raw", sigmoid(F.col("logit")))


def decide(scored: DataFrame, model: Fusion, controls: Controls = Controls(), review: float = REVIEW, block: float = BLOCK) -> DataFrame:  # noqa: B008
    """Adds raw, score, spread, base_band, abstained and band.

    scored has the members, and what the velocity guard reads of a message's context.
    """
    x = fuse(scored.drop("score", "band"), model)
    calibrated = sigmoid(model.slope * F.col("logit") + model.offset) if controls.calibration else F.col("raw")
    x = x.withColumn("score", calibrated)
    if controls.velocity:
        x = policy.velocity_guard(x).withColumn("score", F.col("guarded")).drop("guarded")
    if controls.abstention:
        return policy.abstention(x, tuple(model.weights), review=review, block=block)
    return x.withColumns({"spread": policy.spread(tuple(model.weights)), "base_band": band("score", review, block), "abstained": F.lit(False), "band": band("score", review, block)})


def verdicts(decided: DataFrame, id: str = "id", block: float = BLOCK, review: float = REVIEW) -> DataFrame:
    """One record a message: label, band, abstention, score, and the signals behind it."""
    label = F.when(F.col("score") >= block, "phishing").otherwise("legitimate")
    signals = F.struct(F.round("raw", 6).alias("raw_fusion"), F.round("spread", 6).alias("member_spread"), F.lit(review).alias("review_threshold"), F.lit(block).alias("block_threshold"), F.col("abstained").alias("moved"))
    return decided.select(id, label.alias("label"), "band", (F.col("band") == "REVIEW").alias("abstained"), F.round("score", 6).alias("score"), signals.alias("signals"))


def summary(decided: DataFrame) -> DataFrame:
    """How many messages each band has, its share, and the share that was decided without context."""
    n = F.count(F.lit(1))
    count = {b.lower(): F.count_if(F.col("band") == b) for b in ("ALLOW", "REVIEW", "BLOCK")}
    return decided.agg(n.alias("n"), *(v.alias(k) for k, v in count.items()), *(F.round(v / n, 6).alias(f"{k}_share") for k, v in count.items()), F.count_if("abstained").alias("moved"), F.round(F.count_if(~F.col("available")) / n, 6).alias("blind_share"))


def ablation(scored: DataFrame, model: Fusion) -> DataFrame:
    """Quality and band counts of every arm of the controls, and the difference of its macro-F1 to the full path."""
    out = None
    for arm, controls in Controls.arms().items():
        x = decide(scored, model, controls)
        bands = x.agg(*(F.count_if(F.col("band") == b).alias(b.lower()) for b in ("ALLOW", "REVIEW", "BLOCK")))
        row = prf(confusion(x)).select("macro_f1", "fpr", "fnr").join(bands, F.lit(True)).select(F.lit(arm).alias("arm"), "*")
        out = row if out is None else out.unionByName(row)
    full = out.filter("arm = 'all'").select(F.col("macro_f1").alias("full"))  # one row
    return out.join(F.broadcast(full), F.lit(True)).select("arm", "macro_f1", "fpr", "fnr", "allow", "review", "block", F.round(F.col("macro_f1") - F.col("full"), 5).alias("delta"))


def occlusion(scored: DataFrame, model: Fusion, neutral: float = 0.5, least: float = 1e-4, k: int = 8, id: str = "id") -> DataFrame:
    """(id, member, contribution, place): the fused score less the score with one member reset to neutral, largest first."""
    x = fuse(scored, model)
    parts = [F.struct(F.lit(m).alias("member"), (F.col("raw") - sigmoid(F.col("logit") - w * (F.coalesce(F.col(m), F.lit(neutral)) - neutral))).alias("c")) for m, w in sorted(model.weights.items())]
    good = F.filter(F.array(*parts), lambda p: F.abs(p["c"]) >= least)
    ranked = F.slice(F.array_sort(good, lambda a, b: F.when(F.abs(a["c"]) > F.abs(b["c"]), -1).when(F.abs(a["c"]) < F.abs(b["c"]), 1).when(a["member"] < b["member"], -1).otherwise(1)), 1, k)
    return x.select(id, F.posexplode(ranked).alias("place", "p")).select(id, F.col("p.member").alias("member"), F.round("p.c", 6).alias("contribution"), (F.col("place") + 1).alias("place"))


def compare(scored: DataFrame, other: str, review: float = REVIEW, block: float = BLOCK, id: str = "id") -> DataFrame:
    """Both scores and bands of each message under one set of thresholds, and their distance."""
    s, o = F.col("score"), F.col(other)
    return scored.select(id, F.round(s, 6).alias("score"), F.round(o, 6).alias("other_score"), band(s, review, block).alias("band"), band(o, review, block).alias("other_band"), F.round(F.abs(s - o), 6).alias("difference"))


def without_context(mails: DataFrame) -> DataFrame:
    """Messages as they arrive without any history."""
    return mails.withColumn("available", F.lit(False))


def version(spark, members: list[str], families: list[str], n: int, seed: int, at: str, controls: Controls = Controls()) -> DataFrame:  # noqa: B008
    """pg- and ten hex digits over what a model was made of."""
    text = "|".join([",".join(members), repr(controls), ",".join(families), str(n), str(seed), at])
    return spark.range(1).select(F.concat(F.lit("pg-"), F.substring(F.sha2(F.lit(text), 256), 1, 10)).alias("version"))


def keep_versions(manifest: DataFrame, current: Column, keep: int = 5) -> DataFrame:
    """The newest versions of a manifest of (version, saved_ts), and the current one however old it is."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("saved_ts"), "version"))  # one row a saved model
    return manifest.withColumn("place", place).filter((F.col("place") <= keep) | (F.col("version") == current)).select("version", "saved_ts", "place", (F.col("version") == current).alias("current"))
