"""Evaluation metrics as aggregations over (y, score) rows.

Running totals over scores go by ``quantiles.cumulated``, so no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cumulated

REVIEW, BLOCK, THRESHOLD = 0.40, 0.80, 0.50


def _share(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(scored: DataFrame, threshold: float = THRESHOLD, by: tuple[str, ...] = ()) -> DataFrame:
    """tn, fp, fn, tp."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    return scored.groupBy(*by).agg(F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"))


def prf(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes, macro-F1, accuracy, FPR and FNR from a confusion."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    p1, r1, p0, r0 = _share(tp, tp + fp), _share(tp, tp + fn), _share(tn, tn + fn), _share(tn, tn + fp)
    f1, f0 = _share(2 * p1 * r1, p1 + r1), _share(2 * p0 * r0, p0 + r0)
    found = {"precision": p1, "recall": r1, "f1": f1, "macro_f1": (f1 + f0) / 2, "accuracy": _share(tp + tn, tp + tn + fp + fn), "fpr": _share(fp, fp + tn), "fnr": _share(fn, fn + tp)}
    return counts.withColumns({k: F.round(v, 5) for k, v in found.items()})


def running(scored: DataFrame) -> DataFrame:
    """(score, pos, neg, pos_above, neg_above): distinct scores with the rows at and above each."""
    each = scored.groupBy("score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    x = cumulated(each, "score", ("pos", "neg"), descending=True)
    return x.select("score", "pos", "neg", F.col("pos_upto").alias("pos_above"), F.col("neg_upto").alias("neg_above"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """ROC-AUC by average ranks; 0.5 with one class."""
    # A positive beats the negatives below it and half of those at its score.
    total = F.sum("neg")
    x = running(scored)
    n = x.agg(total.alias("n0"), F.sum("pos").alias("n1"), F.sum(F.col("pos") * (F.col("neg_above") - F.col("neg") / 2)).alias("lost"))
    return n.select(F.round(F.when((F.col("n0") == 0) | (F.col("n1") == 0), 0.5).otherwise(1 - F.col("lost") / (F.col("n0") * F.col("n1"))), 6).alias("roc_auc"), "n0", "n1")


def pr_auc(scored: DataFrame) -> DataFrame:
    """Sum of recall steps times precision, ties taken together; 0 without positives."""
    x = running(scored).withColumn("area", F.col("pos") * F.col("pos_above") / (F.col("pos_above") + F.col("neg_above")))
    return x.agg(F.round(F.coalesce(F.sum("area") / F.nullif(F.sum("pos"), F.lit(0)), F.lit(0.0)), 6).alias("pr_auc"))


def threshold_for_fpr(scored: DataFrame, targets: tuple[float, ...]) -> DataFrame:
    """Lowest negative score whose share of negatives at or above it fits each budget.

    Where none fits, the next double after the largest negative score; 0.5 without negatives.
    """
    x = running(scored.filter("y = 0"))
    top = x.agg(F.sum("neg").alias("n0"), F.max("score").alias("top"))
    out = None
    for t in targets:
        allowed = F.floor(F.lit(t) * F.col("n0"))
        fit = x.join(F.broadcast(top), F.lit(True)).groupBy("n0", "top").agg(F.min(F.when(F.col("neg_above") <= allowed, F.col("score"))).alias("s"))
        bits = F.when(F.col("top") == 0, F.lit(5e-324)).otherwise(F.col("top") + F.abs("top") * 2.0**-53 * 1.0000000000000002)
        fit = top.join(fit.select("s"), F.lit(True), "left").select(F.lit(t).alias("target"), F.when(F.col("n0").isNull() | (F.col("n0") == 0), 0.5).otherwise(F.coalesce("s", bits)).alias("threshold"))
        out = fit if out is None else out.unionByName(fit)
    return out


def band(score: Column | str = "score", review: float = REVIEW, block: float = BLOCK) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= block, "BLOCK").when(s >= review, "REVIEW").otherwise("ALLOW")


def banded_outcome(scored: DataFrame, review: float = REVIEW, block: float = BLOCK) -> DataFrame:
    """Counts by band, the review share, and quality of what was decided without a person."""
    x = scored.withColumn("band", band("score", review, block))
    pos = F.col("y") == 1
    n = x.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col("band") == b).alias(b.lower()) for b in ("ALLOW", "REVIEW", "BLOCK")),
        F.count_if(~pos & (F.col("band") == "ALLOW")).alias("tn"),
        F.count_if(~pos & (F.col("band") == "BLOCK")).alias("fp"),
        F.count_if(pos & (F.col("band") == "ALLOW")).alias("fn"),
        F.count_if(pos & (F.col("band") == "BLOCK")).alias("tp"),
        F.count_if(pos & (F.col("band") == "REVIEW")).alias("phish_in_review"),
        F.count_if(~pos & (F.col("band") == "REVIEW")).alias("ham_in_review"),
    )
    return prf(n).withColumn("review_rate", F.round(_share(F.col("review").cast("double"), F.col("n")), 6))


def recall_curve(scored: DataFrame, points: int = 101) -> DataFrame:
    """Interpolated precision on an even recall grid: the best precision at that recall or more."""
    x = running(scored)
    total = x.agg(F.sum("pos").alias("n1"))
    # Distinct scores fall into the grid's cells first; the grid then takes running maxima of its own rows.
    x = x.filter("pos_above > 0").join(F.broadcast(total), F.lit(True)).withColumn("cell", F.floor((F.col("pos_above") * (points - 1)) / F.col("n1")).cast("int"))
    x = x.groupBy("cell").agg(F.max(F.col("pos_above") / (F.col("pos_above") + F.col("neg_above"))).alias("best"))
    grid = scored.sparkSession.range(points).select(F.col("id").cast("int").alias("cell"))
    after = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``points`` rows
    return grid.join(x, "cell", "left").select("cell", F.round(F.coalesce(F.max("best").over(after), F.lit(0.0)), 6).alias("precision"))


def reliability(scored: DataFrame, bins: int = 15) -> DataFrame:
    """Mean score and positive share by equal-width bins; empty bins are kept."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    x = scored.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("confidence"), F.avg(F.col("y").cast("double")).alias("accuracy"))
    grid = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(x, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


def calibration_errors(scored: DataFrame, bins: int = 15, least: int = 20) -> DataFrame:
    """Expected and maximum calibration error, and the Brier score."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    square = (F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))
    x = scored.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("c"), F.avg(F.col("y").cast("double")).alias("a"), F.sum(square).alias("sq"))
    gap = F.abs(F.col("c") - F.col("a"))
    return x.agg(F.round(F.sum(gap * F.col("n")) / F.sum("n"), 6).alias("ece"), F.round(F.coalesce(F.max(F.when(F.col("n") >= least, gap)), F.lit(0.0)), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def class_histogram(scored: DataFrame, bins: int = 40) -> DataFrame:
    """Scores of each class in equal bins."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy("y", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def confidence_profile(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Accuracy by tenths of confidence, 2 |score - 0.5|."""
    at = F.least(F.floor(F.round(2 * F.abs(F.col("score") - 0.5), 9) * 10), F.lit(9)).cast("int")
    right = ((F.col("score") >= threshold).cast("int") == F.col("y")).cast("double")
    return scored.groupBy(at.alias("decile")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(right), 6).alias("accuracy"))


def slice_metrics(scored: DataFrame, by: str = "slice_lang", least: int = 8) -> DataFrame:
    """Quality by slice, of slices with enough rows, worst first."""
    x = prf(confusion(scored, by=(by,))).withColumn("n", F.expr("tn + fp + fn + tp")).filter(F.col("n") >= least)
    return x.orderBy("macro_f1", F.desc("n"))


def error_classes(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Wrong rows under the first class that fits: what the members said, and how far off the score is."""
    wrong = scored.filter((F.col("score") >= threshold).cast("int") != F.col("y"))
    members = [F.col(c) for c in ("m_rules", "m_engineered", "m_charngram", "m_wordtfidf")]
    agree = sum(((m >= threshold).cast("int") == F.col("y")).cast("int") for m in members)
    kind = F.when(F.col("y") == 1, F.when(agree == 0, "missed_by_all").when(F.abs(F.col("score") - threshold) < 0.05, "missed_narrowly").when(F.col("m_rules") < threshold, "missed_by_rules").otherwise("missed_in_fusion")).otherwise(
        F.when(agree == 0, "alarm_by_all").when(F.abs(F.col("score") - threshold) < 0.05, "alarm_narrowly").when(F.col("m_rules") >= threshold, "alarm_by_rules").otherwise("alarm_in_fusion")
    )
    return wrong.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("score") - threshold)), 6).alias("worst"))


def worst_errors(scored: DataFrame, k: int = 12, threshold: float = THRESHOLD) -> DataFrame:
    """The k wrong rows furthest from the threshold."""
    wrong = scored.filter((F.col("score") >= threshold).cast("int") != F.col("y"))
    return wrong.select("id", "y", "score", F.round(F.abs(F.col("score") - threshold), 6).alias("severity")).orderBy(F.desc("severity"), "id").limit(k)
