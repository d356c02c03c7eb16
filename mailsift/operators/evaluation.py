"""Evaluation tables: calibration before and after, slices, named errors, cues, runs, ablations and matched systems."""

from __future__ import annotations

from itertools import combinations as _combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import THRESHOLD, band, calibration_errors, confusion, prf
from .quantiles import cumulated


def calibration_report(scored: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """ECE, MCE and Brier score of several score columns, one row each."""
    out = None
    for c in columns:
        row = calibration_errors(scored.select("y", F.col(c).alias("score"))).select(F.lit(c).alias("stage"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def slices(scored: DataFrame, dimensions: dict[str, str], least: int = 8) -> DataFrame:
    """Quality in each value of each dimension (name to SQL text), of those with enough rows, worst first; one pass for all."""
    each = F.array(*(F.struct(F.lit(k).alias("slice"), F.expr(v).alias("value")) for k, v in dimensions.items()))
    x = scored.select("y", "score", F.explode(each).alias("d")).select("y", "score", "d.slice", "d.value")
    hit, pos = F.col("score") >= THRESHOLD, F.col("y") == 1
    n = x.groupBy("slice", "value").agg(F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"), F.round(F.avg("y"), 6).alias("positive_rate"))
    n = prf(n).withColumn("n", F.expr("tn + fp + fn + tp")).withColumn("errors", F.expr("fp + fn")).filter(F.col("n") >= least)
    return n.orderBy("slice", "macro_f1", F.desc("n"))


def error_category() -> Column:
    """The first class of error that fits a wrong row: seven of missed phish, six of false alarms."""
    passed = (F.col("spf") == "pass") & (F.col("dkim") == "pass") & (F.col("dmarc") == "pass")
    link = F.col("body").rlike("https?://|www[.]") | F.coalesce("html", F.lit("")).rlike("<a [^>]*href")
    kind = F.col("kind")
    missed = (
        F.when(kind == "clone", "missed: clone")
        .when(kind.isin("bec_ceo", "vendor_swap"), "missed: business email compromise")
        .when(kind == "thread_hijack", "missed: thread hijack")
        .when(~link, "missed: no link")
        .when(F.col("prior_messages") > 5, "missed: known sender")
        .when(passed, "missed: authenticated domain")
        .otherwise("missed: other")
    )
    alarm = (
        F.when(kind == "suspicious_ham", "false alarm: marketing")
        .when(F.startswith(kind, F.lit("real_")), "false alarm: transactional mail")
        .when(F.col("body").rlike("bit[.]ly|tinyurl"), "false alarm: shortener")
        .when(F.col("first_seen"), "false alarm: unknown sender")
        .when(F.col("domain_age_days") < 90, "false alarm: young domain")
        .otherwise("false alarm: other")
    )
    return F.when(F.col("y") == 1, missed).otherwise(alarm)


def _wrong() -> Column:
    return (F.col("score") >= THRESHOLD).cast("int") != F.col("y")


def error_report(scored: DataFrame) -> DataFrame:
    """Errors by category: number, worst distance from the threshold, and rate over all rows."""
    x = scored.withColumn("category", F.when(_wrong(), error_category()))
    # One pass: the rows without an error are a category of their own, which gives the total.
    n = x.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("score") - THRESHOLD)), 6).alias("worst"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))  # a row a category
    return n.withColumn("rate", F.round(F.col("n") / total, 6)).filter("category is not null")


def worst_named(scored: DataFrame, k: int = 12) -> DataFrame:
    """The k errors furthest from the threshold, each with its category."""
    x = scored.filter(_wrong()).select("id", error_category().alias("category"), "y", F.round("score", 6).alias("score"), F.round(F.abs(F.col("score") - THRESHOLD), 6).alias("severity"))
    return x.orderBy(F.desc("severity"), "id").limit(k)


def _passes(score: str = "score") -> Column:
    b = band(score)
    return (((F.col("y") == 1) & (b != "ALLOW")) | ((F.col("y") == 0) & (b != "BLOCK"))).cast("int")


def per_cue(scored: DataFrame) -> DataFrame:
    """Of each cue that cases defeat: cases, records, and the share of records that pass."""
    cases = scored.groupBy("cue", "case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(_passes()).alias("passed"))
    return cases.groupBy("cue").agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("records"), F.round(F.sum("passed") / F.sum("n"), 6).alias("pass_rate"))


def long_runs(scored: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(id, y, run, score): one row for each row and score column."""
    return scored.select("id", "y", F.explode(F.array(*(F.struct(F.lit(c).alias("run"), F.col(c).alias("score")) for c in columns))).alias("r")).select("id", "y", "r.run", "r.score")


def run_sensitivity(runs: DataFrame) -> DataFrame:
    """Least, largest and mean outcome over runs: phish delivered, legitimate mail blocked, and review load."""
    b = band("score")
    per = runs.groupBy("run").agg(
        F.avg(F.when(F.col("y") == 1, (b == "ALLOW").cast("int"))).alias("silent"),
        F.avg(F.when(F.col("y") == 0, (b == "BLOCK").cast("int"))).alias("false_block"),
        F.avg((b == "REVIEW").cast("int")).alias("load"),
    )
    return per.agg(F.count(F.lit(1)).alias("runs"), *(F.round(f(k), 6).alias(f"{k}_{n}") for k in ("silent", "false_block", "load") for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "mean"))))


def run_failures(runs: DataFrame) -> DataFrame:
    """In how many runs each case failed, and its worst pass rate."""
    per = runs.groupBy("run", "case_id").agg(F.avg(_passes()).alias("rate"))
    return per.groupBy("case_id").agg(F.count_if(F.col("rate") < 1).alias("failed_runs"), F.round(F.min("rate"), 6).alias("worst"))


def combinations(groups: dict[str, list[str]]) -> dict[str, list[str]]:
    """Every combination of groups by name, with the columns of its groups."""
    names = sorted(groups)
    return {"+".join(c): [m for g in c for m in groups[g]] for n in range(1, len(names) + 1) for c in _combinations(names, n)}


def member_ablation(scored: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Quality of the mean of each combination of members, and its difference to that of all; one pass for all."""
    arms = combinations(groups)
    each = F.array(*(F.struct(F.lit(k).alias("arm"), (sum(F.col(m) for m in v) / len(v)).alias("score")) for k, v in arms.items()))
    x = scored.select("y", F.explode(each).alias("a")).select("y", "a.arm", "a.score")
    out = prf(confusion(x, by=("arm",)))
    full = out.filter(F.col("arm") == "+".join(sorted(groups))).select(F.col("macro_f1").alias("full"))  # one row
    return out.join(F.broadcast(full), F.lit(True)).select("arm", "macro_f1", "recall", "fpr", F.round(F.col("macro_f1") - F.col("full"), 5).alias("delta"))


def hard_subset(scored: DataFrame, least: int = 20) -> DataFrame:
    """Quality over hard rows, if they are enough and of both classes."""
    x = confusion(scored).withColumn("n", F.expr("tn + fp + fn + tp"))
    return prf(x.filter((F.col("n") >= least) & F.expr("tp + fn > 0 and tn + fp > 0")))


def systems(scored: DataFrame, columns: dict[str, str], review_fpr: float, block_fpr: float) -> DataFrame:
    """Systems at one budget of false alarms: thresholds, phish delivered or caught, legitimate mail blocked, review load.

    Each system's scores are counted once; its thresholds are the least scores whose negatives at and above them fit the budgets.
    """
    x = scored.select("y", F.explode(F.array(*(F.struct(F.lit(k).alias("system"), F.col(c).alias("score")) for k, c in columns.items()))).alias("s")).select("y", "s.system", "s.score")
    each = x.groupBy("system", "score").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    down = cumulated(each, "score", ("neg",), ("system",), descending=True)
    fits = lambda t: F.min(F.when((F.col("neg") > 0) & (F.col("neg_upto") <= F.floor(t * F.col("neg_all"))), F.col("score")))
    at_budget = down.groupBy("system").agg(fits(F.lit(review_fpr)).alias("review"), fits(F.lit(block_fpr)).alias("_block"))
    each = each.join(at_budget.withColumn("block", F.greatest("_block", "review")), "system")
    at = lambda n, good: F.sum(F.when(good, F.col(n)).otherwise(0)) / F.nullif(F.sum(n), F.lit(0))
    low, high = F.col("score") < F.col("review"), F.col("score") >= F.col("block")
    both = each.withColumn("all", F.col("pos") + F.col("neg"))
    return both.groupBy("system").agg(
        F.round(F.first("review"), 6).alias("review"), F.round(F.first("block"), 6).alias("block"), F.round(at("pos", low), 6).alias("silent_delivery"), F.round(at("neg", high), 6).alias("false_block"),
        F.round(at("all", ~low & ~high), 6).alias("review_load"), F.round(at("pos", high), 6).alias("caught"),
    )


