"""Reports made of scored rows: grades, gates, robustness and ingest summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.functions.refdata import RULES

from .quantiles import quantiles
from .metrics import band, prf

# Gates (id, metric, least or most, bound; a missing metric fails), families of attacks (id, name, controls
# that counter it, the attacker's cost, impact of a success), likelihood by rate of success, and the risk of both.
GATES = [
    ("G1", "clean.macro_f1", "min", 0.90, True),
    ("G2", "clean.pr_auc", "min", 0.93, True),
    ("G3", "clean.false_positive_rate", "max", 0.02, True),
    ("G4", "calibration.ece", "max", 0.08, True),
    ("G5", "robustness.macro_f1_drop", "max", 0.15, True),
    ("G6", "robustness.attack_success_rate", "max", 0.35, True),
    ("G7", "latency.p95_ms", "max", 150.0, True),
    ("G8", "deltas.vs_rule_baseline_macro_f1", "min", 0.01, True),
    ("G9", "deltas.asr_advantage_vs_text_baseline", "min", 0.0, True),
    ("G10", "leakage.passed_numeric", "min", 1.0, True),
]
FAMILIES = [
    ("A-LEX", "Lexical and semantic perturbation", ["D-NORM", "D-ADVTRAIN", "D-ENSEMBLE", "D-ABSTAIN"], "Low", "High"),
    ("A-UNI", "Unicode and homoglyph obfuscation", ["D-NORM", "D-ADVTRAIN"], "Low", "High"),
    ("A-URL", "URL obfuscation and redirection", ["D-URL", "D-ADVTRAIN", "D-ENSEMBLE"], "Low to medium", "High"),
    ("A-STRUCT", "Structural and HTML manipulation", ["D-NORM", "D-ENSEMBLE", "D-ADVTRAIN"], "Low", "High"),
    ("A-HDR", "Header and identity shaping", ["D-ENSEMBLE", "D-ABSTAIN"], "Medium", "Medium"),
    ("A-BEH", "Behavioral and timing mimicry", ["D-VELOCITY", "D-ENSEMBLE", "D-ABSTAIN"], "High", "Medium"),
    ("A-TRUST", "Payload relocation onto reputable infrastructure", ["D-URL", "D-ENSEMBLE", "D-ABSTAIN"], "Medium", "Medium"),
    ("A-CHANNEL", "Out-of-band payload delivery", ["D-ENSEMBLE", "D-ABSTAIN", "D-VELOCITY"], "High", "Medium"),
]
LIKELIHOOD = [(0.40, "High"), (0.15, "Medium"), (0.05, "Low")]
RISK = {("High", "High"): "High", ("High", "Medium"): "Medium", ("Medium", "High"): "Medium", ("Medium", "Medium"): "Medium", ("Low", "High"): "Low", ("Low", "Medium"): "Low", ("Very low", "High"): "Low", ("Very low", "Medium"): "Very low"}


def grade(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Silent deliveries, false blocks, acceptable bands, caught phish, review load, mean scores and their distance."""
    x = scored.withColumn("band", band("score"))
    pos = F.col("y") == 1
    rate = lambda c, of: F.round(F.coalesce(F.count_if(c & of) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0)), 6)
    acceptable = (pos & (F.col("band") != "ALLOW")) | (~pos & (F.col("band") != "BLOCK"))
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        rate(F.col("band") == "ALLOW", pos).alias("silent_delivery"),
        rate(F.col("band") == "BLOCK", ~pos).alias("false_block"),
        rate(F.col("band") != "ALLOW", pos).alias("caught"),
        F.round(F.avg(acceptable.cast("double")), 6).alias("acceptable"),
        F.round(F.avg((F.col("band") == "REVIEW").cast("double")), 6).alias("review_load"),
        F.round(F.avg(F.when(pos, F.col("score"))), 6).alias("mean_phish"),
        F.round(F.avg(F.when(~pos, F.col("score"))), 6).alias("mean_ham"),
        F.round(F.avg(F.when(pos, F.col("score"))) - F.avg(F.when(~pos, F.col("score"))), 6).alias("separation"),
    )


def per_case(scored: DataFrame, case: str) -> DataFrame:
    """Of each case and class: mean and worst score, the share of acceptable bands, and band counts; worst cases first."""
    x = scored.withColumn("band", band("score"))
    good = ((F.col("y") == 1) & (F.col("band") != "ALLOW")) | ((F.col("y") == 0) & (F.col("band") != "BLOCK"))
    out = x.groupBy(case, "y").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.when(F.col("y") == 1, F.min("score")).otherwise(F.max("score")).alias("worst_score"),
        F.round(F.avg(good.cast("double")), 6).alias("pass_rate"),
        *(F.count_if(F.col("band") == b).alias(b.lower()) for b in ("ALLOW", "REVIEW", "BLOCK")),
    )
    return out.orderBy("pass_rate", case, "y")


def gates(values: DataFrame) -> DataFrame:
    """(gate, metric, observed, kind, bound, blocking, passed) of a (metric, value) table; a missing blocking metric fails."""
    wanted = values.sparkSession.createDataFrame(GATES, "gate string, metric string, kind string, bound double, blocking boolean")
    x = F.broadcast(wanted).join(values, "metric", "left")
    ok = F.when(F.col("kind") == "min", F.col("value") >= F.col("bound")).otherwise(F.col("value") <= F.col("bound"))
    return x.select("gate", "metric", F.round("value", 5).alias("observed"), "kind", "bound", "blocking", F.coalesce(ok, ~F.col("blocking")).alias("passed"))


def go(gated: DataFrame) -> DataFrame:
    """One row: whether all blocking gates passed, and how many others did."""
    return gated.agg(F.min(F.col("passed") | ~F.col("blocking")).alias("go"), F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("gates"))


def score_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Quality at a threshold with the share of positives."""
    hit, pos = F.col("score") >= threshold, F.col("y") == 1
    n = scored.agg(F.count_if(~pos & ~hit).alias("tn"), F.count_if(~pos & hit).alias("fp"), F.count_if(pos & ~hit).alias("fn"), F.count_if(pos & hit).alias("tp"), F.round(F.avg(F.col("y").cast("double")), 6).alias("positive_rate"))
    return prf(n)


def attack_summary(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Over (before, after, queries): escapes from BLOCK, silent deliveries, drops and effort."""
    x = results.withColumn("b0", band("before")).withColumn("b1", band("after")).withColumn("drop", F.col("before") - F.col("after"))
    return x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("b0") == "BLOCK") & (F.col("b1") != "BLOCK")).alias("escaped_block"),
        F.count_if((F.col("b0") != "ALLOW") & (F.col("b1") == "ALLOW")).alias("silent"),
        F.round(F.avg("drop"), 6).alias("mean_drop"),
        F.round(F.expr("percentile(drop, 0.5)"), 6).alias("median_drop"),
        F.round(F.max("drop"), 6).alias("max_drop"),
        F.sum("queries").alias("queries"),
    )


def budget_sweep(results: DataFrame, budgets: tuple[int, ...]) -> DataFrame:
    """Share of silent deliveries among attacks that need no more queries than each budget."""
    cell = sum((F.col("queries") > b).cast("int") for b in budgets)
    silent = (band("before") != "ALLOW") & (band("after") == "ALLOW")
    x = results.groupBy(cell.alias("cell")).agg(F.count_if(silent).alias("silent"))
    names = results.sparkSession.createDataFrame(list(enumerate(budgets)), "cell int, budget int")
    total = results.agg(F.count(F.lit(1)).alias("n"))
    up = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a budget
    x = names.join(x, "cell", "left").join(F.broadcast(total), F.lit(True))
    return x.select("budget", F.round(F.coalesce(F.sum("silent").over(up), F.lit(0)) / F.col("n"), 6).alias("silent_rate"))


def risk_register(results: DataFrame, active: tuple[str, ...]) -> DataFrame:
    """Of each family of attacks: how often it succeeds, what that costs, which controls stand against it, and the risk that is left.

    ``results`` has (family, before, after, queries), a row an attacked message; a success ends below the band BLOCK. Families
    without results have rates of 0; without an active control of its own, a family is ``uncontrolled``.
    """
    evaded = band("after") != "BLOCK"
    measured = results.groupBy("family").agg(F.avg(evaded.cast("double")).alias("rate"), F.avg(F.col("before") - F.col("after")).alias("drop"))
    effort = quantiles(results.filter(evaded), "queries", (0.5,), ("family",)).select("family", F.col("q")[0].alias("median_queries"))
    known = results.sparkSession.createDataFrame(FAMILIES, "family string, name string, controls array<string>, attacker_cost string, impact string")
    x = F.broadcast(known).join(measured, "family", "left").join(effort, "family", "left").na.fill(0.0, ["rate", "drop", "median_queries"])
    likelihood = F.coalesce(*(F.when(F.col("rate") >= least, name) for least, name in LIKELIHOOD), F.lit("Very low"))
    risk = F.coalesce(*(F.when((F.col("likelihood") == a) & (F.col("impact") == b), r) for (a, b), r in RISK.items()), F.lit("Medium"))
    here = F.filter("controls", lambda c: c.isin(*active))
    return x.withColumn("likelihood", likelihood).select(
        "family", "name", F.round("rate", 5).alias("success_rate"), F.round("drop", 5).alias("mean_drop"), F.round("median_queries", 2).alias("median_queries"), "likelihood", "impact", risk.alias("risk"), "attacker_cost",
        F.concat_ws(",", here).alias("controls_applied"), F.concat_ws(",", F.array_except("controls", here)).alias("controls_missing"), (F.size(here) == 0).alias("uncontrolled"),
    )


def ingest_summary(triaged: DataFrame, source: str) -> DataFrame:
    """Messages, bands and the commonest first reason of each source."""
    first = F.element_at(F.split("reasons", ","), 1)
    return triaged.groupBy(source).agg(F.count(F.lit(1)).alias("received"), *(F.count_if(F.col("band") == b).alias(b.lower()) for b in ("ALLOW", "REVIEW", "BLOCK")), F.mode(F.when(F.col("reasons") != "", first), True).alias("top_reason"))


def evidence(scored: DataFrame, id: str = "message_id", k: int = 6) -> DataFrame:
    """(id, place, rule, weight): the k heaviest fired rules of each message, from an array of fired rules in order."""
    weights = F.map_from_arrays(F.array(*(F.lit(r[0]) for r in RULES)), F.array(*(F.lit(r[1]) for r in RULES)))
    x = scored.select(id, F.posexplode(F.slice("fired", 1, k)).alias("place", "rule"))
    return x.select(id, (F.col("place") + 1).alias("place"), "rule", weights[F.col("rule")].alias("weight"))


def verify_contract(features: DataFrame, names: list[str]) -> DataFrame:
    """(name, problem): columns that a feature table lacks or has beyond a contract; none where it holds."""
    have = set(features.columns)
    rows = [(n, "missing") for n in names if n not in have] + [(n, "unexpected") for n in features.columns if n not in set(names)]
    return features.sparkSession.createDataFrame(rows, "name string, problem string")


def top_features(features: DataFrame, id: str, k: int = 5) -> DataFrame:
    """(id, place, feature, value): the k features of each row that are largest in absolute value."""
    names = [c for c in features.columns if c != id]
    pairs = F.array(*(F.struct(F.abs(F.col(c)).alias("a"), F.lit(c).alias("feature"), F.col(c).alias("value")) for c in names))
    order = F.slice(F.sort_array(pairs, asc=False), 1, k)
    x = features.select(id, F.posexplode(order).alias("place", "x"))
    return x.select(id, (F.col("place") + 1).alias("place"), "x.feature", "x.value")
