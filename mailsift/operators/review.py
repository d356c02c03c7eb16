"""Audit and review-queue analytics over decisions, feedback and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles

ACTIVE = ("open", "in_review", "escalated")
SLA_SECONDS = {1: 3600, 2: 4 * 3600, 3: 24 * 3600}


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The newest feedback of each decision; ties go to the larger id."""
    newest = F.max_by("analyst_label", F.struct("created_ts", "feedback_id"))
    return feedback.groupBy("decision_id").agg(newest.alias("analyst_label"), F.max(F.struct("created_ts", "feedback_id"))["created_ts"].alias("feedback_ts"))


def decision_lookup(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Every decision with its latest feedback label, one row each."""
    return decisions.join(latest_feedback(feedback), "decision_id", "left")


def decision_page(decisions: DataFrame, feedback: DataFrame, band: str | None = None, domain: str | None = None, min_score: float | None = None, since=None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of decisions, newest first; filters reach the scan and only the page's rows are joined."""
    page = decisions
    for given, condition in ((band, F.col("band") == band), (domain, F.col("sender_domain") == domain), (min_score, F.col("score") >= min_score), (since, F.col("created_ts") >= F.lit(since))):
        if given is not None:
            page = page.filter(condition)
    page = page.orderBy(F.desc("created_ts"), F.desc("decision_id")).offset(offset).limit(limit)
    return decision_lookup(page, feedback)


def ops_stats(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: volumes, means, bands, feedback and analysts' disagreements."""
    x = decision_lookup(decisions, feedback)
    wrong = ((F.col("band") == "BLOCK") & (F.col("analyst_label") == "legitimate")) | ((F.col("band") == "ALLOW") & (F.col("analyst_label") == "phishing"))
    return x.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 6).alias("mean_score"),
        F.round(F.avg("latency_ms"), 6).alias("mean_latency_ms"),
        *(F.count_if(F.col("band") == b).alias(b.lower()) for b in ("ALLOW", "REVIEW", "BLOCK")),
        F.count("analyst_label").alias("with_feedback"),
        F.count_if(wrong).alias("disagreements"),
    )


def top_domains(decisions: DataFrame, k: int = 10) -> DataFrame:
    """The k sender domains with the most decisions."""
    return decisions.groupBy("sender_domain").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score")).orderBy(F.desc("n"), "sender_domain").limit(k)


def score_distribution(decisions: DataFrame, bins: int = 20) -> DataFrame:
    """Decisions in equal score bins; a score of 1 belongs to the last."""
    at = F.least((F.col("score") * bins).cast("int"), F.lit(bins - 1))
    return decisions.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def feedback_report(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback by band and label, with the kind of disagreement."""
    x = decisions.join(feedback.select("decision_id", "analyst_label"), "decision_id")
    kind = F.when((F.col("band") == "BLOCK") & (F.col("analyst_label") == "legitimate"), "false_block").when((F.col("band") == "ALLOW") & (F.col("analyst_label") == "phishing"), "missed_phish").otherwise("none")
    return x.groupBy("band", "analyst_label", kind.alias("disagreement")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def refused_feedback(decisions: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback on decisions that don't exist."""
    return feedback.join(decisions.select("decision_id"), "decision_id", "left_anti")


def with_sla(cases: DataFrame) -> DataFrame:
    """Cases with the seconds their priority allows."""
    allowed = F.coalesce(*(F.when(F.col("priority") == p, F.lit(s)) for p, s in SLA_SECONDS.items()), F.lit(SLA_SECONDS[3]))
    return cases.withColumn("sla_seconds", allowed)


def case_page(cases: DataFrame, decisions: DataFrame, now, limit: int = 50) -> DataFrame:
    """Active cases in the order analysts take them, with their decision and whether they are overdue."""
    page = with_sla(cases).filter(F.col("state").isin(*ACTIVE)).orderBy("priority", "created_ts", "case_id").limit(limit)
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("created_ts").cast("timestamp"))
    page = page.withColumn("age_seconds", age).withColumn("overdue", F.col("age_seconds") > F.col("sla_seconds"))
    return page.join(decisions.select("decision_id", "score", "band", "sender_domain"), "decision_id").select("case_id", "priority", "state", "origin", "score", "band", "sender_domain", "age_seconds", "overdue")


def queue_depth(cases: DataFrame, now) -> DataFrame:
    """Cases by state, and how many active ones are past their time."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("created_ts").cast("timestamp"))
    late = F.col("state").isin(*ACTIVE) & (age > F.col("sla_seconds"))
    return with_sla(cases).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("overdue"))


def sla_breaches(cases: DataFrame, now) -> DataFrame:
    """Active cases past their time, by priority and origin, with the longest delay."""
    late = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("created_ts").cast("timestamp")) - F.col("sla_seconds")
    x = with_sla(cases).filter(F.col("state").isin(*ACTIVE)).withColumn("late", late).filter("late > 0")
    return x.groupBy("priority", "origin").agg(F.count(F.lit(1)).alias("n"), F.max("late").alias("longest_seconds"))


def queue_stats(cases: DataFrame) -> DataFrame:
    """One row over resolved cases: medians, share within time, and precision of users' reports."""
    done = with_sla(cases).filter("state = 'resolved'")
    report = F.col("origin") == "user_report"
    out = done.agg(
        F.count(F.lit(1)).alias("resolved"),
        F.count_if(F.col("resolution") == "confirmed_phishing").alias("confirmed"),
        F.round(F.avg((F.col("secs_to_resolve") <= F.col("sla_seconds")).cast("double")), 6).alias("within_sla"),
        F.round(F.sum((report & (F.col("resolution") == "confirmed_phishing")).cast("double")) / F.nullif(F.sum(report.cast("double")), F.lit(0.0)), 6).alias("report_precision"),
    )
    for name in ("claim", "resolve"):
        middle = quantiles(done, f"secs_to_{name}", (0.5,)).select(F.col("q")[0].alias(f"median_{name}"))  # one row
        out = out.join(F.broadcast(middle), F.lit(True), "left")
    return out


def first_case(cases: DataFrame) -> DataFrame:
    """The first case of each decision."""
    return cases.groupBy("decision_id").agg(F.min_by("case_id", F.struct("created_ts", "case_id")).alias("case_id"), F.count(F.lit(1)).alias("n_cases"))


def resolution_feedback(cases: DataFrame) -> DataFrame:
    """Resolved cases as feedback rows."""
    label = F.when(F.col("resolution") == "confirmed_phishing", "phishing").when(F.col("resolution") == "released", "legitimate").otherwise("unsure")
    return cases.filter("state = 'resolved'").select("decision_id", "case_id", label.alias("analyst_label"))


def reporter_status(cases: DataFrame) -> DataFrame:
    """Users' reports with a text that gives away no score."""
    text = F.when(F.col("state") != "resolved", "An analyst is looking at it.").when(F.col("resolution") == "confirmed_phishing", "It was phishing. Thank you.").otherwise("It was safe. Thank you.")
    return cases.filter("origin = 'user_report'").select("case_id", "state", text.alias("status"))


def retention_keep(decisions: DataFrame, cases: DataFrame, cutoff) -> DataFrame:
    """Decisions that a purge leaves: young ones, and old ones under an active case."""
    active = cases.filter(F.col("state").isin(*ACTIVE)).select("decision_id").distinct()
    old = decisions.filter(F.col("created_ts") < F.lit(cutoff))
    gone = old.join(active, "decision_id", "left_anti").select("decision_id")
    return decisions.join(gone, "decision_id", "left_anti")


def stage_timings(spans: DataFrame, by: str = "event_type", value: str = "latency_ms") -> DataFrame:
    """Total and percentiles of spans by name."""
    p = quantiles(spans, value, (0.5, 0.95, 0.99), (by,)).withColumnRenamed("q", "p")
    out = spans.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("max")).join(F.broadcast(p), by, "left")
    return out.select(by, "n", F.round("total", 4).alias("total_ms"), F.round("mean", 6).alias("mean_ms"), *(F.round(F.col("p")[i], 6).alias(f"p{q}_ms") for i, q in enumerate((50, 95, 99))), F.col("max").alias("max_ms"))


def trace_summary(spans: DataFrame) -> DataFrame:
    """Spans of one user's day in order of start, each with its place and the time since the one before."""
    by = Window.partitionBy("sender", "day").orderBy("ts", "msg_id")
    x = spans.withColumn("day", F.to_date("ts"))
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.unix_timestamp(F.lag("ts").over(by).cast("timestamp"))
    return x.select("msg_id", "sender", "day", F.row_number().over(by).alias("place"), gap.alias("gap_seconds"))
