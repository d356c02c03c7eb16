"""Cases of the review queue: opening, details, what an actor may do, updates on a state, and the purge with what hangs on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workflow import refusal

from .review import ACTIVE, SLA_SECONDS

ACTIONS = ("claim", "unclaim", "escalate", "resolve", "reopen", "comment")


def priority(origin: Column, band: Column) -> Column:
    """1 for a report on delivered mail, 2 for mail held for review, else 3."""
    return F.when((origin == "user_report") & (band == "ALLOW"), 1).when(band == "REVIEW", 2).otherwise(3)


def open_cases(decisions: DataFrame, reports: Column) -> DataFrame:
    """A case for each decision held for review, and for each that a user reports."""
    x = decisions.filter((F.col("band") == "REVIEW") | reports)
    x = x.withColumn("origin", F.when(reports, "user_report").otherwise("model_review"))
    x = x.withColumn("priority", priority(F.col("origin"), F.col("band")))
    seconds = F.coalesce(*(F.when(F.col("priority") == p, F.lit(s)) for p, s in SLA_SECONDS.items()))
    due = (F.unix_micros(F.col("created_ts").cast("timestamp")) / 1_000_000).cast("bigint") + seconds
    return x.select(F.col("decision_id").alias("case_id"), "decision_id", "origin", "priority", F.lit("open").alias("state"), "created_ts", due.alias("sla_due_epoch"))


def case_detail(cases: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Each case with its decision and its events in order of their ids."""
    history = events.groupBy("decision_id").agg(F.sort_array(F.collect_list(F.struct("feedback_id", "analyst_label"))).alias("e"))
    text = F.array_join(F.transform("e", lambda x: F.concat_ws(":", x["feedback_id"].cast("string"), x["analyst_label"])), ",")
    x = cases.join(decisions.select("decision_id", "score", "band", "sender_domain"), "decision_id").join(history, "decision_id", "left")
    return x.select("case_id", "state", "priority", "score", "band", "sender_domain", F.coalesce(F.size("e"), F.lit(0)).alias("n_events"), F.coalesce(text, F.lit("")).alias("history"))


def allowed_actions(cases: DataFrame) -> DataFrame:
    """Of each (case, actor): the actions open to them, by name."""
    asked = cases.select("*", F.explode(F.array(*map(F.lit, ACTIONS))).alias("action"))
    good = asked.withColumn("why", refusal(F.col("action")))
    return good.groupBy("case_id").agg(F.array_join(F.sort_array(F.collect_list(F.when(F.col("why").isNull(), F.col("action")))), ",").alias("actions"))


def monitoring_rows(decisions: DataFrame, cutoff: Column, limit: int = 20_000) -> DataFrame:
    """The newest rows for monitoring, without contents."""
    names = ("decision_id", "created_ts", "score", "band", "body_length", "recipient_count", "attachment_count", "behavioral_available")
    return decisions.filter(F.col("created_ts") >= cutoff).select(*names).orderBy(F.desc("created_ts"), F.desc("decision_id")).limit(limit)


def purge_counts(decisions: DataFrame, cases: DataFrame, feedback: DataFrame, cutoff: Column) -> DataFrame:
    """What a purge takes from each table: old decisions without an active case, and what hangs on them."""
    active = cases.filter(F.col("state").isin(*ACTIVE)).select("decision_id").distinct()
    gone = decisions.filter(F.col("created_ts") < cutoff).select("decision_id").join(active, "decision_id", "left_anti")
    out = gone.agg(F.lit("decisions").alias("kind"), F.count(F.lit(1)).alias("n"))
    for name, t in (("cases", cases), ("feedback", feedback)):
        out = out.unionByName(t.join(gone, "decision_id", "left_semi").agg(F.lit(name).alias("kind"), F.count(F.lit(1)).alias("n")))
    return out


def resolved_page(cases: DataFrame, limit: int = 50) -> DataFrame:
    """Resolved cases, newest first."""
    return cases.filter("state = 'resolved'").orderBy(F.desc("created_ts"), F.desc("case_id")).limit(limit).select("case_id", "resolution", "origin", "priority")


def corpus_verdict(rows: DataFrame, least: int = 50, most_noise: float = 0.01, drift: float = 0.08) -> DataFrame:
    """One row: rows, label noise, exact copies, coverage of both classes, and whether the corpus is ready. rows: (text, label)."""
    by = rows.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k"), F.sum(F.col("label").cast("long")).alias("pos"))
    x = by.agg(F.sum("n").alias("n"), F.sum("pos").alias("positive"), F.sum(F.when(F.col("k") > 1, F.col("n")).otherwise(0)).alias("noisy"), F.sum(F.col("n") - 1).alias("copies"))
    bad = {"few_positive": F.col("positive") < least, "few_negative": F.col("n") - F.col("positive") < least, "label_noise": F.col("noisy") > most_noise * F.col("n"), "copies": F.col("copies") > drift * F.col("n")}
    why = F.array_join(F.array_compact(F.array(*(F.when(v, k) for k, v in bad.items()))), ",")
    return x.withColumn("failures", why).withColumn("verdict", F.when(F.col("failures") == "", "READY").otherwise("NOT READY"))


def robustness_bands(scored: DataFrame, after: Column) -> DataFrame:
    """Bands of phish before and after their rewriting, and how many moved to a lower one."""
    from .metrics import band

    x = scored.filter("y = 1").select(band("score").alias("before"), band(after).alias("after"))
    return x.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def adversarial_rows(scored: DataFrame, after: Column) -> DataFrame:
    """Scores with those of phish as they are after rewriting; legitimate mail as it is."""
    return scored.withColumn("score", F.when(F.col("y") == 1, after).otherwise(F.col("score")))


def family_successes(results: DataFrame) -> DataFrame:
    """Among attacks that got through only: how many used each family."""
    return results.filter("evaded").select(F.explode(F.array_distinct("families")).alias("family")).groupBy("family").agg(F.count(F.lit(1)).alias("n"))
