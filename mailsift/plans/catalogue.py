"""All queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import text as T
from mailsift.functions import urls
from mailsift.functions.refdata import ARCHIVE, BRAND_DOMAINS, BRANDS, CURRENCY, DISPOSABLE, DOCUMENT, EMOJI, ENTITY, EXECUTABLE, FREE_HOSTING, FREEMAIL, GREETED, HIDDEN_STYLE, IMPERATIVE, LEXICONS, MACRO, MAIL_ADDRESS, NUMBER, PASSWORD_INPUT, PHONE, RISKY_TLDS, SIGNED, UNSUBSCRIBE
from mailsift.operators import behaviour, corpus, drift, drift_null, links, messages, metrics, policy, reports, review, rules, workflow
from mailsift.operators.quantiles import quantiles
from mailsift.sources import mail as mail_source
from mailsift.sources.tables import ctes, mails, table, view, spread
from mailsift.streaming import state, windows

from . import mail

NOW, CUTOFF = "2024-03-01 00:00:00", "2024-01-15 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Registers a query, and its SQL behind the views it reads."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{ctes(*views)}\n{sql}" if views else sql
        return f

    return keep


# --- audit and review queue -------------------------------------------------

LATEST = "(SELECT decision_id, analyst_label, created_ts AS feedback_ts FROM (SELECT *, row_number() OVER (PARTITION BY decision_id ORDER BY created_ts DESC, feedback_id DESC) AS r FROM fx_feedback) WHERE r = 1)"


@query("decision_lookup", f"SELECT d.*, f.analyst_label, f.feedback_ts FROM fx_decisions d LEFT JOIN {LATEST} f ON f.decision_id = d.decision_id", "fx_decisions", "fx_feedback")
def _(spark, d):
    return review.decision_lookup(view(spark, d, "fx_decisions"), view(spark, d, "fx_feedback"))


@query("decision_page", f"SELECT d.*, f.analyst_label, f.feedback_ts FROM (SELECT * FROM fx_decisions WHERE band = 'REVIEW' AND score >= 0.5 ORDER BY created_ts DESC, decision_id DESC LIMIT 100) d LEFT JOIN {LATEST} f ON f.decision_id = d.decision_id", "fx_decisions", "fx_feedback")
def _(spark, d):
    return review.decision_page(view(spark, d, "fx_decisions"), view(spark, d, "fx_feedback"), band="REVIEW", min_score=0.5)


@query(
    "ops_stats",
    f"""SELECT count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(latency_ms), 6) AS mean_latency_ms, count(*) FILTER (band = 'ALLOW') AS allow,
    count(*) FILTER (band = 'REVIEW') AS review, count(*) FILTER (band = 'BLOCK') AS block, count(analyst_label) AS with_feedback,
    count(*) FILTER ((band = 'BLOCK' AND analyst_label = 'legitimate') OR (band = 'ALLOW' AND analyst_label = 'phishing')) AS disagreements
    FROM fx_decisions d LEFT JOIN {LATEST} f ON f.decision_id = d.decision_id""",
    "fx_decisions",
    "fx_feedback",
)
def _(spark, d):
    return review.ops_stats(view(spark, d, "fx_decisions"), view(spark, d, "fx_feedback"))


@query("top_domains", "SELECT sender_domain, count(*) AS n, round(avg(score), 6) AS mean_score FROM fx_decisions GROUP BY sender_domain ORDER BY n DESC, sender_domain LIMIT 10", "fx_decisions")
def _(spark, d):
    return review.top_domains(view(spark, d, "fx_decisions"))


@query("score_distribution", "SELECT least(CAST(floor(score * 20) AS INT), 19) AS bin, count(*) AS n FROM fx_decisions GROUP BY 1", "fx_decisions")
def _(spark, d):
    return review.score_distribution(view(spark, d, "fx_decisions"))


@query(
    "feedback_report",
    """SELECT band, analyst_label, CASE WHEN band = 'BLOCK' AND analyst_label = 'legitimate' THEN 'false_block' WHEN band = 'ALLOW' AND analyst_label = 'phishing' THEN 'missed_phish' ELSE 'none' END AS disagreement,
    count(*) AS n, round(avg(score), 6) AS mean_score FROM fx_decisions d JOIN fx_feedback f ON f.decision_id = d.decision_id GROUP BY 1, 2, 3""",
    "fx_decisions",
    "fx_feedback",
)
def _(spark, d):
    return review.feedback_report(view(spark, d, "fx_decisions"), view(spark, d, "fx_feedback"))


@query("refused_feedback", "SELECT * FROM fx_feedback f WHERE NOT EXISTS (SELECT 1 FROM fx_decisions d WHERE d.decision_id = f.decision_id AND d.band <> 'ALLOW')", "fx_decisions", "fx_feedback")
def _(spark, d):
    return review.refused_feedback(view(spark, d, "fx_decisions").filter("band <> 'ALLOW'"), view(spark, d, "fx_feedback"))


SLA = "CASE priority WHEN 1 THEN 3600 WHEN 2 THEN 14400 ELSE 86400 END"
AGE = f"CAST(epoch(TIMESTAMP '{NOW}') - floor(epoch(created_ts)) AS BIGINT)"


@query(
    "case_page",
    f"""SELECT c.case_id, priority, state, origin, score, band, sender_domain, age_seconds, age_seconds > sla AS overdue FROM
    (SELECT *, {SLA} AS sla, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(created_ts)) AS BIGINT) AS age_seconds FROM fx_cases WHERE state IN ('open', 'in_review', 'escalated') ORDER BY priority, created_ts, case_id LIMIT 50) c
    JOIN (SELECT decision_id, score, band, sender_domain FROM fx_decisions) d ON d.decision_id = c.decision_id""",
    "fx_cases",
)
def _(spark, d):
    return review.case_page(view(spark, d, "fx_cases"), view(spark, d, "fx_decisions"), NOW)


@query("queue_depth", f"SELECT state, count(*) AS n, count(*) FILTER (state <> 'resolved' AND {AGE} > {SLA}) AS overdue FROM fx_cases GROUP BY state", "fx_cases")
def _(spark, d):
    return review.queue_depth(view(spark, d, "fx_cases"), NOW)


@query(
    "queue_stats",
    f"""SELECT count(*) AS resolved, count(*) FILTER (resolution = 'confirmed_phishing') AS confirmed, quantile_cont(secs_to_claim, 0.5) AS median_claim, quantile_cont(secs_to_resolve, 0.5) AS median_resolve,
    round(avg(CASE WHEN secs_to_resolve <= {SLA} THEN 1.0 ELSE 0.0 END), 6) AS within_sla,
    round(sum(CASE WHEN origin = 'user_report' AND resolution = 'confirmed_phishing' THEN 1.0 ELSE 0 END) / nullif(sum(CASE WHEN origin = 'user_report' THEN 1.0 ELSE 0 END), 0), 6) AS report_precision
    FROM fx_cases WHERE state = 'resolved'""",
    "fx_cases",
)
def _(spark, d):
    return review.queue_stats(view(spark, d, "fx_cases"))


@query("first_case", "SELECT decision_id, arg_min(case_id, case_id) AS case_id, count(*) AS n_cases FROM fx_cases GROUP BY decision_id", "fx_cases")
def _(spark, d):
    return review.first_case(view(spark, d, "fx_cases"))


@query("resolution_feedback", "SELECT decision_id, case_id, CASE resolution WHEN 'confirmed_phishing' THEN 'phishing' WHEN 'released' THEN 'legitimate' ELSE 'unsure' END AS analyst_label FROM fx_cases WHERE state = 'resolved'", "fx_cases")
def _(spark, d):
    return review.resolution_feedback(view(spark, d, "fx_cases"))


@query("reporter_status", "SELECT case_id, state, CASE WHEN state <> 'resolved' THEN 'An analyst is looking at it.' WHEN resolution = 'confirmed_phishing' THEN 'It was phishing. Thank you.' ELSE 'It was safe. Thank you.' END AS status FROM fx_cases WHERE origin = 'user_report'", "fx_cases")
def _(spark, d):
    return review.reporter_status(view(spark, d, "fx_cases"))


@query("retention_keep", f"SELECT * FROM fx_decisions d WHERE created_ts >= TIMESTAMP '{CUTOFF}' OR decision_id IN (SELECT decision_id FROM fx_cases WHERE state <> 'resolved')", "fx_cases")
def _(spark, d):
    return review.retention_keep(view(spark, d, "fx_decisions"), view(spark, d, "fx_cases"), F.lit(CUTOFF).cast("timestamp_ntz"))


ACTION = "CASE decision_id % 7 WHEN 0 THEN 'claim' WHEN 1 THEN 'unclaim' WHEN 2 THEN 'escalate' WHEN 3 THEN 'resolve' WHEN 4 THEN 'reopen' WHEN 5 THEN 'comment' ELSE 'delete' END"
REQUEST = f"""SELECT case_id, state, {ACTION} AS action, CASE decision_id % 11 WHEN 0 THEN 'reporter' WHEN 1 THEN 'admin' WHEN 2 THEN 'admin' ELSE 'analyst' END AS role, decision_id % 3 = 0 AS owns,
    CASE WHEN decision_id % 2 = 0 THEN 'seen' ELSE '' END AS note, CASE decision_id % 9 WHEN 0 THEN 'inconclusive' WHEN 1 THEN '' ELSE resolution END AS resolution, CAST((decision_id * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM fx_cases"""


@query(
    "case_transitions",
    f"""SELECT case_id, action, refused, CASE WHEN refused IS NULL THEN CASE action WHEN 'claim' THEN 'in_review' WHEN 'unclaim' THEN 'open' WHEN 'escalate' THEN 'escalated' WHEN 'resolve' THEN 'resolved' WHEN 'reopen' THEN 'open' ELSE state END END AS next_state
    FROM (SELECT *, CASE WHEN role = 'reporter' THEN 'not_permitted'
        WHEN action = 'delete' THEN 'unknown_action'
        WHEN action = 'comment' THEN CASE WHEN note = '' THEN 'note_required' END
        WHEN action = 'claim' THEN CASE WHEN state <> 'open' THEN 'illegal_state' END
        WHEN action IN ('unclaim', 'escalate') AND state <> 'in_review' THEN 'illegal_state'
        WHEN action IN ('unclaim', 'escalate') AND NOT owns AND role <> 'admin' THEN 'not_assignee'
        WHEN action = 'escalate' AND note = '' THEN 'note_required'
        WHEN action = 'resolve' AND resolution NOT IN ('confirmed_phishing', 'released') THEN 'resolution_required'
        WHEN action = 'resolve' AND state = 'escalated' AND role <> 'admin' THEN 'needs_admin'
        WHEN action = 'resolve' AND state = 'in_review' AND NOT owns AND role <> 'admin' THEN 'not_assignee'
        WHEN action = 'resolve' AND state IN ('open', 'resolved') THEN 'illegal_state'
        WHEN action = 'resolve' AND resolution = 'released' AND note = '' THEN 'note_required'
        WHEN action = 'resolve' AND resolution = 'released' AND score >= 0.8 AND role <> 'admin' THEN 'needs_admin'
        WHEN action = 'reopen' AND state <> 'resolved' THEN 'illegal_state'
        WHEN action = 'reopen' AND role <> 'admin' THEN 'needs_admin'
        WHEN action = 'reopen' AND note = '' THEN 'note_required' END AS refused
      FROM ({REQUEST}))""",
    "fx_cases",
)
def _(spark, d):
    asked = spark.sql(REQUEST.replace("FROM fx_cases", "FROM {fx_cases}"), fx_cases=view(spark, d, "fx_cases"))
    return workflow.decided(asked).select("case_id", "action", "refused", "next_state")


@query(
    "stage_timings",
    """SELECT event_type, count(*) AS n, round(sum(latency_ms), 4) AS total_ms, round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms,
    round(quantile_cont(latency_ms, 0.99), 6) AS p99_ms, max(latency_ms) AS max_ms FROM fx_decisions GROUP BY event_type""",
    "fx_decisions",
)
def _(spark, d):
    return review.stage_timings(view(spark, d, "fx_decisions"))


@query(
    "trace_summary",
    """SELECT msg_id, sender, CAST(ts AS DATE) AS day, row_number() OVER w AS place, CAST(floor(epoch(ts)) - floor(epoch(lag(ts) OVER w)) AS BIGINT) AS gap_seconds
    FROM fx_mail_log WINDOW w AS (PARTITION BY sender, CAST(ts AS DATE) ORDER BY ts, msg_id)""",
    "fx_mail_log",
)
def _(spark, d):
    return review.trace_summary(view(spark, d, "fx_mail_log"))


# --- evaluation -------------------------------------------------------------

CONFUSION = "SELECT count(*) FILTER (y = 0 AND score < 0.5) AS tn, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 1 AND score >= 0.5) AS tp"


def _prf_sql(source: str, more: str = "") -> str:
    share = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN 0.0 ELSE ({a}) / CAST(({b}) AS DOUBLE) END)"
    p1, r1, p0, r0 = share("tp", "tp + fp"), share("tp", "tp + fn"), share("tn", "tn + fn"), share("tn", "tn + fp")
    return f"""SELECT {more} tn, fp, fn, tp, round(p1, 5) AS precision, round(r1, 5) AS recall, round(f1, 5) AS f1, round((f1 + f0) / 2, 5) AS macro_f1, round(acc, 5) AS accuracy, round(fpr, 5) AS fpr, round(fnr, 5) AS fnr
    FROM (SELECT *, {share("2 * p1 * r1", "p1 + r1")} AS f1, {share("2 * p0 * r0", "p0 + r0")} AS f0 FROM (SELECT *, {p1} AS p1, {r1} AS r1, {p0} AS p0, {r0} AS r0, {share("tp + tn", "tp + tn + fp + fn")} AS acc, {share("fp", "fp + tn")} AS fpr, {share("fn", "fn + tp")} AS fnr FROM ({source})))"""


@query("confusion_prf", _prf_sql(f"{CONFUSION} FROM fx_scored"), "fx_scored")
def _(spark, d):
    return metrics.prf(metrics.confusion(view(spark, d, "fx_scored")))


@query("slice_metrics", _prf_sql(f"SELECT * FROM ({CONFUSION}, slice_lang FROM fx_scored GROUP BY slice_lang) WHERE tn + fp + fn + tp >= 8", "slice_lang, tn + fp + fn + tp AS n, "), "fx_scored")
def _(spark, d):
    return metrics.slice_metrics(view(spark, d, "fx_scored"))


@query(
    "roc_auc",
    """SELECT round((sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS roc_auc, n0, n1 FROM
    (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r, CAST(sum(y) OVER () AS BIGINT) AS n1, CAST(sum(1 - y) OVER () AS BIGINT) AS n0 FROM fx_scored) GROUP BY n0, n1""",
    "fx_scored",
)
def _(spark, d):
    return metrics.roc_auc(view(spark, d, "fx_scored"))


RUNNING = "SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS pos_above, sum(neg) OVER (ORDER BY score DESC) AS neg_above FROM (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM fx_scored GROUP BY score)"


@query("pr_auc", f"SELECT round(sum(pos * pos_above / CAST(pos_above + neg_above AS DOUBLE)) / sum(pos), 6) AS pr_auc FROM ({RUNNING})", "fx_scored")
def _(spark, d):
    return metrics.pr_auc(view(spark, d, "fx_scored"))


@query(
    "fpr_threshold",
    f"SELECT target, min(score) AS threshold FROM ({RUNNING}) r, (SELECT unnest([0.06, 0.1, 0.25]::DOUBLE[]) AS target), (SELECT sum(1 - y) AS n0 FROM fx_scored) WHERE neg > 0 AND neg_above <= floor(CAST(target AS DOUBLE) * n0) GROUP BY target",
    "fx_scored",
)
def _(spark, d):
    return metrics.threshold_for_fpr(view(spark, d, "fx_scored"), (0.06, 0.1, 0.25))


BANDED = "SELECT *, CASE WHEN score >= 0.8 THEN 'BLOCK' WHEN score >= 0.4 THEN 'REVIEW' ELSE 'ALLOW' END AS band FROM fx_scored"


@query(
    "banded_outcome",
    _prf_sql(
        f"""SELECT count(*) AS n, count(*) FILTER (band = 'ALLOW') AS allow, count(*) FILTER (band = 'REVIEW') AS review, count(*) FILTER (band = 'BLOCK') AS block, count(*) FILTER (y = 0 AND band = 'ALLOW') AS tn, count(*) FILTER (y = 0 AND band = 'BLOCK') AS fp,
        count(*) FILTER (y = 1 AND band = 'ALLOW') AS fn, count(*) FILTER (y = 1 AND band = 'BLOCK') AS tp, count(*) FILTER (y = 1 AND band = 'REVIEW') AS phish_in_review, count(*) FILTER (y = 0 AND band = 'REVIEW') AS ham_in_review FROM ({BANDED})""",
        "n, allow, review, block, phish_in_review, ham_in_review, round(review / CAST(n AS DOUBLE), 6) AS review_rate, ",
    ),
    "fx_scored",
)
def _(spark, d):
    return metrics.banded_outcome(view(spark, d, "fx_scored"))


@query(
    "recall_curve",
    f"""SELECT CAST(g AS INT) AS cell, round(coalesce(max(p), 0.0), 6) AS precision FROM (SELECT unnest(range(101)) AS g) LEFT JOIN
    (SELECT pos_above / CAST(pos_above + neg_above AS DOUBLE) AS p, floor(pos_above * 100 / CAST((SELECT sum(y) FROM fx_scored) AS DOUBLE)) AS c FROM ({RUNNING}) WHERE pos_above > 0) ON c >= g GROUP BY g""",
    "fx_scored",
)
def _(spark, d):
    return metrics.recall_curve(view(spark, d, "fx_scored"))


BINS15 = "SELECT CAST(least(floor(score * 15), 14) AS INT) AS bin, count(*) AS n, avg(score) AS c, avg(y) AS a, sum((score - y) * (score - y)) AS sq FROM fx_scored GROUP BY 1"


@query("reliability", f"SELECT CAST(g AS INT) AS bin, coalesce(n, 0) AS n, round(c, 6) AS confidence, round(a, 6) AS accuracy FROM (SELECT unnest(range(15)) AS g) LEFT JOIN ({BINS15}) ON bin = g", "fx_scored")
def _(spark, d):
    return metrics.reliability(view(spark, d, "fx_scored"))


@query("calibration_errors", f"SELECT round(sum(abs(c - a) * n) / sum(n), 6) AS ece, round(coalesce(max(abs(c - a)) FILTER (n >= 20), 0.0), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM ({BINS15})", "fx_scored")
def _(spark, d):
    return metrics.calibration_errors(view(spark, d, "fx_scored"))


@query("score_histogram", "SELECT y, CAST(least(floor(score * 40), 39) AS INT) AS bin, count(*) AS n FROM fx_scored GROUP BY 1, 2", "fx_scored")
def _(spark, d):
    return metrics.class_histogram(view(spark, d, "fx_scored"))


@query("confidence_profile", "SELECT CAST(least(floor(round(2 * abs(score - 0.5), 9) * 10), 9) AS INT) AS decile, count(*) AS n, round(avg(CASE WHEN CAST(score >= 0.5 AS INT) = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM fx_scored GROUP BY 1", "fx_scored")
def _(spark, d):
    return metrics.confidence_profile(view(spark, d, "fx_scored"))


@query(
    "error_classes",
    """SELECT CASE WHEN y = 1 THEN CASE WHEN agree = 0 THEN 'missed_by_all' WHEN abs(score - 0.5) < 0.05 THEN 'missed_narrowly' WHEN m_rules < 0.5 THEN 'missed_by_rules' ELSE 'missed_in_fusion' END
    ELSE CASE WHEN agree = 0 THEN 'alarm_by_all' WHEN abs(score - 0.5) < 0.05 THEN 'alarm_narrowly' WHEN m_rules >= 0.5 THEN 'alarm_by_rules' ELSE 'alarm_in_fusion' END END AS kind, count(*) AS n, round(max(abs(score - 0.5)), 6) AS worst
    FROM (SELECT *, CAST(CAST(m_rules >= 0.5 AS INT) = y AS INT) + CAST(CAST(m_engineered >= 0.5 AS INT) = y AS INT) + CAST(CAST(m_charngram >= 0.5 AS INT) = y AS INT) + CAST(CAST(m_wordtfidf >= 0.5 AS INT) = y AS INT) AS agree FROM fx_scored)
    WHERE CAST(score >= 0.5 AS INT) <> y GROUP BY 1""",
    "fx_scored",
)
def _(spark, d):
    return metrics.error_classes(view(spark, d, "fx_scored"))


@query("worst_errors", "SELECT id, y, score, round(abs(score - 0.5), 6) AS severity FROM fx_scored WHERE CAST(score >= 0.5 AS INT) <> y ORDER BY severity DESC, id LIMIT 12", "fx_scored")
def _(spark, d):
    return metrics.worst_errors(view(spark, d, "fx_scored"))


# --- policy -----------------------------------------------------------------

LISTED = "[m_rules, m_engineered, m_charngram, m_wordtfidf]"


@query(
    "abstention_bands",
    f"""SELECT id, spread, base_band, abstained, CASE WHEN abstained THEN 'REVIEW' ELSE base_band END AS band FROM (SELECT *, round(spread, 9) >= 0.45 AND list_min(m) < 0.4 AND (len(list_filter(m, lambda x: x >= 0.4)) >= 2 OR list_max(m) >= 0.8) AND base_band <> 'REVIEW' AS abstained
    FROM (SELECT id, band AS base_band, {LISTED} AS m, list_max({LISTED}) - list_min({LISTED}) AS spread FROM ({BANDED})))""",
    "fx_scored",
)
def _(spark, d):
    return policy.abstention(view(spark, d, "fx_scored")).select("id", "spread", "base_band", "abstained", "band")


@query(
    "velocity_guard",
    """SELECT decision_id, round(CASE WHEN available AND bump > 0.005 AND raised - score >= 0.0005 THEN raised ELSE score END, 9) AS guarded FROM (SELECT *, greatest(score, least(score + bump * (1 - score), 0.99)) AS raised FROM
    (SELECT *, least(0.10 * least(ln(1 + burst) / 4, 1.0) * first_seen + 0.04 * CAST(reports > 0 AS INT) + 0.03 * CAST(aliases > 1 AS INT), 0.15) AS bump FROM
    (SELECT decision_id, score, behavioral_available = 1 AS available, body_length // 37 AS burst, CAST(decision_id % 5 = 0 AS INT) AS first_seen, attachment_count AS reports, recipient_count AS aliases FROM fx_decisions)))""",
    "fx_decisions",
)
def _(spark, d):
    x = view(spark, d, "fx_decisions").selectExpr("decision_id", "score", "behavioral_available = 1 AS available", "body_length div 37 AS burst_count_1h", "decision_id % 5 = 0 AS first_seen", "attachment_count AS domain_report_count", "recipient_count AS display_name_alias_count")
    return policy.velocity_guard(x).select("decision_id", F.round("guarded", 9).alias("guarded"))


GRID = "(SELECT unnest([0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]::DOUBLE[]) AS t)"


def _cost_sql(miss: str) -> str:
    return f"""(SELECT miss, review, block, pa, pr, hr, hb, 50 * miss * (pa + 0.05 * pr) AS missed_cost, 1000 * (0.05 * pr + 0.95 * hr) AS reviews, 950 * 15.0 * (hb + 0.05 * hr) AS false_block_cost,
    round(50 * miss * (pa + 0.05 * pr) + 1000 * (0.05 * pr + 0.95 * hr) + 950 * 15.0 * (hb + 0.05 * hr), 6) AS cost FROM
    (SELECT a.t AS review, b.t AS block, 1 - a.p / n1 AS pa, (a.p - b.p) / n1 AS pr, (a.n - b.n) / n0 AS hr, b.n / n0 AS hb FROM at_t a JOIN at_t b ON a.t <= b.t, totals), (SELECT unnest({miss}::DOUBLE[]) AS miss))"""


AT = f""", at_t AS (SELECT t, CAST(coalesce(sum(y), 0) AS DOUBLE) AS p, CAST(coalesce(sum(1 - y), 0) AS DOUBLE) AS n FROM {GRID} LEFT JOIN fx_scored ON score >= t GROUP BY t), totals AS (SELECT CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM fx_scored)"""


@query("policy_cost", f"{AT} SELECT review, block, round(pa, 6) AS p_allow_phish, round(pr, 6) AS p_review_phish, round(hr, 6) AS p_review_ham, round(hb, 6) AS p_block_ham, round(missed_cost, 6) AS missed_cost, round(reviews, 6) AS reviews, round(false_block_cost, 6) AS false_block_cost, cost FROM {_cost_sql('[200]')}", "fx_scored")
def _(spark, d):
    return policy.policy_costs(view(spark, d, "fx_scored"))


@query("policy_best", f"{AT} SELECT miss, review, block, cost FROM (SELECT *, row_number() OVER (PARTITION BY miss ORDER BY cost, review, block) AS r FROM {_cost_sql('[50, 100, 200, 400, 800]')}) WHERE r = 1", "fx_scored")
def _(spark, d):
    return policy.policy_best(view(spark, d, "fx_scored"))


@query("minimax_regret", f"{AT} SELECT review, block, round(max(cost - best), 6) AS worst_regret FROM (SELECT *, min(cost) OVER (PARTITION BY miss) AS best FROM {_cost_sql('[50, 100, 200, 800]')}) GROUP BY review, block", "fx_scored")
def _(spark, d):
    return policy.minimax_regret(view(spark, d, "fx_scored"))


@query(
    "cost_frontier",
    f"""{AT}, c AS (SELECT review, block, round(reviews, 6) AS reviews, round(pa, 6) AS p FROM {_cost_sql('[200]')})
    SELECT review, block, reviews, p AS p_allow_phish FROM (SELECT *, row_number() OVER (PARTITION BY reviews, p ORDER BY review, block) AS r FROM c) x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE (c.reviews < x.reviews AND c.p <= x.p) OR (c.reviews <= x.reviews AND c.p < x.p))""",
    "fx_scored",
)
def _(spark, d):
    return policy.frontier(view(spark, d, "fx_scored"))


# --- drift and time series --------------------------------------------------


@query("time_series", "SELECT CAST(created_ts AS DATE) AS day, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(band = 'ALLOW' AS INT)), 6) AS allow_share, round(avg(CAST(band = 'REVIEW' AS INT)), 6) AS review_share, round(avg(CAST(band = 'BLOCK' AS INT)), 6) AS block_share, round(quantile_cont(latency_ms, 0.95), 6) AS p95_ms FROM fx_decisions GROUP BY 1", "fx_decisions")
def _(spark, d):
    return drift.time_series(view(spark, d, "fx_decisions"))


LONG = """, at_time AS (SELECT quantile_disc(epoch_us(created_ts), 0.5) AS cut FROM fx_decisions),
rows_ AS (SELECT created_ts, epoch_us(created_ts) >= cut AS live, unnest([{'q': 'score', 'v': score}, {'q': 'latency_ms', 'v': latency_ms}, {'q': 'log_body_length', 'v': ln(1 + body_length)}, {'q': 'recipient_count', 'v': CAST(recipient_count AS DOUBLE)}, {'q': 'attachment_count', 'v': CAST(attachment_count AS DOUBLE)}, {'q': 'behavioral_available', 'v': CAST(behavioral_available AS DOUBLE)}]) AS s FROM fx_decisions, at_time),
long_ AS (SELECT created_ts, live, s.q AS quantity, s.v AS value FROM rows_ WHERE s.v IS NOT NULL)"""


def _psi_sql(week: str) -> str:
    return f"""{LONG}, edges_ AS (SELECT quantity, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS e FROM long_ WHERE NOT live GROUP BY quantity),
    b AS (SELECT {week} AS week, live, quantity, len(list_filter(e, lambda x: x <= value)) AS bin, count(*) AS n FROM long_ JOIN edges_ USING (quantity) GROUP BY ALL),
    grid AS (SELECT week, quantity, unnest(range(len(e) + 1)) AS bin FROM edges_ JOIN (SELECT DISTINCT week, quantity FROM b WHERE live) USING (quantity)),
    x AS (SELECT g.week, g.quantity, g.bin, CAST(coalesce(r.n, 0) AS DOUBLE) AS e, CAST(coalesce(l.n, 0) AS DOUBLE) AS a FROM grid g LEFT JOIN (SELECT quantity, bin, sum(n) AS n FROM b WHERE NOT live GROUP BY ALL) r ON r.quantity = g.quantity AND r.bin = g.bin LEFT JOIN b l ON l.live AND l.week = g.week AND l.quantity = g.quantity AND l.bin = g.bin),
    f AS (SELECT week, quantity, a AS n, greatest(e / sum(e) OVER w, 1e-4) AS pe, greatest(a / sum(a) OVER w, 1e-4) AS pa FROM x WINDOW w AS (PARTITION BY week, quantity)),
    s AS (SELECT week, quantity, n, pe / sum(pe) OVER w AS pe, pa / sum(pa) OVER w AS pa FROM f WINDOW w AS (PARTITION BY week, quantity)),
    p AS (SELECT week, quantity, round(sum((pa - pe) * ln(pa / pe)), 6) AS psi, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY week, quantity)"""


@query("psi_by_quantity", f"{_psi_sql('0')} SELECT quantity, psi, n, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity FROM p", "fx_decisions")
def _(spark, d):
    return drift.psi(*drift.split_by_time(view(spark, d, "fx_decisions")))


@query("drift_weekly", f"{_psi_sql('CASE WHEN live THEN CAST(date_trunc(chr(119) || chr(101) || chr(101) || chr(107), created_ts) AS DATE) END')} SELECT week, quantity, psi, n, CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'stable' END AS severity FROM p".replace("chr(119) || chr(101) || chr(101) || chr(107)", "'week'"), "fx_decisions")
def _(spark, d):
    return drift.weekly(view(spark, d, "fx_decisions"))


@query(
    "ks_statistic",
    f"""{LONG}, each AS (SELECT quantity, value, count(*) FILTER (NOT live) AS r, count(*) FILTER (live) AS l FROM long_ GROUP BY ALL)
    SELECT quantity, round(max(abs(cr / tr - cl / tl)), 6) AS ks FROM (SELECT quantity, CAST(sum(r) OVER up AS DOUBLE) AS cr, CAST(sum(l) OVER up AS DOUBLE) AS cl, sum(r) OVER al AS tr, sum(l) OVER al AS tl FROM each WINDOW up AS (PARTITION BY quantity ORDER BY value), al AS (PARTITION BY quantity)) GROUP BY quantity""",
    "fx_decisions",
)
def _(spark, d):
    return drift.ks(*drift.split_by_time(view(spark, d, "fx_decisions"))).select("quantity", "ks")


# --- windows over time ------------------------------------------------------


@query("band_ratio_windows", "SELECT time_bucket(INTERVAL 30 MINUTES, created_ts) AS window_start, count(*) AS n, round(avg(CAST(band = 'BLOCK' AS INT)), 6) AS block_share, round(avg(CAST(band = 'REVIEW' AS INT)), 6) AS review_share, round(avg(CAST(behavioral_available = 0 AS INT)), 6) AS blind_share FROM fx_decisions GROUP BY 1", "fx_decisions")
def _(spark, d):
    return windows.band_ratios(view(spark, d, "fx_decisions")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("counter_windows", "SELECT time_bucket(INTERVAL 1 HOUR, created_ts) AS window_start, band, event_type, count(*) AS n FROM fx_decisions GROUP BY 1, 2, 3", "fx_decisions")
def _(spark, d):
    return windows.counters(view(spark, d, "fx_decisions")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("domain_burst_windows", "SELECT time_bucket(INTERVAL 15 MINUTES, ts) - to_minutes(15 * k) AS window_start, sender_domain, count(*) AS n FROM fx_mail_log, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY 1, 2", "fx_mail_log")
def _(spark, d):
    return windows.domain_bursts(view(spark, d, "fx_mail_log")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


EDGES = (5, 10, 25, 50, 75, 100, 150, 250, 500, 1000)


def _latency_sql() -> str:
    cases = " ".join(f"WHEN le_{i} >= 0.95 * n THEN {EDGES[i - 1] if i else 0} + {EDGES[i] - (EDGES[i - 1] if i else 0)} * (0.95 * n - {f'le_{i - 1}' if i else 0}) / CAST(le_{i} - {f'le_{i - 1}' if i else 0} AS DOUBLE)" for i in range(len(EDGES)))
    counts = ", ".join(f"count(*) FILTER (latency_ms <= {e}) AS le_{i}" for i, e in enumerate(EDGES))
    return f"SELECT window_start, n, round(p, 6) AS p95_ms, p > 150 AS slow FROM (SELECT window_start, n, CASE {cases} ELSE {EDGES[-1]}.0 END AS p FROM (SELECT time_bucket(INTERVAL 5 MINUTES, created_ts) AS window_start, count(*) AS n, {counts} FROM fx_decisions GROUP BY 1))"


@query("latency_p95_windows", _latency_sql(), "fx_decisions")
def _(spark, d):
    return windows.latency_windows(view(spark, d, "fx_decisions"))


@query(
    "user_sessions",
    """SELECT min(ts) AS session_start, max(ts) + INTERVAL 10 MINUTES AS session_end, sender, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY sender ORDER BY ts) AS s FROM
    (SELECT *, CASE WHEN ts >= lag(ts) OVER (PARTITION BY sender ORDER BY ts) + INTERVAL 10 MINUTES THEN 1 ELSE 0 END AS new FROM fx_mail_log)) GROUP BY sender, s""",
    "fx_mail_log",
)
def _(spark, d):
    x = windows.user_sessions(view(spark, d, "fx_mail_log"))
    return x.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("alert_for_duration", """, w AS (SELECT time_bucket(INTERVAL 1 HOUR, created_ts) AS window_start, count(*) AS n, avg(CAST(band = 'REVIEW' AS INT)) AS s FROM fx_decisions GROUP BY 1)
    SELECT a.window_start, a.n FROM w a JOIN w b ON b.window_start BETWEEN a.window_start - INTERVAL 2 HOURS AND a.window_start WHERE b.s > 0.35 GROUP BY a.window_start, a.n HAVING count(*) = 3""", "fx_decisions")
def _(spark, d):
    w = windows.band_ratios(view(spark, d, "fx_decisions"), "1 hour")
    return windows.alerts_for(w, "review_share > 0.35", 3, 3600).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# --- sender history ---------------------------------------------------------


@query("behaviour_prior", "SELECT msg_id, p AS prior_messages, p = 0 AS first_seen FROM (SELECT msg_id, (rank() OVER (PARTITION BY sender, recipient ORDER BY ts)) - 1 AS p FROM fx_mail_log)", "fx_mail_log")
def _(spark, d):
    return behaviour.prior_messages(view(spark, d, "fx_mail_log"))


@query("behaviour_replies", "SELECT a.msg_id, count(b.msg_id) AS prior_replies FROM fx_mail_log a LEFT JOIN fx_mail_log b ON b.sender = a.recipient AND b.recipient = a.sender AND b.ts < a.ts GROUP BY a.msg_id", "fx_mail_log")
def _(spark, d):
    return behaviour.prior_replies(view(spark, d, "fx_mail_log"))


@query("burst_1h", "SELECT msg_id, count(*) OVER (PARTITION BY sender_domain ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS burst_count_1h FROM fx_mail_log", "fx_mail_log")
def _(spark, d):
    return behaviour.burst_1h(view(spark, d, "fx_mail_log"))


@query("alias_count", "SELECT display_name, count(DISTINCT sender) AS display_name_alias_count FROM fx_mail_log GROUP BY 1", "fx_mail_log")
def _(spark, d):
    return behaviour.alias_counts(view(spark, d, "fx_mail_log"))


@query("domain_age", "SELECT msg_id, CAST((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY sender_domain))) // 86400000000 AS BIGINT) AS domain_age_days FROM fx_mail_log", "fx_mail_log")
def _(spark, d):
    return behaviour.domain_age(view(spark, d, "fx_mail_log"))


@query("local_time", "SELECT msg_id, CAST(hour(ts) AS INT) AS hour_local, hour(ts) < 7 OR hour(ts) >= 21 AS off_hours, dayofweek(ts) IN (0, 6) AS is_weekend FROM fx_mail_log", "fx_mail_log")
def _(spark, d):
    return behaviour.local_time(view(spark, d, "fx_mail_log"))


@query("domain_reports", "SELECT msg_id, CAST(coalesce(sum(CAST(event_type = 'error' AS INT)) OVER (PARTITION BY sender_domain ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0) AS BIGINT) AS domain_report_count, round(coalesce(avg(CAST(event_type = 'click' AS INT)) OVER (PARTITION BY sender_domain ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING), 0.0), 6) AS domain_click_rate FROM fx_mail_log", "fx_mail_log")
def _(spark, d):
    return behaviour.domain_reports(view(spark, d, "fx_mail_log"))


@query("thread_depth", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS thread_depth FROM conversations")
def _(spark, d):
    return behaviour.thread_depth(table(spark, d, "conversations"))


BEFORE = "OVER (PARTITION BY sender_domain ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"


@query(
    "behaviour_history",
    f""", h AS (SELECT m.*, count(*) OVER (PARTITION BY sender, recipient ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS prior_messages,
      (SELECT count(*) FROM fx_mail_log b WHERE b.sender = m.recipient AND b.recipient = m.sender AND b.ts < m.ts) AS prior_replies,
      CAST(coalesce(sum(CAST(event_type = 'error' AS INT)) {BEFORE}, 0) AS BIGINT) AS domain_report_count, round(coalesce(avg(CAST(event_type = 'click' AS INT)) {BEFORE}, 0.0), 6) AS domain_click_rate,
      CAST((epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY sender_domain))) // 86400000000 AS BIGINT) AS domain_age_days,
      count(*) OVER (PARTITION BY sender_domain ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS burst_count_1h,
      (SELECT count(DISTINCT b.sender) FROM fx_mail_log b WHERE b.display_name = m.display_name AND b.ts <= m.ts) AS display_name_alias_count FROM fx_mail_log m),
    k AS (SELECT *, prior_messages = 0 AS first_seen, CAST(hour(ts) AS INT) AS hour_local, dayofweek(ts) IN (0, 6) AS is_weekend,
      0.6 * (1 - exp(-prior_messages / 8.0)) + 0.4 * (CASE WHEN prior_messages = 0 THEN 0.0 ELSE least(prior_replies / CAST(prior_messages AS DOUBLE), 1.0) END) AS bond FROM h)
    SELECT msg_id, true AS available, first_seen, prior_messages, prior_replies, hour_local, is_weekend, true AS external_sender, domain_report_count, domain_click_rate, burst_count_1h, CAST(display_name_alias_count AS BIGINT) AS display_name_alias_count, domain_age_days,
      round(bond, 6) AS relationship_strength, round(least(ln(1 + greatest(burst_count_1h, 1)) / 4, 1.0) * CAST(first_seen AS INT), 6) AS campaign_shape,
      round(least(greatest(0.25 * CAST(first_seen AS INT) + 0.25 * CAST(domain_age_days < 90 AS INT) + 0.10 * CAST(hour_local < 7 OR hour_local >= 21 AS INT) + 0.20 * (1 - bond), 0.0), 1.0), 6) AS trust_deficit FROM k""",
    "fx_mail_log",
)
def _(spark, d):
    return behaviour.history(view(spark, d, "fx_mail_log"))


@query("running_aliases", "SELECT msg_id, (SELECT count(DISTINCT b.sender) FROM fx_mail_log b WHERE b.display_name = m.display_name AND b.ts <= m.ts) AS display_name_alias_count FROM fx_mail_log m", "fx_mail_log")
def _(spark, d):
    return behaviour.running_aliases(view(spark, d, "fx_mail_log"))


BOND = "CASE WHEN available THEN 0.6 * (1 - exp(-prior_messages / 8.0)) + 0.4 * (CASE WHEN prior_messages = 0 THEN 0.0 ELSE least(prior_replies / CAST(prior_messages AS DOUBLE), 1.0) END) ELSE 0.0 END"


@query(
    "behaviour_features",
    f""", c AS (SELECT *, {BOND} AS bond, CAST(first_seen OR NOT available AS INT)::DOUBLE AS new, CAST(available AND domain_age_days < 90 AS INT)::DOUBLE AS young, CAST(hour_local < 7 OR hour_local >= 21 AS INT)::DOUBLE AS off_, CAST(external_sender AS INT)::DOUBLE AS outside,
      CAST(received_hops AS DOUBLE) AS financial, CAST(received_hops + recipients AS DOUBLE) AS ask, CAST(recipients AS DOUBLE) AS urgent, greatest(recipient_count, 1) AS to_, greatest(burst_count_1h, 1) AS burst, greatest(display_name_alias_count, 1) AS names FROM fx_mail)
    SELECT message_id, CAST(available AS INT)::DOUBLE AS beh_context_available, new AS beh_sender_first_seen, prior_messages::DOUBLE AS beh_prior_messages, round(ln(1 + prior_messages), 6) AS beh_prior_messages_log, prior_replies::DOUBLE AS beh_prior_replies,
      round(CASE WHEN prior_messages = 0 THEN 0.0 ELSE prior_replies / CAST(prior_messages AS DOUBLE) END, 6) AS beh_reply_ratio, round(bond, 6) AS beh_relationship_strength, thread_depth::DOUBLE AS beh_thread_depth, CAST(thread_depth <= 0 AS INT)::DOUBLE AS beh_is_new_thread,
      round(new * least(ask / 4, 1.0), 6) AS beh_cold_contact_with_ask, hour_local::DOUBLE AS beh_hour_local, off_ AS beh_off_hours, CAST(is_weekend AS INT)::DOUBLE AS beh_is_weekend, round(off_ * least(urgent / 3, 1.0), 6) AS beh_odd_hour_and_urgent,
      to_::DOUBLE AS beh_recipient_count, bcc_count::DOUBLE AS beh_bcc_count, round(bcc_count / CAST(to_ + bcc_count AS DOUBLE), 6) AS beh_bcc_ratio, CAST(to_ >= 25 OR bcc_count >= 25 AS INT)::DOUBLE AS beh_mass_mailing, outside AS beh_external_sender,
      round(outside * least(financial / 4, 1.0), 6) AS beh_external_and_financial, domain_report_count::DOUBLE AS beh_domain_report_count, CAST(domain_report_count > 0 AS INT)::DOUBLE AS beh_domain_reported, round(domain_click_rate, 6) AS beh_domain_click_rate,
      burst::DOUBLE AS beh_burst_count_1h, round(ln(1 + burst), 6) AS beh_burst_log, round(least(ln(1 + burst) / 4, 1.0) * new, 6) AS beh_campaign_shape, names::DOUBLE AS beh_display_name_alias_count, CAST(names > 1 AS INT)::DOUBLE AS beh_display_name_reuse,
      domain_age_days::DOUBLE AS beh_domain_age_days, round(ln(1 + domain_age_days), 6) AS beh_domain_age_log, young AS beh_young_domain, round(young * least(ask / 4, 1.0), 6) AS beh_young_domain_and_ask,
      round(0.25 * new + 0.25 * young + 0.10 * off_ + 0.20 * (1 - bond) + 0.20 * least(ask / 6, 1.0), 6) AS beh_trust_deficit FROM c""",
    "fx_mail",
)
def _(spark, d):
    x = view(spark, d, "fx_mail")
    hops, to = F.col("received_hops").cast("double"), F.col("recipients").cast("double")  # stand in for what texts ask for
    found = behaviour.features(behaviour.context(x), hops, hops + to, to)
    return x.select("message_id", *(F.round(v, 6).alias(k) for k, v in found.items()))


# --- text, URLs, links, messages --------------------------------------------

HOST = r"regexp_extract(href, '^[a-z]+://(?:[^/?#]*@)?([^/:?#]+)', 1)"


@query("url_suffix_split", f"SELECT message_id, pos, host, suffix, CASE WHEN suffix = '' THEN host ELSE array_to_string(l[-(len(string_split(suffix, '.')) + 1):], '.') END AS registered_domain FROM (SELECT *, string_split(host, '.') AS l, CASE WHEN regexp_full_match(host, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') THEN '' WHEN host = 'evil.pages.dev' THEN 'pages.dev' ELSE string_split(host, '.')[-1] END AS suffix FROM (SELECT message_id, pos, {HOST} AS host FROM fx_links))", "fx_links")
def _(spark, d):
    host = urls.host_of(F.col("href"))
    return spread(view(spark, d, "fx_links")).select("message_id", "pos", host.alias("host"), urls.suffix_of(host).alias("suffix"), urls.registered_domain(host, urls.suffix_of(host)).alias("registered_domain"))


@query(
    "url_shape",
    f"""SELECT message_id, pos, CAST(length(href) AS DOUBLE) AS length, CAST(length({HOST}) AS DOUBLE) AS host_length, CAST(length({HOST}) - length(replace({HOST}, '.', '')) AS DOUBLE) AS num_dots, CAST(length(href) - length(replace(href, '-', '')) AS DOUBLE) AS num_hyphens,
    CAST(length(regexp_replace(href, '[^0-9]', '', 'g')) AS DOUBLE) AS num_digits, CAST(href LIKE 'https:%' AS INT)::DOUBLE AS is_https, CAST(regexp_matches(href, '://[0-9.]+[:/]') AS INT)::DOUBLE AS is_ip_host, CAST(regexp_matches(href, '://[^/]*:[0-9]+') AS INT)::DOUBLE AS has_port,
    CAST(regexp_matches(href, 'bit[.]ly') AS INT)::DOUBLE AS is_shortener, CAST(regexp_matches(href, '[?]url=') AS INT)::DOUBLE AS has_redirect_param, CAST(regexp_matches(href, 'pages[.]dev') AS INT)::DOUBLE AS free_hosting, CAST(regexp_matches(href, '[.]cf/') AS INT)::DOUBLE AS high_risk_tld FROM fx_links""",
    "fx_links",
)
def _(spark, d):
    signs = urls.shape(F.col("href"), "_p_")
    return urls.with_parts(spread(view(spark, d, "fx_links")), "href", "_p_").select("message_id", "pos", *(signs[k].alias(k) for k in ("length", "host_length", "num_dots", "num_hyphens", "num_digits", "is_https", "is_ip_host", "has_port", "is_shortener", "has_redirect_param", "free_hosting", "high_risk_tld")))


@query("url_risk_score")
def _(spark, d):
    x = links.link_features(spread(view(spark, d, "fx_links")))
    return x.select("message_id", "pos", "url", "domain", F.round(urls.click_score(), 6).alias("risk"), metrics.band(urls.click_score()).alias("band"), urls.click_reasons().alias("reasons"))


@query("link_features")
def _(spark, d):
    return links.max_and_mean(links.link_features(spread(view(spark, d, "fx_links"))))


@query("link_rollup")
def _(spark, d):
    return links.message_links(view(spark, d, "fx_messages"), links.link_features(spread(view(spark, d, "fx_links"))))


@query("page_links", r"""SELECT page_id, count(*) AS n_links, count(DISTINCT href) AS n_hrefs FROM (SELECT DISTINCT page_id, href, label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1)) AS label FROM pages UNION ALL
    SELECT page_id, rtrim(unnest(regexp_extract_all(regexp_replace(html, '<[^>]*>', ' ', 'g'), '(?:https?://|www[.])[^\s<>"''`\])]+')), '.,;:!?)]}>''"'), '' FROM pages)) GROUP BY page_id""")
def _(spark, d):
    return links.extract(table(spark, d, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct("href").alias("n_hrefs"))


@query(
    "brand_lookalike",
    f"""SELECT domain, coalesce(arg_min(brand, (dist, brand)), '') AS brand, coalesce(min(dist), 99) AS distance FROM (SELECT DISTINCT regexp_extract(sender, '@([^>]+)', 1) AS domain FROM fx_messages WHERE sender LIKE '%@%') LEFT JOIN
    (SELECT unnest({BRAND_DOMAINS}) AS brand) ON damerau_levenshtein(domain, brand) <= 3, LATERAL (SELECT CASE WHEN brand IS NOT NULL THEN damerau_levenshtein(domain, brand) END AS dist) GROUP BY domain""",
    "fx_messages",
)
def _(spark, d):
    return links.nearest_brands(view(spark, d, "fx_messages").select(T.address_domain(T.address(F.col("sender"))).alias("domain")))


@query("pseudonymise", "SELECT message_id, CASE WHEN a = '' THEN '' ELSE 'px_' || substr(sha256('salt|' || a), 1, 20) END AS sender_px, regexp_extract(a, '@(.+)$', 1) AS sender_domain, substr(sha256('salt|' || subject), 1, 16) AS subject_hash, CAST(length(body) AS INT) AS body_length FROM (SELECT *, lower(CASE WHEN sender LIKE '%<%' THEN regexp_extract(sender, '<([^<>]*)>', 1) ELSE sender END) AS a FROM fx_messages)", "fx_messages")
def _(spark, d):
    a = T.address(F.col("sender"))
    return view(spark, d, "fx_messages").select("message_id", T.pseudonym(a, "salt").alias("sender_px"), T.address_domain(a).alias("sender_domain"), F.substring(F.sha2(F.concat(F.lit("salt|"), "subject"), 256), 1, 16).alias("subject_hash"), F.char_length("body").alias("body_length"))


def _lexicon_sql() -> str:
    parts = ", ".join(f"len(list_filter(w, lambda x: list_contains({sorted(v)}, x))) AS {k}" for k, v in LEXICONS.items())
    return f"SELECT doc_id, {parts} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS w FROM documents)"


@query("lexicon_counts", _lexicon_sql())
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens")).select("doc_id", *(T.lexicon_count("tokens", k).cast("long").alias(k) for k in LEXICONS))


@query("text_entropy", "SELECT doc_id, round(entropy, 4) AS entropy FROM (SELECT doc_id, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT doc_id, c, CAST(count(*) AS DOUBLE) AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS t FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) GROUP BY doc_id, c) GROUP BY doc_id)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(T.text_entropy("text"), 4).alias("entropy"))


def _rounded(exprs: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in exprs.items())


def _header_sql() -> str:
    flag = lambda x: f"CAST({x} AS INT)"
    share = "len(regexp_extract_all(local, '[0-9]')) / CAST(length(local) AS DOUBLE)"
    exprs = {
        "hdr_has_sender": flag("addr <> ''"), "hdr_display_name_present": flag("named <> ''"), "hdr_display_name_length": "length(named)", "hdr_display_has_brand": "len(shown)",
        "hdr_display_brand_domain_mismatch": flag("len(shown) > 0 AND len(list_intersect(shown, owned)) = 0"), "hdr_display_contains_address": "0", "hdr_display_address_mismatch": "0",
        "hdr_replyto_present": flag("reply <> ''"), "hdr_replyto_domain_mismatch": flag("reply <> '' AND reply <> domain"), "hdr_returnpath_present": flag("back <> ''"), "hdr_returnpath_domain_mismatch": flag("back <> '' AND back <> domain"),
        "hdr_sender_freemail": flag(f"list_contains({FREEMAIL}, domain)"), "hdr_sender_disposable": flag(f"list_contains({DISPOSABLE}, domain)"), "hdr_sender_domain_length": "length(domain)",
        "hdr_sender_domain_digits": "len(regexp_extract_all(domain, '[0-9]'))", "hdr_sender_domain_hyphens": "length(domain) - length(replace(domain, '-', ''))",
        "hdr_sender_domain_entropy": "CASE WHEN reg = '' THEN 0.0 ELSE list_aggregate(string_split(string_split(reg, '.')[1], ''), 'entropy') END", "hdr_sender_subdomain_depth": "CASE WHEN domain = '' THEN 0 ELSE len(string_split(domain, '.')) - len(string_split(reg, '.')) END",
        "hdr_sender_high_risk_tld": flag(f"list_contains({RISKY_TLDS}, string_split(domain, '.')[-1])"), "hdr_sender_free_hosting": flag(f"list_contains({FREE_HOSTING}, suffix)"), "hdr_sender_brand_token": "len(owned)",
        "hdr_lookalike_distance": "least(near, 9)", "hdr_is_lookalike": flag("near BETWEEN 1 AND 2"), "hdr_local_length": "length(local)", "hdr_local_digit_ratio": f"CASE WHEN local = '' THEN 0.0 ELSE {share} END",
        "hdr_local_entropy": "CASE WHEN local = '' THEN 0.0 ELSE list_aggregate(string_split(local, ''), 'entropy') END", "hdr_local_is_noreply": flag("regexp_matches(local, 'noreply|no-reply|donotreply')"), "hdr_local_has_plus_tag": flag("contains(local, '+')"),
        "hdr_spf_fail": flag("spf IN ('fail', 'softfail')"), "hdr_dkim_fail": flag("dkim = 'fail'"), "hdr_dmarc_fail": flag("dmarc = 'fail'"), "hdr_auth_score": f"({flag("spf = 'pass'")} + {flag("dkim = 'pass'")} + {flag("dmarc = 'pass'")}) / 3.0",
        "hdr_received_hops": "received_hops", "hdr_recipient_count": "recipients", "hdr_to_empty": flag("recipients = 0"),
    }
    return f""", a AS (SELECT *, lower(CASE WHEN sender LIKE '%<%' THEN regexp_extract(sender, '<([^<>]*)>', 1) ELSE sender END) AS addr, CASE WHEN sender LIKE '%<%' THEN trim(string_split(sender, '<')[1]) ELSE '' END AS named,
      regexp_extract(reply_to, '@(.+)$', 1) AS reply, regexp_extract(return_path, '@(.+)$', 1) AS back FROM fx_mail),
    b AS (SELECT *, regexp_extract(addr, '@(.+)$', 1) AS domain, string_split(addr, '@')[1] AS local FROM a), c AS (SELECT *, CASE WHEN domain LIKE '%.co.uk' THEN 'co.uk' ELSE string_split(domain, '.')[-1] END AS suffix FROM b),
    e AS (SELECT *, CASE WHEN domain = '' THEN '' ELSE array_to_string(string_split(domain, '.')[-(len(string_split(suffix, '.')) + 1):], '.') END AS reg, list_distinct(list_filter(regexp_split_to_array(lower(named), '[^a-z0-9]+'), lambda t: list_contains({BRANDS}, t))) AS shown, list_filter({BRANDS}, lambda t: contains(domain, t)) AS owned FROM c),
    f AS (SELECT *, CASE WHEN reg = '' THEN 99 ELSE list_min(list_transform({BRAND_DOMAINS}, lambda x: CASE WHEN damerau_levenshtein(reg, x) <= 3 THEN damerau_levenshtein(reg, x) ELSE 99 END)) END AS near FROM e)
    SELECT message_id, {_rounded(exprs)} FROM f"""


@query("header_features", _header_sql(), "fx_mail")
def _(spark, d):
    return messages.features(mails(spark, d), "header")


def _re(p: str) -> str:
    """A pattern as SQL text; signs of currency and emoji stand in it as they are."""
    return "'" + p.replace("'", "''") + "'"


def _subject_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(subject, {_re(p)}))"
    flag = lambda p: f"CAST(regexp_matches(subject, {_re(p)}) AS INT)"
    caps = r"len(list_filter(regexp_split_to_array(subject, '\s+'), lambda w: length(w) > 2 AND upper(w) = w AND lower(w) <> w))"
    return "SELECT message_id, " + _rounded({
        "subj_length": "length(subject)", "subj_upper_ratio": f"CASE WHEN {n(r"\p{L}")} = 0 THEN 0.0 ELSE {n(r"\p{Lu}")} / CAST({n(r"\p{L}")} AS DOUBLE) END", "subj_all_caps_words": caps, "subj_exclamations": n("!"), "subj_questions": n(r"\?"), "subj_digit_count": n("[0-9]"),
        "subj_currency_symbols": n(CURRENCY), "subj_non_ascii_ratio": f"{n(r"[^\x00-\x7F]")} / CAST(greatest(length(subject), 1) AS DOUBLE)", "subj_reply_prefix": flag(r"(?i)^\s*re\s*:"), "subj_forward_prefix": flag(r"(?i)^\s*(?:fwd?|fw)\s*:"), "subj_bracket_tag": flag(r"^\s*[\[(]"), "subj_emoji_count": n(EMOJI),
    }) + " FROM fx_messages"


@query("subject_shape", _subject_sql(), "fx_messages")
def _(spark, d):
    names = "subj_length subj_upper_ratio subj_all_caps_words subj_exclamations subj_questions subj_digit_count subj_currency_symbols subj_non_ascii_ratio subj_reply_prefix subj_forward_prefix subj_bracket_tag subj_emoji_count".split()
    return messages.features(view(spark, d, "fx_messages"), "subject").select("message_id", *names)


@query("subject_features")
def _(spark, d):
    return messages.features(view(spark, d, "fx_messages"), "subject")


def _body_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(body, {_re(p)}))"
    flag = lambda p: f"CAST(regexp_matches(body, {_re(p)}) AS INT)"
    over = "CAST(greatest(length(body), 1) AS DOUBLE)"
    return r""", s AS (SELECT *, list_filter(regexp_split_to_array(body, '[.!?]+'), lambda x: regexp_matches(x, '\S')) AS sent FROM fx_messages) SELECT message_id, """ + _rounded({
        "body_length": "length(body)", "body_sentence_count": "len(sent)", "body_avg_sentence_length": r"CASE WHEN len(sent) = 0 THEN 0.0 ELSE list_sum(list_transform(sent, lambda x: len(regexp_extract_all(x, '\S+')))) / CAST(len(sent) AS DOUBLE) END",
        "body_upper_ratio": f"CASE WHEN {n(r"\p{L}")} = 0 THEN 0.0 ELSE {n(r"\p{Lu}")} / CAST({n(r"\p{L}")} AS DOUBLE) END", "body_exclamation_density": f"{n("!")} / {over} * 100", "body_digit_ratio": f"{n("[0-9]")} / {over}", "body_currency_mentions": n(CURRENCY), "body_number_mentions": n(NUMBER),
        "body_non_ascii_ratio": f"{n(r"[^\x00-\x7F]")} / {over}", "body_has_greeting": flag(GREETED), "body_imperative_starts": n(IMPERATIVE), "body_signature_present": flag(SIGNED), "body_unsubscribe_present": flag(UNSUBSCRIBE), "body_phone_numbers": n(PHONE), "body_email_addresses": n(MAIL_ADDRESS), "body_is_empty": r"CAST(NOT regexp_matches(body, '\S') AS INT)",
    }) + " FROM s"


@query("body_shape", _body_sql(), "fx_messages")
def _(spark, d):
    names = "body_length body_sentence_count body_avg_sentence_length body_upper_ratio body_exclamation_density body_digit_ratio body_currency_mentions body_number_mentions body_non_ascii_ratio body_has_greeting body_imperative_starts body_signature_present body_unsubscribe_present body_phone_numbers body_email_addresses body_is_empty".split()
    return messages.features(view(spark, d, "fx_messages"), "body").select("message_id", *names)


@query("body_features")
def _(spark, d):
    return messages.features(view(spark, d, "fx_messages"), "body", "lexicon", "obfuscation")


def _html_sql() -> str:
    of = lambda t: f"len(list_filter(tags, lambda x: x = '{t}'))"
    n = lambda p: f"len(regexp_extract_all(html, {_re(p)}))"
    return r""", h AS (SELECT page_id, html, list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)\b', 1), lambda t: lower(t)) AS tags, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages) SELECT page_id, """.replace(", h AS", "WITH h AS", 1) + _rounded({
        "html_present": r"CAST(regexp_matches(html, '\S') AS INT)", "html_tag_count": "len(tags)", "html_tag_diversity": "len(list_distinct(tags))", "html_text_ratio": r"length(regexp_replace(plain, '^\s+|\s+$', '', 'g')) / CAST(length(html) AS DOUBLE)", "html_image_count": of("img"), "html_image_only": f"CAST({of("img")} >= 1 AND len(regexp_extract_all(plain, '\\S+')) < 15 AS INT)",
        "html_form_count": of("form"), "html_password_input": f"CAST(regexp_matches(html, {_re(PASSWORD_INPUT)}) AS INT)", "html_hidden_style_count": n(HIDDEN_STYLE), "html_script_count": of("script"), "html_iframe_count": of("iframe"), "html_entity_density": f"{n(ENTITY)} / CAST(length(html) AS DOUBLE) * 100", "html_anchor_count": of("a"), "html_external_css": n("(?i)<link[^>]+stylesheet"),
    }) + " FROM h"


@query("html_features", _html_sql())
def _(spark, d):
    x = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("_html"))
    return x.select("page_id", *(F.round(v, 6).alias(k) for k, v in messages.html().items()))


def _attachment_sql() -> str:
    kind = lambda group: f"CAST(list_contains({group}, ext) AS INT)"
    return ", a AS (SELECT *, CASE WHEN att_name LIKE '%.%' THEN string_split(att_name, '.')[-1] ELSE '' END AS ext FROM fx_mail) SELECT message_id, " + _rounded({
        "att_count": "CAST(att_name <> '' AS INT)", "att_total_bytes": "CASE WHEN att_name <> '' THEN att_size ELSE 0 END", "att_max_bytes": "CASE WHEN att_name <> '' THEN att_size ELSE 0 END", "att_executable": kind(EXECUTABLE), "att_macro_enabled": kind(MACRO), "att_archive": kind(ARCHIVE), "att_document": kind(DOCUMENT),
        "att_double_extension": f"CAST(len(string_split(att_name, '.')) >= 3 AND list_contains({[*DOCUMENT, *ARCHIVE]}, string_split(att_name, '.')[-2]) AS INT)", "att_extension_mismatch": "CAST(att_kind <> '' AND ((ext = 'pdf' AND NOT contains(att_kind, 'pdf')) OR (ext = 'zip' AND NOT regexp_matches(att_kind, 'zip|compressed|octet|rar|7z'))) AS INT)",
        "att_name_max_length": "length(att_name)", "att_rtl_override": "0", "att_unknown_type": f"CAST(att_name <> '' AND NOT list_contains({[*EXECUTABLE, *MACRO, *ARCHIVE, *DOCUMENT]}, ext) AS INT)",
    }) + " FROM a"


@query("attachment_features", _attachment_sql(), "fx_mail")
def _(spark, d):
    return messages.features(mails(spark, d), "attachment")


@query("canonical_text")
def _(spark, d):
    x = T.with_canonical(table(spark, d, "documents"), {"clean": F.col("text")}).withColumn("counts", T.char_counts("text"))
    return x.select("doc_id", F.sha2("clean", 256).alias("canonical_sha256"), *(v.cast("double").alias(k) for k, v in T.obfuscation(F.col("text"), F.col("clean"), F.col("counts"), F.col("clean_hints")).items()))


@query("message_features")
def _(spark, d):
    return mail.message_table(mails(spark, d), spread(view(spark, d, "fx_links")))


@query("feature_contract")
def _(spark, d):
    return mail.family_table(spark, mail.contract(mail.message_table(mails(spark, d), spread(view(spark, d, "fx_links")))))


@query("rule_score")
def _(spark, d):
    return rules.rule_score(mail.rule_table(mails(spark, d), spread(view(spark, d, "fx_links"))))


@query("triage")
def _(spark, d):
    return mail.triage(mails(spark, d), spread(view(spark, d, "fx_links")))


WEIGHTS = {"m_rules": 0.7, "m_engineered": 1.9, "m_charngram": 1.1, "m_wordtfidf": 0.8}


@query("fusion_logodds", "SELECT id, s.m AS member, s.c AS contribution FROM (SELECT id, unnest([{'m': 'm_rules', 'c': round(0.7 * m_rules, 6)}, {'m': 'm_engineered', 'c': round(1.9 * m_engineered, 6)}, {'m': 'm_charngram', 'c': round(1.1 * m_charngram, 6)}, {'m': 'm_wordtfidf', 'c': round(0.8 * m_wordtfidf, 6)}, {'m': 'intercept', 'c': -2.0}]) AS s FROM fx_scored)", "fx_scored")
def _(spark, d):
    return rules.fusion_logodds(view(spark, d, "fx_scored"), WEIGHTS, -2.0)


@query("member_disagreement", "SELECT id, round(s, 6) AS std, round(s, 9) > 0.25 AS disagree FROM (SELECT id, sqrt(((m_engineered - m) ** 2 + (m_charngram - m) ** 2 + (m_wordtfidf - m) ** 2) / 3) AS s FROM (SELECT *, (m_engineered + m_charngram + m_wordtfidf) / 3 AS m FROM fx_scored))", "fx_scored")
def _(spark, d):
    return rules.disagreement(view(spark, d, "fx_scored"))


# --- corpus -----------------------------------------------------------------


@query("exact_duplicates", "SELECT sha1(coalesce(text, '')) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return corpus.exact_duplicates(table(spark, d, "documents"))


@query("label_noise", "SELECT sha1(text) AS digest, count(*) AS n, min(d.doc_id) AS first_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1 HAVING min(quality) <> max(quality)")
def _(spark, d):
    return corpus.label_noise(table(spark, d, "documents"), table(spark, d, "labels"), "quality")


@query("near_duplicates")
def _(spark, d):
    return corpus.near_duplicates(table(spark, d, "documents"))


PART = "CASE WHEN CAST('0x' || substr(md5('split|' || group_key), 1, 8) AS BIGINT) / 4294967296.0 < 0.25 THEN 'test' ELSE 'train' END"


@query("grouped_split", f"SELECT message_id, group_key, {PART} AS part FROM fx_messages", "fx_messages")
def _(spark, d):
    return corpus.grouped_split(view(spark, d, "fx_messages"), "group_key").select("message_id", "group_key", "part")


@query("temporal_split", ", c AS (SELECT quantile_disc(ts, 0.75) AS cut FROM fx_mail_log), g AS (SELECT recipient, sender, max(CAST(ts <= cut AS INT)) AS hi FROM fx_mail_log, c GROUP BY 1, 2) SELECT msg_id, CASE WHEN ts <= cut THEN 'train' WHEN hi = 1 THEN 'dropped' ELSE 'test' END AS part FROM (SELECT *, sender || ':' || recipient AS k FROM fx_mail_log) m JOIN (SELECT sender || ':' || recipient AS k, hi FROM g) g2 ON g2.k = m.k, c", "fx_mail_log")
def _(spark, d):
    log = view(spark, d, "fx_mail_log").withColumn("k", F.concat_ws(":", "sender", "recipient"))
    return corpus.temporal_split(log, "ts", "k").select("msg_id", "part")


LEAKAGE = f"""m AS (SELECT sha1(coalesce(body, '')) AS f, group_key, quality AS label, {PART} AS part FROM fx_messages JOIN labels ON doc_id = message_id)
    SELECT *, shared_texts = 0 AND shared_groups = 0 AND balance_drift <= 0.08 AS passed FROM (SELECT (SELECT count(*) FROM (SELECT f FROM m GROUP BY f HAVING count(DISTINCT part) > 1)) AS shared_texts, (SELECT count(*) FROM (SELECT group_key FROM m GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS shared_groups,
    count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test, round(abs(avg(label) FILTER (part = 'train') - avg(label) FILTER (part = 'test')), 6) AS balance_drift FROM m)"""


@query("leakage_audit", f", {LEAKAGE}", "fx_messages")
def leakage_audit(spark, d):
    m = view(spark, d, "fx_messages").join(table(spark, d, "labels"), F.col("message_id") == F.col("doc_id"))
    return corpus.leakage_audit(corpus.grouped_split(m, "group_key"), "body", "group_key", "quality")


@query(
    "feature_auc",
    """SELECT feature, round(auc, 6) AS auc, greatest(auc, 1 - auc) >= 0.985 AS suspicious FROM (SELECT feature, (sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc FROM (SELECT feature, y, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2.0 AS r, sum(y) OVER (PARTITION BY feature) AS n1, sum(1 - y) OVER (PARTITION BY feature) AS n0 FROM
    (SELECT y, s.f AS feature, s.v AS v FROM (SELECT y, unnest([{'f': 'm_rules', 'v': m_rules}, {'f': 'm_engineered', 'v': m_engineered}, {'f': 'm_charngram', 'v': m_charngram}, {'f': 'm_wordtfidf', 'v': m_wordtfidf}, {'f': 'score', 'v': score}]) AS s FROM fx_scored))) GROUP BY feature, n1, n0)""",
    "fx_scored",
)
def _(spark, d):
    return corpus.feature_auc(view(spark, d, "fx_scored"), ("m_rules", "m_engineered", "m_charngram", "m_wordtfidf", "score"))


@query("corpus_profile", "SELECT source, toxic, count(*) AS n, count(DISTINCT lang) AS n_langs, round(avg(n_chars), 4) AS mean_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY source, toxic")
def _(spark, d):
    return corpus.profile(table(spark, d, "documents"), table(spark, d, "labels"))


@query(
    "confound_audit",
    "WITH x AS (SELECT toxic, lang, n_chars FROM documents d JOIN labels l ON l.doc_id = d.doc_id), t AS (SELECT toxic, unnest(['lang=' || lang, 'long=' || CAST(n_chars > 2000 AS VARCHAR)]) AS trait FROM x) SELECT trait, count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic = 0) AS neg, round(abs(count(*) FILTER (toxic = 1) / (SELECT count(*) FILTER (toxic = 1) FROM x) - count(*) FILTER (toxic = 0) / (SELECT count(*) FILTER (toxic = 0) FROM x)), 6) AS gap FROM t GROUP BY trait",
)
def _(spark, d):
    return corpus.confounds(table(spark, d, "documents"), table(spark, d, "labels"))


_PIECES = ", ".join(f"sum(CAST(CAST('0x' || substr(d, {1 + 12 * i}, 12) AS BIGINT) AS DECIMAL(38, 0))) AS p{i}" for i in range(5))


@query("dataset_version", f"SELECT substr(sha256(concat_ws('|', p0, p1, p2, p3, p4, n)), 1, 12) AS version, n, n_positive FROM (SELECT {_PIECES}, count(*) AS n, count(*) FILTER (toxic = 1) AS n_positive FROM (SELECT toxic, sha256(coalesce(text, '') || '|' || CAST(toxic AS VARCHAR)) AS d FROM documents JOIN labels USING (doc_id)))")
def _(spark, d):
    return corpus.dataset_version(table(spark, d, "documents"), table(spark, d, "labels"))


@query(
    "tfidf_weights",
    """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS term FROM documents), tf AS (SELECT id, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2), x AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term))
    SELECT id, term, weight, place FROM (SELECT id, term, weight, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS place FROM (SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM x)) WHERE place <= 5""",
)
def _(spark, d):
    return corpus.tfidf(table(spark, d, "documents"), top=5)


# --- models, contracts, state -----------------------------------------------


CHECKS = mail_source.CONTRACT | {"subject_too_long": "length(subject) > 59", "bad_spf": "spf not in ('pass', 'none')", "empty_sender": "sender = ''"}


@query(
    "contract_violations",
    "SELECT breach, count(*) AS n FROM (SELECT unnest([CASE WHEN length(subject) > 59 THEN 'subject_too_long' END, CASE WHEN spf NOT IN ('pass', 'none') THEN 'bad_spf' END, CASE WHEN sender = '' THEN 'empty_sender' END]) AS breach FROM fx_messages) WHERE breach IS NOT NULL GROUP BY breach",
    "fx_messages",
)
def _(spark, d):
    _, rejects = mail_source.check_contract(view(spark, d, "fx_messages"), CHECKS)
    return rejects.select(F.explode("breaches").alias("breach")).groupBy("breach").agg(F.count(F.lit(1)).alias("n"))


@query("case_lifecycle")
def _(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.element_at(F.array(*(F.lit(a) for a in state.STEPS)), (F.col("event_id") % 5 + 1).cast("int")).alias("action"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return state.fold_cases(events)


@query("rate_limits")
def _(spark, d):
    asked = table(spark, d, "events").select(F.col("user_id").alias("key"), F.lit(1.0).alias("cost"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return state.token_buckets(asked, per_minute=0.01, capacity=3.0)


@query("rule_catalogue")
def _(spark, d):
    return rules.rule_catalogue(mail.rule_table(mails(spark, d), spread(view(spark, d, "fx_links"))))


# --- reports ----------------------------------------------------------------

GRADE = """count(*) AS n, round(coalesce(count(*) FILTER (y = 1 AND band = 'ALLOW') / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS silent_delivery, round(coalesce(count(*) FILTER (y = 0 AND band = 'BLOCK') / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS false_block,
    round(coalesce(count(*) FILTER (y = 1 AND band <> 'ALLOW') / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS caught, round(avg(CAST((y = 1 AND band <> 'ALLOW') OR (y = 0 AND band <> 'BLOCK') AS INT)), 6) AS acceptable, round(avg(CAST(band = 'REVIEW' AS INT)), 6) AS review_load,
    round(avg(score) FILTER (y = 1), 6) AS mean_phish, round(avg(score) FILTER (y = 0), 6) AS mean_ham, round(avg(score) FILTER (y = 1) - avg(score) FILTER (y = 0), 6) AS separation"""


@query("benchmark_grade", f"SELECT {GRADE} FROM ({BANDED})", "fx_scored")
def _(spark, d):
    return reports.grade(view(spark, d, "fx_scored"))


@query("grade_by_slice", f"SELECT slice_lang, {GRADE} FROM ({BANDED}) GROUP BY slice_lang", "fx_scored")
def _(spark, d):
    return reports.grade(view(spark, d, "fx_scored"), ("slice_lang",))


@query(
    "per_case",
    f"""SELECT slice_lang, y, count(*) AS n, round(avg(score), 6) AS mean_score, CASE WHEN y = 1 THEN min(score) ELSE max(score) END AS worst_score, round(avg(CAST((y = 1 AND band <> 'ALLOW') OR (y = 0 AND band <> 'BLOCK') AS INT)), 6) AS pass_rate,
    count(*) FILTER (band = 'ALLOW') AS allow, count(*) FILTER (band = 'REVIEW') AS review, count(*) FILTER (band = 'BLOCK') AS block FROM ({BANDED}) GROUP BY slice_lang, y""",
    "fx_scored",
)
def _(spark, d):
    return reports.per_case(view(spark, d, "fx_scored"), "slice_lang")


ATTACK_FAMILY = "CASE id % 8 " + " ".join(f"WHEN {i} THEN '{f[0]}'" for i, f in enumerate(reports.FAMILIES)) + " END"
ATTACKS = f"SELECT {ATTACK_FAMILY} AS family, score AS before, least(score, m_charngram) AS after, CAST(id % 50 AS BIGINT) AS queries FROM fx_scored WHERE y = 1"
ATTACK_BANDS = f"SELECT *, before - after AS d, CASE WHEN before >= 0.8 THEN 2 WHEN before >= 0.4 THEN 1 ELSE 0 END AS b0, CASE WHEN after >= 0.8 THEN 2 WHEN after >= 0.4 THEN 1 ELSE 0 END AS b1 FROM ({ATTACKS})"


def _attacks(spark, d):
    return view(spark, d, "fx_scored").filter("y = 1").selectExpr(f"{ATTACK_FAMILY} AS family", "score AS before", "least(score, m_charngram) AS after", "CAST(id % 50 AS BIGINT) AS queries")


@query("attack_summary", f"SELECT family, count(*) AS n, count(*) FILTER (b0 = 2 AND b1 < 2) AS escaped_block, count(*) FILTER (b0 > 0 AND b1 = 0) AS silent, round(avg(d), 6) AS mean_drop, round(quantile_cont(d, 0.5), 6) AS median_drop, round(max(d), 6) AS max_drop, CAST(sum(queries) AS BIGINT) AS queries FROM ({ATTACK_BANDS}) GROUP BY family", "fx_scored")
def _(spark, d):
    return reports.attack_summary(_attacks(spark, d), ("family",))


@query("attack_budgets", f"SELECT CAST(b AS INT) AS budget, round((SELECT count(*) FROM ({ATTACK_BANDS}) WHERE b0 > 0 AND b1 = 0 AND queries <= b) / (SELECT count(*) FROM ({ATTACKS})), 6) AS silent_rate FROM (SELECT unnest([5, 10, 20, 40, 60]) AS b)", "fx_scored")
def _(spark, d):
    return reports.budget_sweep(_attacks(spark, d), (5, 10, 20, 40, 60))


CONTROLS = ("D-NORM", "D-URL", "D-ENSEMBLE", "D-ABSTAIN", "D-VELOCITY")


def _register_sql() -> str:
    known = ", ".join(f"('{f}', '{name}', {controls}, '{cost}', '{impact}')" for f, name, controls, cost, impact in reports.FAMILIES)
    return f"""SELECT family, name, round(rate, 5) AS success_rate, round(d, 5) AS mean_drop, round(q, 2) AS median_queries, likelihood, impact,
        CASE WHEN impact = 'High' THEN CASE likelihood WHEN 'High' THEN 'High' WHEN 'Medium' THEN 'Medium' ELSE 'Low' END ELSE CASE likelihood WHEN 'Very low' THEN 'Very low' WHEN 'Low' THEN 'Low' ELSE 'Medium' END END AS risk,
        cost AS attacker_cost, array_to_string(list_filter(controls, lambda c: c IN {CONTROLS}), ',') AS controls_applied, array_to_string(list_filter(controls, lambda c: c NOT IN {CONTROLS}), ',') AS controls_missing, len(list_filter(controls, lambda c: c IN {CONTROLS})) = 0 AS uncontrolled
        FROM (SELECT *, CASE WHEN rate >= 0.4 THEN 'High' WHEN rate >= 0.15 THEN 'Medium' WHEN rate >= 0.05 THEN 'Low' ELSE 'Very low' END AS likelihood FROM
        (SELECT k.*, coalesce(rate, 0.0) AS rate, coalesce(d, 0.0) AS d, coalesce(q, 0.0) AS q FROM (VALUES {known}) AS k(family, name, controls, cost, impact)
        LEFT JOIN (SELECT family, avg(CAST(b1 < 2 AS INT)) AS rate, avg(d) AS d, quantile_cont(queries, 0.5) FILTER (b1 < 2) AS q FROM ({ATTACK_BANDS}) GROUP BY family) USING (family)))"""


@query("risk_register", _register_sql(), "fx_scored")
def _(spark, d):
    return reports.risk_register(_attacks(spark, d), CONTROLS)


def _gates_sql() -> str:
    f1 = lambda score: f"(SELECT macro_f1 FROM ({_prf_sql(f'{CONFUSION} FROM (SELECT y, {score} AS score FROM fx_scored)')}))"
    escaped = lambda score: f"(SELECT avg(CAST({score} < 0.8 AS INT)) FROM fx_scored WHERE y = 1)"
    hurt = "CASE WHEN y = 1 THEN least(score, m_charngram) ELSE score END"
    values = {
        "clean.macro_f1": f1("score"),
        "clean.pr_auc": f"(SELECT round(sum(pos * pos_above / CAST(pos_above + neg_above AS DOUBLE)) / sum(pos), 6) FROM ({RUNNING}))",
        "clean.false_positive_rate": "(SELECT round(avg(CAST(score >= 0.5 AS INT)), 5) FROM fx_scored WHERE y = 0)",
        "calibration.ece": f"(SELECT round(sum(abs(c - a) * n) / sum(n), 6) FROM ({BINS15}))",
        "robustness.macro_f1_drop": f"{f1('score')} - {f1(hurt)}",
        "robustness.attack_success_rate": escaped("least(score, m_charngram)"),
        "latency.p95_ms": "(SELECT quantile_cont(latency_ms, 0.95) FROM fx_decisions)",
        "deltas.vs_rule_baseline_macro_f1": f"{f1('score')} - {f1('m_rules')}",
        "deltas.asr_advantage_vs_text_baseline": f"{escaped('least(m_wordtfidf, m_charngram)')} - {escaped('least(score, m_charngram)')}",
        "leakage.passed_numeric": "(SELECT CAST(passed AS DOUBLE) FROM leak)",
    }
    rows = " UNION ALL ".join(f"SELECT '{g}' AS gate, '{m}' AS metric, '{kind}' AS kind, CAST({bound} AS DOUBLE) AS bound, {str(blocking).lower()} AS blocking, CAST({values[m]} AS DOUBLE) AS v" for g, m, kind, bound, blocking in reports.GATES)
    audit, found = LEAKAGE.split("\n", 1)
    return f", {audit}, leak AS ({found.strip()}) SELECT gate, metric, round(v, 5) AS observed, kind, bound, blocking, coalesce(CASE WHEN kind = 'min' THEN v >= bound ELSE v <= bound END, NOT blocking) AS passed FROM ({rows})"


def _gate_values(spark, d):
    """(metric, value) of all gates, each a row of its own."""
    scored = view(spark, d, "fx_scored")
    f1 = lambda score: metrics.prf(metrics.confusion(scored.select("y", score.alias("score")))).select(F.col("macro_f1").alias("v"))
    escaped = lambda score: scored.filter("y = 1").agg(F.avg((score < metrics.BLOCK).cast("double")).alias("v"))
    less = lambda a, b: a.join(b.withColumnRenamed("v", "w"), F.lit(True)).select((F.col("v") - F.col("w")).alias("v"))
    score, after = F.col("score"), F.least("score", "m_charngram")
    values = {
        "clean.macro_f1": f1(score),
        "clean.pr_auc": metrics.pr_auc(scored),
        "clean.false_positive_rate": metrics.prf(metrics.confusion(scored)).select("fpr"),
        "calibration.ece": metrics.calibration_errors(scored).select("ece"),
        "robustness.macro_f1_drop": less(f1(score), f1(F.when(F.col("y") == 1, after).otherwise(score))),
        "robustness.attack_success_rate": escaped(after),
        "latency.p95_ms": quantiles(view(spark, d, "fx_decisions"), "latency_ms", (0.95,)).select(F.col("q")[0]),
        "deltas.vs_rule_baseline_macro_f1": less(f1(score), f1(F.col("m_rules"))),
        "deltas.asr_advantage_vs_text_baseline": less(escaped(F.least("m_wordtfidf", "m_charngram")), escaped(after)),
        "leakage.passed_numeric": leakage_audit(spark, d).select(F.col("passed").cast("double")),
    }
    rows = [x.toDF("value").select(F.lit(m).alias("metric"), F.col("value").cast("double").alias("value")) for m, x in values.items()]
    return reduce(DataFrame.unionByName, rows)


@query("acceptance_gates", _gates_sql(), "fx_scored", "fx_decisions", "fx_messages")
def _(spark, d):
    return reports.gates(_gate_values(spark, d))


@query("drift_null_thresholds")
def _(spark, d):
    return drift_null.null_thresholds(drift.monitored(view(spark, d, "fx_decisions"), "sender_domain"), "sender_domain", drift.QUANTITIES, window=400)


@query("rule_evidence")
def _(spark, d):
    return reports.evidence(rules.rule_score(mail.rule_table(mails(spark, d), spread(view(spark, d, "fx_links")))))


@query("top_features")
def _(spark, d):
    return reports.top_features(messages.features(view(spark, d, "fx_messages"), "subject"), "message_id")


COSTS5 = "[25, 50, 100, 200, 400, 800]"


@query("cost_sensitivity", f"{AT} SELECT miss, review, block, cost FROM (SELECT *, row_number() OVER (PARTITION BY miss ORDER BY cost, review, block) AS r FROM {_cost_sql(COSTS5)}) WHERE r = 1", "fx_scored")
def _(spark, d):
    return policy.policy_best(view(spark, d, "fx_scored"), (25.0, 50.0, 100.0, 200.0, 400.0, 800.0))


@query("error_spikes", ", w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM fx_mail_log GROUP BY 1) SELECT window_start, n, errors FROM w WHERE errors > 0.3 * n", "fx_mail_log")
def _(spark, d):
    x = windows.timed(view(spark, d, "fx_mail_log"), "ts").groupBy(F.window("t", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return x.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", "errors").filter("errors > 0.3 * n")


@query(
    "sla_breaches",
    f"SELECT priority, origin, count(*) AS n, max(late) AS longest_seconds FROM (SELECT *, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(epoch(created_ts)) AS BIGINT) - {SLA} AS late FROM fx_cases WHERE state <> 'resolved') WHERE late > 0 GROUP BY priority, origin",
    "fx_cases",
)
def _(spark, d):
    return review.sla_breaches(view(spark, d, "fx_cases"), NOW)


@query("policy_regret", f"{AT}, w AS (SELECT review, block, round(max(cost - best), 6) AS worst FROM (SELECT *, min(cost) OVER (PARTITION BY miss) AS best FROM {_cost_sql('[50, 100, 200, 800]')}) GROUP BY review, block) SELECT max(worst) FILTER (review = 0.4 AND block = 0.8) AS regret, min(worst) AS least_regret FROM w", "fx_scored")
def _(spark, d):
    return policy.policy_regret(view(spark, d, "fx_scored"), 0.4, 0.8)


from . import detector, queue, rewrites, scoring, splits  # noqa: E402, F401  they register their queries
