"""Queries of casework, corpus verdicts and robustness over given results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import casework, metrics, workflow
from mailsift.sources.tables import table, view

from .catalogue import SQL, CONFUSION, CUTOFF, _prf_sql, query

SECONDS = "CASE WHEN event_type = 'signup' AND band = 'ALLOW' THEN 3600 WHEN band = 'REVIEW' THEN 14400 ELSE 86400 END"


@query(
    "open_cases",
    f"""SELECT decision_id AS case_id, decision_id, CASE WHEN event_type = 'signup' THEN 'user_report' ELSE 'model_review' END AS origin, CASE WHEN event_type = 'signup' AND band = 'ALLOW' THEN 1 WHEN band = 'REVIEW' THEN 2 ELSE 3 END AS priority,
    'open' AS state, created_ts, CAST(floor(epoch(created_ts)) AS BIGINT) + {SECONDS} AS sla_due_epoch FROM fx_decisions WHERE band = 'REVIEW' OR event_type = 'signup'""",
    "fx_decisions",
)
def _(spark, d):
    return casework.open_cases(view(spark, d, "fx_decisions"), F.col("event_type") == "signup")


@query(
    "case_detail",
    """, e AS (SELECT decision_id, count(*) AS n, string_agg(CAST(feedback_id AS VARCHAR) || ':' || analyst_label, ',' ORDER BY feedback_id) AS h FROM fx_feedback GROUP BY decision_id)
    SELECT c.case_id, state, priority, score, band, sender_domain, coalesce(n, 0) AS n_events, coalesce(h, '') AS history FROM fx_cases c JOIN (SELECT decision_id, score, band, sender_domain FROM fx_decisions) d ON d.decision_id = c.decision_id LEFT JOIN e ON e.decision_id = c.decision_id""",
    "fx_cases",
    "fx_feedback",
)
def _(spark, d):
    return casework.case_detail(view(spark, d, "fx_cases"), view(spark, d, "fx_decisions"), view(spark, d, "fx_feedback"))


ACTOR = "SELECT case_id, state, CASE case_id % 4 WHEN 0 THEN 'admin' WHEN 1 THEN 'viewer' ELSE 'analyst' END AS role, case_id % 3 = 0 AS owns, CASE WHEN case_id % 2 = 0 THEN 'seen' ELSE '' END AS note, CASE case_id % 5 WHEN 0 THEN 'released' WHEN 1 THEN '' ELSE 'confirmed_phishing' END AS resolution, CAST((case_id * 7919) % 1000 AS DOUBLE) / 1000 AS score FROM fx_cases"
WHY = """CASE WHEN role NOT IN ('analyst', 'admin') THEN 'not_permitted' ELSE CASE action
  WHEN 'comment' THEN CASE WHEN note = '' THEN 'note_required' END WHEN 'claim' THEN CASE WHEN state <> 'open' THEN 'illegal_state' END
  WHEN 'unclaim' THEN CASE WHEN state <> 'in_review' THEN 'illegal_state' WHEN NOT (owns OR role = 'admin') THEN 'not_assignee' END
  WHEN 'escalate' THEN CASE WHEN state <> 'in_review' THEN 'illegal_state' WHEN NOT (owns OR role = 'admin') THEN 'not_assignee' WHEN note = '' THEN 'note_required' END
  WHEN 'resolve' THEN CASE WHEN resolution NOT IN ('confirmed_phishing', 'released') THEN 'resolution_required' WHEN state = 'escalated' AND role <> 'admin' THEN 'needs_admin' WHEN state = 'in_review' AND NOT (owns OR role = 'admin') THEN 'not_assignee'
    WHEN state NOT IN ('escalated', 'in_review') THEN 'illegal_state' WHEN resolution = 'released' AND note = '' THEN 'note_required' WHEN resolution = 'released' AND score >= 0.8 AND role <> 'admin' THEN 'needs_admin' END
  WHEN 'reopen' THEN CASE WHEN state <> 'resolved' THEN 'illegal_state' WHEN role <> 'admin' THEN 'needs_admin' WHEN note = '' THEN 'note_required' END ELSE 'unknown_action' END END"""
ASKED = f"(SELECT *, {WHY} AS why FROM (SELECT *, unnest({list(casework.ACTIONS)}) AS action FROM ({ACTOR})))"


@query("allowed_actions", f"SELECT case_id, coalesce(string_agg(action, ',' ORDER BY action) FILTER (why IS NULL), '') AS actions FROM {ASKED} GROUP BY case_id", "fx_cases")
def _(spark, d):
    return casework.allowed_actions(spark.sql(ACTOR.replace("FROM fx_cases", "FROM {fx_cases}"), fx_cases=view(spark, d, "fx_cases")))


@query("action_refusals", f"SELECT action, coalesce(why, 'allowed') AS outcome, count(*) AS n FROM {ASKED} GROUP BY 1, 2", "fx_cases")
def _(spark, d):
    x = spark.sql(ACTOR.replace("FROM fx_cases", "FROM {fx_cases}"), fx_cases=view(spark, d, "fx_cases"))
    x = x.select("*", F.explode(F.array(*map(F.lit, casework.ACTIONS))).alias("action"))
    return x.groupBy("action", F.coalesce(workflow.refusal(F.col("action")), F.lit("allowed")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


REQUESTS = "SELECT msg_id AS request_id, msg_id - msg_id % 3 AS case_id, CASE msg_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'in_review' WHEN 2 THEN 'escalated' ELSE 'resolved' END AS expected, CASE msg_id % 4 WHEN 0 THEN 'in_review' WHEN 1 THEN 'escalated' WHEN 2 THEN 'resolved' ELSE 'open' END AS next FROM fx_mail_log"


@query(
    "conditional_updates",
    f""", q AS ({REQUESTS}), o AS (SELECT q.*, c.state AS first_, row_number() OVER (PARTITION BY q.case_id ORDER BY request_id) AS k FROM q JOIN fx_cases c ON c.case_id = q.case_id),
    f AS (SELECT request_id, case_id, k, first_ AS state, expected = first_ AS applied, CASE WHEN expected = first_ THEN next ELSE first_ END AS new_state FROM o WHERE k = 1
      UNION ALL SELECT o.request_id, o.case_id, o.k, f.new_state, o.expected = f.new_state, CASE WHEN o.expected = f.new_state THEN o.next ELSE f.new_state END FROM f JOIN o ON o.case_id = f.case_id AND o.k = f.k + 1)
    SELECT request_id, case_id, state, applied, new_state, CASE WHEN NOT applied THEN 'stale' END AS refused FROM f""",
    "fx_cases",
    "fx_mail_log",
)
def _(spark, d):
    asked = spark.sql(REQUESTS.replace("FROM fx_mail_log", "FROM {log}"), log=view(spark, d, "fx_mail_log"))
    return workflow.updates(view(spark, d, "fx_cases"), asked)


SQL["conditional_updates"] = SQL["conditional_updates"].replace("WITH ", "WITH RECURSIVE ", 1)


@query("monitoring_rows", f"SELECT decision_id, created_ts, score, band, body_length, recipient_count, attachment_count, behavioral_available FROM fx_decisions WHERE created_ts >= TIMESTAMP '{CUTOFF}' ORDER BY created_ts DESC, decision_id DESC LIMIT 20000", "fx_decisions")
def _(spark, d):
    return casework.monitoring_rows(view(spark, d, "fx_decisions"), F.lit(CUTOFF).cast("timestamp_ntz"))


@query(
    "retention_purge",
    f""", g AS (SELECT decision_id FROM fx_decisions WHERE created_ts < TIMESTAMP '{CUTOFF}' AND decision_id NOT IN (SELECT decision_id FROM fx_cases WHERE state <> 'resolved'))
    SELECT 'decisions' AS kind, count(*) AS n FROM g UNION ALL SELECT 'cases', count(*) FROM fx_cases WHERE decision_id IN (SELECT decision_id FROM g) UNION ALL SELECT 'feedback', count(*) FROM fx_feedback WHERE decision_id IN (SELECT decision_id FROM g)""",
    "fx_cases",
    "fx_feedback",
)
def _(spark, d):
    return casework.purge_counts(view(spark, d, "fx_decisions"), view(spark, d, "fx_cases"), view(spark, d, "fx_feedback"), F.lit(CUTOFF).cast("timestamp_ntz"))


@query("resolved_page", "SELECT case_id, resolution, origin, priority FROM fx_cases WHERE state = 'resolved' ORDER BY created_ts DESC, case_id DESC LIMIT 50", "fx_cases")
def _(spark, d):
    return casework.resolved_page(view(spark, d, "fx_cases"))


@query("audit_row_count", "SELECT count(*) AS n FROM events")
def _(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("n"))


@query(
    "corpus_verdict",
    """WITH b AS (SELECT sha256(coalesce(text, '')) AS h, count(*) AS n, count(DISTINCT toxic) AS k, sum(toxic) AS pos FROM documents d JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1),
    x AS (SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positive, CAST(sum(CASE WHEN k > 1 THEN n ELSE 0 END) AS BIGINT) AS noisy, CAST(sum(n - 1) AS BIGINT) AS copies FROM b),
    f AS (SELECT *, concat_ws(',', CASE WHEN positive < 50 THEN 'few_positive' END, CASE WHEN n - positive < 50 THEN 'few_negative' END, CASE WHEN noisy > 0.01 * n THEN 'label_noise' END, CASE WHEN copies > 0.08 * n THEN 'copies' END) AS failures FROM x)
    SELECT n, positive, noisy, copies, failures, CASE WHEN failures = '' THEN 'READY' ELSE 'NOT READY' END AS verdict FROM f""",
)
def _(spark, d):
    return casework.corpus_verdict(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("text", F.col("toxic").alias("label")))


AFTER = "greatest(score - CAST(id % 4 AS DOUBLE) / 10, 0.0)"


def _band(s: str) -> str:
    return f"CASE WHEN {s} >= 0.8 THEN 'BLOCK' WHEN {s} >= 0.4 THEN 'REVIEW' ELSE 'ALLOW' END"


@query("robustness_bands", f"SELECT {_band('score')} AS before, {_band(AFTER)} AS after, count(*) AS n FROM fx_scored WHERE y = 1 GROUP BY 1, 2", "fx_scored")
def _(spark, d):
    return casework.robustness_bands(view(spark, d, "fx_scored"), F.expr(AFTER))


@query("adversarial_metrics", _prf_sql(f"{CONFUSION} FROM (SELECT y, CASE WHEN y = 1 THEN {AFTER} ELSE score END AS score FROM fx_scored)"), "fx_scored")
def _(spark, d):
    return metrics.prf(metrics.confusion(casework.adversarial_rows(view(spark, d, "fx_scored"), F.expr(AFTER))))


FAMILIES = "CASE id % 3 WHEN 0 THEN {}('lexical', 'url', 'url') WHEN 1 THEN {}('unicode') ELSE {}('header', 'lexical') END"


@query("family_successes", "SELECT family, count(*) AS n FROM (SELECT id, unnest(list_distinct(" + FAMILIES.replace("{}", "list_value") + f")) AS family FROM fx_scored WHERE y = 1 AND {AFTER} < 0.4) GROUP BY family", "fx_scored")
def _(spark, d):
    x = view(spark, d, "fx_scored").filter("y = 1").selectExpr("id", FAMILIES.replace("{}", "array") + " AS families", f"{AFTER} < 0.4 AS evaded")
    return casework.family_successes(x)


