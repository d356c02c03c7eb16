"""Queries of the decision path and of evaluation, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import decide, evaluation, policy_grid
from mailsift.sources.tables import view

from .catalogue import BANDED, CONFUSION, _prf_sql, query

MODEL = decide.Fusion({"m_rules": 0.7, "m_engineered": 1.9, "m_charngram": 1.1, "m_wordtfidf": 0.8}, -2.0, slope=1.5, offset=-0.25)
WITH_CONTEXT = "SELECT id, y, slice_lang, m_rules, m_engineered, m_charngram, m_wordtfidf, id % 4 <> 0 AS available, id % 50 AS burst_count_1h, id % 5 = 0 AS first_seen, id % 3 AS domain_report_count, id % 4 AS display_name_alias_count FROM fx_scored"
LOGIT = "(-2.0::DOUBLE + 1.1 * m_charngram + 1.9 * m_engineered + 0.7 * m_rules + 0.8 * m_wordtfidf)"
LIST = "[m_rules, m_engineered, m_charngram, m_wordtfidf]"


def _decided(calibration: bool = True, velocity: bool = True, abstention: bool = True) -> str:
    score = f"1 / (1 + exp(-(1.5 * {LOGIT} - 0.25)))" if calibration else f"1 / (1 + exp(-{LOGIT}))"
    guard = "CASE WHEN available AND bump > 0.005 AND greatest(s0, least(s0 + bump * (1 - s0), 0.99)) - s0 >= 0.0005 THEN greatest(s0, least(s0 + bump * (1 - s0), 0.99)) ELSE s0 END" if velocity else "s0"
    moved = f"round(spread, 9) >= 0.45 AND list_min({LIST}) < 0.4 AND (len(list_filter({LIST}, lambda x: x >= 0.4)) >= 2 OR list_max({LIST}) >= 0.8) AND base_band <> 'REVIEW'" if abstention else "false"
    return f"""(SELECT *, CASE WHEN abstained THEN 'REVIEW' ELSE base_band END AS band FROM (SELECT *, {moved} AS abstained FROM (SELECT *, CASE WHEN score >= 0.8 THEN 'BLOCK' WHEN score >= 0.4 THEN 'REVIEW' ELSE 'ALLOW' END AS base_band FROM
      (SELECT *, {guard} AS score FROM (SELECT *, 1 / (1 + exp(-{LOGIT})) AS raw, {score} AS s0, list_max({LIST}) - list_min({LIST}) AS spread,
      least(0.10 * least(ln(1 + burst_count_1h) / 4, 1.0) * CAST(first_seen AS INT) + 0.04 * CAST(domain_report_count > 0 AS INT) + 0.03 * CAST(display_name_alias_count > 1 AS INT), 0.15) AS bump FROM ({WITH_CONTEXT}))))))"""


def _scored(spark, d):
    return view(spark, d, "fx_scored").selectExpr("id", "y", "slice_lang", "m_rules", "m_engineered", "m_charngram", "m_wordtfidf", "id % 4 <> 0 AS available", "id % 50 AS burst_count_1h", "id % 5 = 0 AS first_seen", "id % 3 AS domain_report_count", "id % 4 AS display_name_alias_count")


@query("decisions", f"SELECT id, round(raw, 6) AS raw, round(score, 6) AS score, round(spread, 6) AS spread, base_band, abstained, band FROM {_decided()}", "fx_scored")
def _(spark, d):
    x = decide.decide(_scored(spark, d), MODEL)
    return x.select("id", F.round("raw", 6).alias("raw"), F.round("score", 6).alias("score"), F.round("spread", 6).alias("spread"), "base_band", "abstained", "band")


@query("verdict_records", f"SELECT id, CASE WHEN score >= 0.8 THEN 'phishing' ELSE 'legitimate' END AS label, band, band = 'REVIEW' AS abstained, round(score, 6) AS score, round(raw, 6) AS raw_fusion, round(spread, 6) AS member_spread, abstained AS moved FROM {_decided()}", "fx_scored")
def _(spark, d):
    x = decide.verdicts(decide.decide(_scored(spark, d), MODEL))
    return x.select("id", "label", "band", "abstained", "score", "signals.raw_fusion", "signals.member_spread", "signals.moved")


@query(
    "triage_summary",
    f"""SELECT count(*) AS n, count(*) FILTER (band = 'ALLOW') AS allow, count(*) FILTER (band = 'REVIEW') AS review, count(*) FILTER (band = 'BLOCK') AS block, round(count(*) FILTER (band = 'ALLOW') / count(*), 6) AS allow_share,
    round(count(*) FILTER (band = 'REVIEW') / count(*), 6) AS review_share, round(count(*) FILTER (band = 'BLOCK') / count(*), 6) AS block_share, count(*) FILTER (abstained) AS moved, round(count(*) FILTER (NOT available) / count(*), 6) AS blind_share FROM {_decided()}""",
    "fx_scored",
)
def _(spark, d):
    return decide.summary(decide.decide(_scored(spark, d), MODEL))


def _ablation_sql() -> str:
    arms = {"all": {}, "none": dict(calibration=False, velocity=False, abstention=False)} | {f"no_{k}": {k: False} for k in ("calibration", "velocity", "abstention")}
    one = "count(*) FILTER (band = 'ALLOW') AS allow, count(*) FILTER (band = 'REVIEW') AS review, count(*) FILTER (band = 'BLOCK') AS block"
    rows = " UNION ALL ".join(_prf_sql(f"{CONFUSION}, {one}, '{a}' AS arm FROM {_decided(**kw)}", "arm, allow, review, block, ") for a, kw in arms.items())
    return f", a AS ({rows}) SELECT arm, macro_f1, fpr, fnr, allow, review, block, round(macro_f1 - (SELECT macro_f1 FROM a WHERE arm = 'all'), 5) AS delta FROM a"


@query("control_ablation", _ablation_sql(), "fx_scored")
def _(spark, d):
    return decide.ablation(_scored(spark, d), MODEL)


_PART = lambda m, w: f"1 / (1 + exp(-{LOGIT})) - 1 / (1 + exp(-({LOGIT} - {w} * ({m} - 0.5))))"


@query(
    "occlusion",
    ", o AS (" + " UNION ALL ".join(f"SELECT id, '{m}' AS member, {_PART(m, w)} AS c FROM fx_scored" for m, w in MODEL.weights.items()) + ") SELECT id, member, round(c, 6) AS contribution, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, member) AS INT) AS place FROM o WHERE abs(c) >= 1e-4",
    "fx_scored",
)
def _(spark, d):
    return decide.occlusion(view(spark, d, "fx_scored"), MODEL)


def _band(s: str) -> str:
    return f"CASE WHEN {s} >= 0.8 THEN 'BLOCK' WHEN {s} >= 0.4 THEN 'REVIEW' ELSE 'ALLOW' END"


@query("compare_baseline", f"SELECT id, round(score, 6) AS score, round(m_wordtfidf, 6) AS other_score, {_band('score')} AS band, {_band('m_wordtfidf')} AS other_band, round(abs(score - m_wordtfidf), 6) AS difference FROM fx_scored", "fx_scored")
def _(spark, d):
    return decide.compare(view(spark, d, "fx_scored"), "m_wordtfidf")


# --- evaluation ---------------------------------------------------------------


def _calibration_sql(column: str) -> str:
    return f"SELECT '{column}' AS stage, round(sum(abs(c - a) * n) / sum(n), 6) AS ece, round(coalesce(max(abs(c - a)) FILTER (n >= 20), 0.0), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM (SELECT least(floor({column} * 15), 14) AS bin, count(*) AS n, avg({column}) AS c, avg(y) AS a, sum(({column} - y) * ({column} - y)) AS sq FROM {_decided(velocity=False)} GROUP BY 1)"


@query("calibration_report", f"{_calibration_sql('raw')} UNION ALL {_calibration_sql('score')}", "fx_scored")
def _(spark, d):
    return evaluation.calibration_report(decide.decide(_scored(spark, d), MODEL, decide.Controls(velocity=False)), ("raw", "score"))


DIMENSIONS = {
    "lure_type": "group_key",
    "links": "CASE WHEN contains(lower(body), 'http') OR contains(lower(coalesce(html, '')), 'http') THEN 'with links' ELSE 'no links' END",
    "behavioural_context": "CASE WHEN available THEN 'behavioural context' ELSE 'no behavioural context' END",
    "body_length": "CASE WHEN length(body) < 250 THEN 'short (<250)' WHEN length(body) < 800 THEN 'medium (250-800)' ELSE 'long (800+)' END",
    "html": "CASE WHEN trim(coalesce(html, '')) <> '' THEN 'html part' ELSE 'text only' END",
    "attachments": "CASE WHEN att_name <> '' THEN 'with attachment' ELSE 'no attachment' END",
    "authentication": "CASE WHEN spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass' THEN 'auth all pass' ELSE 'auth imperfect' END",
}
JOINED = "(SELECT s.y, s.score, s.id, m.* FROM fx_scored s JOIN fx_mail m ON m.message_id = s.id)"


def _slices_sql() -> str:
    each = " UNION ALL ".join(f"SELECT y, score, '{k}' AS slice, {v} AS value FROM j" for k, v in DIMENSIONS.items())
    inner = f"SELECT * FROM ({CONFUSION}, slice, value, round(avg(y), 6) AS positive_rate FROM e GROUP BY slice, value) WHERE tn + fp + fn + tp >= 8"
    return f", j AS {JOINED}, e AS ({each}) {_prf_sql(inner, 'slice, value, positive_rate, tn + fp + fn + tp AS n, fp + fn AS errors, ')}"


def _joined(spark, d):
    return view(spark, d, "fx_mail").join(view(spark, d, "fx_scored").select("id", "y", "score"), F.col("message_id") == F.col("id"))


@query("slice_dimensions", _slices_sql(), "fx_scored", "fx_mail")
def _(spark, d):
    return evaluation.slices(_joined(spark, d), DIMENSIONS)


HAS_LINK = "regexp_matches(body, 'https?://|www[.]') OR regexp_matches(coalesce(html, ''), '<a [^>]*href')"
KIND = "CASE message_id % 11 WHEN 0 THEN 'clone' WHEN 1 THEN 'bec_ceo' WHEN 2 THEN 'thread_hijack' WHEN 3 THEN 'suspicious_ham' WHEN 4 THEN 'real_bank' ELSE 'other' END"
ERROR_SQL = f"""(SELECT *, CASE WHEN y = 1 THEN CASE WHEN kind = 'clone' THEN 'missed: clone' WHEN kind IN ('bec_ceo', 'vendor_swap') THEN 'missed: business email compromise' WHEN kind = 'thread_hijack' THEN 'missed: thread hijack' WHEN NOT has_link THEN 'missed: no link'
      WHEN prior_messages > 5 THEN 'missed: known sender' WHEN spf = 'pass' AND dkim = 'pass' AND dmarc = 'pass' THEN 'missed: authenticated domain' ELSE 'missed: other' END
    ELSE CASE WHEN kind = 'suspicious_ham' THEN 'false alarm: marketing' WHEN kind LIKE 'real_%' THEN 'false alarm: transactional mail' WHEN contains(body, 'bit.ly') OR contains(body, 'tinyurl') THEN 'false alarm: shortener' WHEN first_seen THEN 'false alarm: unknown sender'
      WHEN domain_age_days < 90 THEN 'false alarm: young domain' ELSE 'false alarm: other' END END AS category
    FROM (SELECT *, {KIND} AS kind, {HAS_LINK} AS has_link FROM {JOINED}) WHERE CAST(score >= 0.5 AS INT) <> y)"""


@query("error_categories", f"SELECT category, count(*) AS n, round(max(abs(score - 0.5)), 6) AS worst, round(count(*) / (SELECT count(*) FROM {JOINED}), 6) AS rate FROM {ERROR_SQL} GROUP BY category", "fx_scored", "fx_mail")
def _(spark, d):
    return evaluation.error_report(_joined(spark, d).withColumn("kind", F.expr(KIND)))


@query("worst_errors_named", f"SELECT id, category, y, round(score, 6) AS score, round(abs(score - 0.5), 6) AS severity FROM {ERROR_SQL} ORDER BY severity DESC, id LIMIT 12", "fx_scored", "fx_mail")
def _(spark, d):
    return evaluation.worst_named(_joined(spark, d).withColumn("kind", F.expr(KIND)))


CASES = "(SELECT *, id % 24 AS case_id, id % 5 AS cue FROM (" + BANDED + "))"
PASS = "CAST((y = 1 AND band <> 'ALLOW') OR (y = 0 AND band <> 'BLOCK') AS INT)"


@query("per_cue", f"SELECT cue, count(DISTINCT case_id) AS cases, sum(n) AS records, round(sum(passed) / sum(n), 6) AS pass_rate FROM (SELECT cue, case_id, count(*) AS n, sum({PASS}) AS passed FROM {CASES} GROUP BY cue, case_id) GROUP BY cue", "fx_scored")
def _(spark, d):
    return evaluation.per_cue(view(spark, d, "fx_scored").selectExpr("*", "id % 24 AS case_id", "id % 5 AS cue"))


RUNS = ("m_rules", "m_engineered", "m_charngram", "m_wordtfidf")
_RUN = " UNION ALL ".join(f"SELECT id, y, '{m}' AS run, {m} AS score FROM fx_scored" for m in RUNS)
_OUTCOME = "avg(CASE WHEN y = 1 THEN CAST(score < 0.4 AS INT) END) AS silent, avg(CASE WHEN y = 0 THEN CAST(score >= 0.8 AS INT) END) AS false_block, avg(CAST(score >= 0.4 AND score < 0.8 AS INT)) AS load"


@query(
    "run_sensitivity",
    f""", r AS ({_RUN}), o AS (SELECT run, {_OUTCOME} FROM r GROUP BY run)
    SELECT count(*) AS runs, {", ".join(f"round({f}({k}), 6) AS {k}_{n}" for k in ("silent", "false_block", "load") for f, n in (("min", "min"), ("max", "max"), ("avg", "mean")))} FROM o""",
    "fx_scored",
)
def _(spark, d):
    return evaluation.run_sensitivity(evaluation.long_runs(view(spark, d, "fx_scored"), RUNS))


@query("run_failures", f", r AS ({_RUN}) SELECT case_id, count(*) FILTER (rate < 1) AS failed_runs, round(min(rate), 6) AS worst FROM (SELECT run, id % 24 AS case_id, avg(CAST((y = 1 AND score >= 0.4) OR (y = 0 AND score < 0.8) AS INT)) AS rate FROM r GROUP BY 1, 2) GROUP BY case_id", "fx_scored")
def _(spark, d):
    return evaluation.run_failures(evaluation.long_runs(view(spark, d, "fx_scored"), RUNS).withColumn("case_id", F.col("id") % 24))


SUBSETS = {"rules": ["m_rules"], "engineered": ["m_engineered"], "text": ["m_charngram", "m_wordtfidf"]}


def _subset_sql() -> str:
    rows = []
    for name, members in evaluation.combinations(SUBSETS).items():
        mean = f"(({' + '.join(members)}) / {len(members)})"
        rows.append(_prf_sql(f"{CONFUSION}, '{name}' AS arm FROM (SELECT y, {mean} AS score FROM fx_scored)", "arm, "))
    return f", a AS ({' UNION ALL '.join(rows)}) SELECT arm, macro_f1, recall, fpr, round(macro_f1 - (SELECT macro_f1 FROM a WHERE arm = 'engineered+rules+text'), 5) AS delta FROM a"


@query("member_ablation", _subset_sql(), "fx_scored")
def _(spark, d):
    return evaluation.member_ablation(view(spark, d, "fx_scored"), SUBSETS)


@query("hard_subset", _prf_sql(f"SELECT * FROM ({CONFUSION}, count(*) AS n FROM fx_scored WHERE slice_lang IN ('de', 'fr')) WHERE n >= 20 AND tp + fn > 0 AND tn + fp > 0", "n, "), "fx_scored")
def _(spark, d):
    return evaluation.hard_subset(view(spark, d, "fx_scored").filter("slice_lang in ('de', 'fr')"))


def _least(target: float) -> str:
    return f"(SELECT min(score) FROM r2 WHERE system = s.system AND neg > 0 AND neg_above <= floor(CAST({target} AS DOUBLE) * (SELECT sum(1 - y) FROM fx_scored)))"


SYSTEMS = {"fused": "score", "rules": "m_rules", "text": "m_wordtfidf"}


@query(
    "systems_compared",
    ", l AS (" + " UNION ALL ".join(f"SELECT y, '{k}' AS system, {c} AS score FROM fx_scored" for k, c in SYSTEMS.items()) + f"""), r2 AS (SELECT system, score, sum(1 - y) AS neg, sum(sum(1 - y)) OVER (PARTITION BY system ORDER BY score DESC) AS neg_above FROM l GROUP BY system, score),
    t AS (SELECT system, {_least(0.25)} AS review, greatest({_least(0.06)}, {_least(0.25)}) AS block FROM (SELECT DISTINCT system FROM l) s)
    SELECT l.system, round(any_value(review), 6) AS review, round(any_value(block), 6) AS block, round(avg(CASE WHEN y = 1 THEN CAST(score < review AS INT) END), 6) AS silent_delivery, round(avg(CASE WHEN y = 0 THEN CAST(score >= block AS INT) END), 6) AS false_block,
    round(avg(CAST(score >= review AND score < block AS INT)), 6) AS review_load, round(avg(CASE WHEN y = 1 THEN CAST(score >= block AS INT) END), 6) AS caught FROM l JOIN t ON t.system = l.system GROUP BY l.system""",
    "fx_scored",
)
def _(spark, d):
    return evaluation.systems(view(spark, d, "fx_scored"), SYSTEMS, 0.25, 0.06)


# --- policy grid --------------------------------------------------------------

POLICIES = f"""p AS (SELECT review, block, abstain, mode FROM (SELECT unnest({list(policy_grid.GRID)}::DOUBLE[]) AS review), (SELECT unnest({list(policy_grid.GRID)}::DOUBLE[]) AS block), (SELECT unnest({list(policy_grid.ABSTAIN)}::DOUBLE[]) AS abstain), (SELECT unnest(['symmetric', 'escalate']) AS mode) WHERE block >= review AND (abstain <= 1 OR mode = 'symmetric'))"""
ROWS = f"x AS (SELECT y, id % 7 = 0 AS hard, score, list_min({LIST}) AS lo, list_max({LIST}) AS hi, list_sort({LIST})[-2] AS second, list_max({LIST}) - list_min({LIST}) AS spread FROM fx_scored)"
MOVED = "round(spread, 9) >= abstain AND lo < review AND (second >= review OR hi >= block) AND NOT (score >= review AND score < block) AND NOT (mode = 'escalate' AND score >= block)"
RATES = f"""r AS (SELECT review, block, abstain, mode, hard, avg(CASE WHEN y = 1 THEN CAST(b = 'A' AS INT) END) AS pa, avg(CASE WHEN y = 1 THEN CAST(b = 'R' AS INT) END) AS pr, avg(CASE WHEN y = 0 THEN CAST(b = 'R' AS INT) END) AS hr, avg(CASE WHEN y = 0 THEN CAST(b = 'B' AS INT) END) AS hb
  FROM (SELECT *, CASE WHEN {MOVED} THEN 'R' WHEN score >= block THEN 'B' WHEN score >= review THEN 'R' ELSE 'A' END AS b FROM x, p) GROUP BY ALL)"""
PAIR = "g AS (SELECT o.review, o.block, o.abstain, o.mode, o.pa, o.pr, o.hr, o.hb, h.pa AS hpa, h.pr AS hpr, h.hr AS hhr, h.hb AS hhb FROM r o JOIN r h USING (review, block, abstain, mode) WHERE NOT o.hard AND h.hard)"
GRIDS = f", {POLICIES}, {ROWS}, {RATES}, {PAIR}"


def _cost(miss: str = "200.0", share: str = "0.10") -> str:
    return f"round(1000 * (0.05 * ((1 - {share}) * pa + {share} * hpa) * {miss} + 0.05 * ((1 - {share}) * pr + {share} * hpr) * (1.0 + 0.05 * {miss}) + 0.95 * ((1 - {share}) * hr + {share} * hhr) * (1.0 + 0.05 * 15.0) + 0.95 * ((1 - {share}) * hb + {share} * hhb) * 15.0), 6)"


def _split(spark, d):
    return view(spark, d, "fx_scored").withColumn("hard", F.expr("id % 7 = 0"))


@query("policy_rates", f"{GRIDS} SELECT review, block, abstain, mode, {', '.join(f'round({k}, 6) AS {n}' for k, n in (('pa', 'p_allow_phish'), ('pr', 'p_review_phish'), ('hr', 'p_review_ham'), ('hb', 'p_block_ham')))}, {_cost()} AS cost FROM g", "fx_scored")
def _(spark, d):
    return policy_grid.priced(policy_grid.rate_table(_split(spark, d))).select("review", "block", "abstain", "mode", "p_allow_phish", "p_review_phish", "p_review_ham", "p_block_ham", "cost")


ORDER = "cost, abstain, mode DESC, review, block"


@query("policy_sensitivity", f"{GRIDS} SELECT miss, share, review, block, abstain, mode, cost FROM (SELECT *, row_number() OVER (PARTITION BY miss, share ORDER BY {ORDER}) AS k FROM (SELECT *, {_cost('miss', 'share')} AS cost FROM g, (SELECT unnest({list(policy_grid.MISSES)}::DOUBLE[]) AS miss), (SELECT unnest({list(policy_grid.SHARES)}::DOUBLE[]) AS share))) WHERE k = 1", "fx_scored")
def _(spark, d):
    return policy_grid.sensitivity(policy_grid.rate_table(_split(spark, d)))


@query("break_even_share", f"{GRIDS} SELECT min(share) AS share FROM (SELECT share, min(cost) AS any_, min(cost) FILTER (abstain > 1) AS off_ FROM (SELECT *, {_cost(share='share')} AS cost FROM g, (SELECT unnest(list_transform(range(121), lambda i: CAST(i AS DOUBLE) * 0.0025)) AS share)) GROUP BY share) WHERE any_ < off_ - 1e-9", "fx_scored")
def _(spark, d):
    return policy_grid.break_even(policy_grid.rate_table(_split(spark, d)))


@query("cost_curve", f"{GRIDS} SELECT block, {_cost()} AS cost FROM g WHERE review = 0.4 AND abstain > 1", "fx_scored")
def _(spark, d):
    return policy_grid.curve(policy_grid.rate_table(_split(spark, d)), 0.4)
