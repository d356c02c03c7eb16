"""Evidence in words: numbers, phrases, fragments and terms against plain versions, and whole cards by their rules."""

import re

import pytest
from pyspark.sql import functions as F

from mailsift.functions.refdata import FEATURE_FAMILIES, FEATURE_PHRASES, RULES
from mailsift.operators import detector as D
from mailsift.operators import evidence as E
from mailsift.plans import catalogue
from mailsift.plans import detector as plans
from mailsift.sources import tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    """Few trees and small hashed spaces, to save time; nothing here depends on the fit's quality."""
    labels = tables.table(spark, SF, "labels").select(F.col("doc_id").alias("message_id"), F.col("toxic").alias("y"))
    found = D.train(tables.mails(spark, SF), labels, trees=3, depth=3, features=1 << 10)
    plans._TRAINED[spark.sparkContext.applicationId, SF] = found
    return found


def plain(v):
    return f"{v:g}" if v != int(v) else f"{int(v)}"


def test_numbers_and_phrases(spark):
    values = [0.0, 1.0, -3.0, 2.5, 0.123456789, 1e-5, 0.00012, 123456.7, 1234567.5, -0.3, 999999.9, 4000000.0, 0.1]
    rows = spark.createDataFrame([(n, v) for n in [*FEATURE_PHRASES, "url_path_depth__mean", "hdr_new_thing"] for v in values], "n string, v double")
    for r in rows.select("n", "v", E.number(F.col("v")).alias("x"), E.phrase(F.col("n"), F.col("v")).alias("p")).collect():
        assert r.x == plain(r.v)
        name = r.n
        for a, b in FEATURE_FAMILIES:
            name = name.replace(a, b)
        assert r.p == (FEATURE_PHRASES[r.n].replace("{v}", plain(r.v)) if r.n in FEATURE_PHRASES else f"{name} = {plain(r.v)}")


def test_fragments_become_words(spark):
    cases = [("please verify your paypal account", ["ypa", "pay", "acc", "  ", "zzz", "e v"]), ("Überweisung an müller@bank.de", ["üll", "wei", "an"]), ("", ["abc"]), ("a", [])]
    got = spark.createDataFrame(cases, "text string, f array<string>").select("text", E.readable(F.col("f"), F.col("text")).alias("w")).collect()
    for (text, fragments), r in zip(cases, got, strict=True):
        want = []
        for f in (re.sub(r"\s+", " ", x).strip() for x in fragments):
            word = next((w for w in re.findall(r"[\w@./-]+", text) if f and f in w), f)
            if word and word not in want:
                want.append(word)
        assert r.w == want


@pytest.mark.parametrize("member", ["m_words", "m_chars"])
def test_terms_add_up_to_the_members_log_odds(spark, model, member):
    """All contributions of a row and the intercept are the fitted member's own log-odds (fragments of one hash count once)."""
    fit = model.member(member)
    rows = E._held_rows(model, spark).limit(8) if E.held(model, spark).count() else model.rows(spark).limit(8)
    rows = rows.select("message_id", "text").cache()
    lr = fit.stages[-1]
    own = {r.message_id: r.s for r in D.probability(fit, rows, "s").collect()}
    found = {r.message_id: r.c for r in E.term_contributions(fit, rows, "message_id", 10**9).groupBy("message_id").agg(F.sum("contribution").alias("c")).collect()}
    import math

    for i, s in own.items():
        assert abs(1 / (1 + math.exp(-(found.get(i, 0.0) + lr.intercept))) - s) < 5e-3
    for r in E.term_contributions(fit, rows, "message_id", 3).join(rows, "message_id").collect():
        text = r.text.lower() if member == "m_chars" else " ".join(re.findall(r"[a-z0-9']+", r.text.lower()))
        assert r.term in text and r.place <= 3


def test_ranked_pins_context_and_keeps_each_once(spark):
    items = [(1, i, "rule", f"R{i:02}", "t", "d", "phishing", 0.1 * i) for i in range(1, 15)]
    items += [(1, 0, "context", "destination", "t", "d", "neutral", 0.0), (1, 22, "context", "no_behavioral_context", "t", "d", "neutral", 0.0), (1, 3, "rule", "R14", "t", "again", "phishing", 0.2), (2, 21, "member", "ensemble", "t", "d", "neutral", 0.0)]
    got = E.ranked(spark.createDataFrame(items, "message_id long, ord int, kind string, id string, title string, detail string, direction string, weight double")).orderBy("message_id", "place").collect()
    assert [(r.message_id, r.place, r.id) for r in got] == [(1, 1, "destination"), (1, 2, "no_behavioral_context"), *((1, 3 + k, f"R{14 - k:02}") for k in range(10)), (2, 1, "ensemble")]
    assert next(r for r in got if r.id == "R14").detail == "d"


def test_cards_of_held_messages(spark, model):
    got = catalogue.QUERIES["evidence_cards"](spark, SF).cache()
    scored = {r.message_id: r for r in E.held(model, spark).collect()}
    by: dict = {}
    for r in got.orderBy("message_id", "place").collect():
        by.setdefault(r.message_id, []).append(r)
    assert by and set(by) == set(scored)
    rules = {r.message_id: list(r.fired) for r in catalogue.QUERIES["rule_score"](spark, SF).collect()}
    weight = {r[0]: r[1] for r in RULES}
    for i, rows in by.items():
        assert len(rows) <= 12 and [r.place for r in rows] == list(range(1, len(rows) + 1)) and len({(r.kind, r.id) for r in rows}) == len(rows)
        scoring = [r.weight for r in rows if r.kind != "context"]
        assert scoring == sorted(scoring, reverse=True) and [r.kind == "context" for r in rows] == sorted((r.kind == "context" for r in rows), reverse=True)
        shown = [r for r in rows if r.kind == "rule"]
        assert {r.id for r in shown} <= set(rules[i][:6]) and all(r.weight == round(abs(weight[r.id]) / 2, 4) for r in shown)
        assert any(r.id == "no_behavioral_context" for r in rows) == (i % 4 == 0)
        assert any(r.id == "destination" for r in rows) == (i % 4 > 0)
        s = [scored[i][m] for m in D.MEMBERS]
        spread = (sum((x - sum(s) / 3) ** 2 for x in s) / 3) ** 0.5
        assert all(abs(r.weight - spread) < 1e-4 and ("disagree" in r.title) == (spread > 0.25) for r in rows if r.kind == "member")
