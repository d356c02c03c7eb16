"""Rewrites of phishing mail: each one's effect, what still works as a lure, random chains, and the sweep."""

import pytest
from pyspark.sql import functions as F

from mailsift.operators import rewrites as R

FIELDS = """message_id long, subject string, body string, html string, sender string, reply_to string, return_path string, spf string, dkim string, dmarc string,
attachments array<struct<filename:string,content_type:string,size_bytes:bigint>>, received_hops int, hour_local int, is_weekend boolean, burst_count_1h int, recipient_count int, bcc_count int, thread_depth int, display_name_alias_count int"""
LINK = "https://evil.pages.xyz/login"
LURE = (1, "URGENT: verify your Account!", f"Dear Customer, please verify your password within 24 hours at {LINK}?id=3 IMMEDIATELY!", f'<html><body><p>Verify account <a href="{LINK}">here</a></p></body></html>')
ENVELOPE = ("PayPal <x@bad.tk>", "a@b.ru", "q@z.example", "fail", "none", "fail", [("a.exe", "x", 3)], 6, 23, True, 40, 20, 5, 0, 9)
QUIET = ("", "", "", "pass", "pass", "pass", None, 1, 10, False, 0, 0, 0, 0, 0)


@pytest.fixture(scope="module")
def found(spark):
    rows = [(*LURE, *ENVELOPE), (2, None, None, None, *QUIET), (3, "Re: hello", "nothing is asked for here, friend " * 3, "", *QUIET)]
    mails = spark.createDataFrame(rows, FIELDS)
    return mails, {(r.message_id, r.rewrite): r for r in R.rewritten(mails).collect()}


def test_each_rewrite_changes_its_part_only(found):
    rows = {k[1]: r for k, r in found[1].items() if k[0] == 1}
    assert set(rows) >= {r.id for r in R.REWRITES} - {"A-TRUST-02", "A-TRUST-03"}  # these two hang on the host drawn
    parts = {"text": {"subject", "body"}, "url": {"body", "html"}, "html": {"body", "html"}, "structure": {"body", "html"}}
    for r in R.REWRITES:
        if r.id in rows and r.channel in parts:
            assert (rows[r.id].sender, rows[r.id].reply_to, rows[r.id].hour_local) == (ENVELOPE[0], ENVELOPE[1], 23)
            assert {c for c, v in zip(("subject", "body", "html"), LURE[1:], strict=True) if rows[r.id][c] != v} <= parts[r.channel]
    assert rows["A-LEX-04"].subject == "verify your Account" and rows["A-LEX-04"].body.startswith("Hello, please verify") and "Immediately." in rows["A-LEX-04"].body
    assert "within 24 hours" not in rows["A-LEX-05"].body and LINK in rows["A-LEX-05"].body
    assert rows["A-URL-06"].body == LURE[2].replace("https:", "http:")
    assert "url=https%3A%2F%2Fevil.pages.xyz%2Flogin%3Fid%3D3 IMMEDIATELY!" in rows["A-URL-02"].body
    assert rows["A-URL-04"].html.endswith('evil.pages.xyz/login">here</a></p></body></html>') and rows["A-URL-04"].html != LURE[3]
    assert rows["A-STR-02"].html == LURE[3].replace("Verify", 'Ver<span style="font-size:0">x</span>ify').replace("account", 'acc<span style="font-size:0">x</span>ount')
    assert rows["A-HDR-03"].spf == rows["A-HDR-03"].dkim == rows["A-HDR-03"].dmarc == "pass" and rows["A-HDR-06"].received_hops == 3
    assert rows["A-HDR-05"].attachments[0].filename in R.FILES and rows["A-HDR-05"].attachments[0].size_bytes == 3
    assert 9 <= rows["A-BEH-01"].hour_local <= 17 and not rows["A-BEH-01"].is_weekend
    assert rows["A-CHAN-01"].html == "" and LINK not in rows["A-CHAN-01"].body and "+1 (8" in rows["A-CHAN-01"].body
    plain = rows["A-UNI-02"].body
    assert plain != LURE[2] and "".join(c for c in plain if c not in R.ZERO_WIDTH) == LURE[2]


def test_nulls_and_texts_that_ask_for_nothing(found):
    rows = found[1]
    assert {k[1] for k in rows if k[0] == 2} <= {"A-LEX-03"}  # only padding gives an empty message something to ask
    assert {k[1] for k in rows if k[0] == 3} <= {"A-LEX-03"}


def test_what_is_still_a_lure(spark):
    old = (1, "Notice", f"please verify at {LINK} and then go on with the rest", "")
    cases = {
        "same": (old[2], True),
        "relay": ("please verify at https://relay.example/r?url=https%3A%2F%2Fevil.pages.xyz%2Fx and then go on", True),
        "twice": ("please verify at https://a.example/r?url=https%3A%2F%2Fb.example%2Fr%3Fu%3Dhttps%253A%252F%252Fevil.pages.xyz%252F and then", True),
        "elsewhere": ("please verify at https://other.example/ and then go on with the rest", False),
        "shortened": ("please verify at https://bit.ly/abcdefg and then go on with the rest", True),
        "platform": ("please verify at https://docs.google.com/d/abc and then go on with the rest", True),
        "no link": ("please verify, and then go on with the rest of what you do", False),
        "call": ("please verify: +1 (800) 555-0123, and then go on with the rest", True),
        "no ask": (f"see {LINK} for the rest of what there is", False),
        "short": ("pay " + LINK[:8], False),
    }
    rows = [(i, "Notice", body, "", "Notice", old[2], "", True) for i, (body, _) in enumerate(cases.values())]
    x = spark.createDataFrame(rows, "i int, subject string, body string, html string, _o_subject string, _o_body string, _o_html string, changed boolean").withColumn("_first", F.lit(""))
    got = {r.i: r.valid for r in R.valid(x).collect()}
    assert {k: got[i] for i, k in enumerate(cases)} == {k: ok for k, (_, ok) in cases.items()}


def test_random_chains_are_stable_and_keep_the_lure(found):
    mails, _ = found
    key = lambda x: sorted((r.message_id, r.copy, tuple(r.rewrites), r.body) for r in x.collect())
    first = key(R.perturbed(mails, copies=4))
    assert first == key(R.perturbed(mails.repartition(3), copies=4)) and len(first) == 12
    mine = [r for r in first if r[0] == 1]
    assert all(len(r[2]) <= 3 for r in mine) and any(r[2] for r in mine) and len({r[2] for r in mine}) > 1


def test_sweep(spark):
    before = spark.createDataFrame([(i, 0.9) for i in range(4)] + [(4, 0.3)], "message_id long, score double")
    after = spark.createDataFrame([(i, "A-UNI-01", 0.4 if i < 3 else 0.8) for i in range(5)] + [(0, "A-LEX-01", 0.9)], "message_id long, rewrite string, score double")
    pairs = R.paired(before, after)
    got = {r.rewrite: r for r in R.sweep(pairs, 10).collect()}
    assert len(got) == len(R.REWRITES) == 35
    uni = got["A-UNI-01"]
    assert (uni.applicable, uni.applicability, uni.max_drop, uni.evasion_rate, uni.mean_drop) == (5, 0.5, 0.5, 0.75, round((3 * 0.5 + 0.1 - 0.5) / 5, 5))
    assert (got["A-LEX-01"].evasion_rate, got["A-BEH-01"].applicable) == (0.0, 0)
    worst = {(r.message_id, r.family): (r.after, r.queries) for r in R.worst_by_family(pairs).collect()}
    assert worst[0, "A-UNI"] == (0.4, 1) and worst[0, "A-LEX"] == (0.9, 1)


def test_what_did_not_change_is_no_rewrite(spark):
    body = f"please verify at {LINK} and then go on with the rest"
    rows = [(changed, "Notice", body, "", "Notice", body, "") for changed in (True, False, None)]
    x = spark.createDataFrame(rows, "changed boolean, subject string, body string, html string, _o_subject string, _o_body string, _o_html string").withColumn("_first", F.lit(""))
    assert {r.changed: r.valid for r in R.valid(x).collect()} == {True: True, False: False, None: False}
