"""Mail archives, labelled tables, contracts and sinks."""

import os

import pytest
from pyspark.sql import functions as F

from mailsift.sources import mail, sinks

PHISH = b"""Received: from a by b
Received: from c by d
Authentication-Results: mx; spf=softfail; dkim=none; dmarc=fail
Authentication-Results: old; spf=pass; dkim=pass; dmarc=pass
From: "PayPal" <x@paypa1.com>
To: me@here.example, you@here.example
Subject: =?utf-8?B?w6nDqA==?=
Date: Mon, 01 Jan 2024 10:00:00 +0000
Content-Type: text/html; charset=windows-1252

<style>p{}</style><p>Pay \x80 now &amp; <a href="http://x.tk">here</a></p>
"""
PLAIN = b"From: a@b.example\nSubject: hi\nReceived-SPF: Fail (x)\n\nhello\n"


def test_archives(spark, tmp_path):
    (tmp_path / "one.eml").write_bytes(PHISH)
    (tmp_path / "box.mbox").write_bytes(b"From a@b Mon Jan 1\n" + PLAIN + b"\nFrom c@d Mon Jan 1\n" + PHISH)
    (tmp_path / "bad.eml").write_bytes(b"\x00\x01 nothing here")
    good, bad = mail.read_archives(spark, f"file://{tmp_path}")
    rows = {(os.path.basename(r.path), r.part): r for r in good.collect()}
    assert len(rows) == 3 and bad.count() == 1
    one = rows["one.eml", 0]
    assert one.subject == "éè" and one.body == "Pay € now & here" and one.html_only
    assert (one.spf, one.dkim, one.dmarc, one.received_hops) == ("softfail", "none", "fail", 2)
    assert one.recipients == ["me@here.example", "you@here.example"]
    assert rows["box.mbox", 0].spf == "fail"
    report = mail.load_report(good, bad).first()
    assert (report.kept, report.html_only_converted, report.undated, report.rejected) == (3, 2, 1, 1)


@pytest.mark.parametrize("labels,spam_as,want", [(["-1", "1"], None, [1, 0]), (["1", "0", "0.0"], None, [1, 0, 0]), (["Phishing Email", "Safe Email", "spam", "what"], None, [1, 0]), (["ham", "spam"], 1, [0, 1])])
def test_labels(spark, tmp_path, labels, spam_as, want):
    path = tmp_path / "x.csv"
    path.write_text("Email Text,Email-Type\n" + "".join(f'"text {i}",{v}\n' for i, v in enumerate(labels)))
    good, bad = mail.read_labelled_csv(spark, f"file://{path}", spam_as=spam_as)
    assert [r.label for r in good.orderBy("body").collect()] == want
    assert bad.count() == len(labels) - len(want)


def test_contract_and_union(spark):
    df = spark.createDataFrame([(1, "s", "b", "a@b", "pass", "none"), (2, "s" * 3000, "b", "a@b", "maybe", "none")], "message_id long, subject string, body string, sender string, spf string, dmarc string")
    good, bad = mail.check_contract(df)
    assert good.count() == 1 and bad.first().breaches == ["subject_too_long", "bad_spf"]
    both = mail.union_sources([(df.select("message_id"), 1), (df.select("subject"), 0)])
    assert both.groupBy("label").count().count() == 2


def test_sinks(spark, tmp_path):
    path = f"file://{tmp_path}/decisions"
    rows = spark.createDataFrame([(1, "2024-01-01", '{"a": 0.5}'), (2, "2024-01-02", "broken")], "decision_id long, created_ts string, member_scores string").withColumn("created_ts", F.to_timestamp("created_ts"))
    sinks.append_decisions(rows, path)
    back = {r.decision_id: (r.member_scores, r.trace_id) for r in sinks.read_decisions(spark, path).collect()}
    assert back == {1: ({"a": 0.5}, ""), 2: ({}, "")}
    feedback = spark.createDataFrame([(1, "phishing"), (9, "unsure")], "decision_id long, analyst_label string")
    assert [r.decision_id for r in sinks.append_feedback(feedback, rows, f"file://{tmp_path}/feedback").collect()] == [9]
    q = sinks.incremental(spark, path, sinks.read_decisions(spark, path).drop("member_scores", "trace_id", "day").schema, f"file://{tmp_path}/sink", f"file://{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"file://{tmp_path}/sink").count() == 2
