"""Tables of a data folder, and mail-shaped views over them.

The views are plain SQL that Spark and other engines read alike, so each can be used as a DataFrame
(``view``) or be put before a query's text (``ctes``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "fx_scored": """SELECT d.doc_id AS id, l.toxic AS y, d.lang AS slice_lang,
        CAST(450 * l.toxic + (d.doc_id * 7919) % 550 AS DOUBLE) / 1000 AS score,
        CAST(400 * l.toxic + (d.doc_id * 104729) % 600 AS DOUBLE) / 1000 AS m_rules,
        CAST(500 * l.toxic + (d.doc_id * 1299709) % 500 AS DOUBLE) / 1000 AS m_engineered,
        CAST(300 * l.toxic + (d.doc_id * 15485863) % 700 AS DOUBLE) / 1000 AS m_charngram,
        CAST(350 * l.toxic + (d.doc_id * 32452843) % 650 AS DOUBLE) / 1000 AS m_wordtfidf
        FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "fx_decisions": """SELECT event_id AS decision_id, ts AS created_ts, event_type,
        CAST((event_id * 7919) % 1000 AS DOUBLE) / 1000 AS score,
        CASE WHEN (event_id * 7919) % 1000 >= 800 THEN 'BLOCK' WHEN (event_id * 7919) % 1000 >= 400 THEN 'REVIEW' ELSE 'ALLOW' END AS band,
        concat('d', CAST(user_id AS VARCHAR(20)), '.example') AS sender_domain,
        CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) * 37 AS body_length,
        1 + event_id % 5 AS recipient_count, event_id % 3 AS attachment_count,
        CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS behavioral_available, value AS latency_ms FROM events""",
    "fx_feedback": """SELECT event_id AS feedback_id, event_id - 1 AS decision_id, ts AS created_ts,
        CASE event_id % 3 WHEN 0 THEN 'phishing' WHEN 1 THEN 'legitimate' ELSE 'unsure' END AS analyst_label
        FROM events WHERE event_type = 'error' AND event_id > 0""",
    "fx_cases": """SELECT decision_id AS case_id, decision_id, created_ts,
        CASE WHEN event_type = 'signup' THEN 'user_report' ELSE 'model_review' END AS origin,
        CASE WHEN event_type = 'signup' AND band = 'ALLOW' THEN 1 WHEN band = 'REVIEW' THEN 2 ELSE 3 END AS priority,
        CASE decision_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'in_review' WHEN 2 THEN 'escalated' ELSE 'resolved' END AS state,
        60 * (1 + decision_id % 90) AS secs_to_claim, 60 * (100 + decision_id % 1700) AS secs_to_resolve,
        CASE WHEN decision_id % 2 = 0 THEN 'confirmed_phishing' ELSE 'released' END AS resolution
        FROM fx_decisions WHERE band = 'REVIEW' OR event_type = 'signup'""",
    "fx_mail_log": """SELECT event_id AS msg_id, ts, user_id AS sender, event_id % 7 AS recipient,
        concat('dom', CAST(user_id % 40 AS VARCHAR(20)), '.example') AS sender_domain,
        concat('name', CAST(user_id % 11 AS VARCHAR(20))) AS display_name, event_type FROM events""",
    "fx_messages": """SELECT doc_id AS message_id, substring(text, 1, 60) AS subject, text AS body,
        CASE doc_id % 8 WHEN 0 THEN 'PayPal Support <security@paypa1.com>' WHEN 1 THEN 'PayPal <service@paypal.com>'
            WHEN 2 THEN 'Microsoft <no-reply@login.security-update.cf>' WHEN 3 THEN 'Shop <news@mail.example.co.uk>'
            WHEN 4 THEN 'j.doe99+tag@gmail.com' WHEN 5 THEN 'HDFC <alerts@hdfcbnak.com>'
            WHEN 6 THEN 'Priya <priya@northgate.example>' ELSE '' END AS sender,
        CASE WHEN doc_id % 5 = 0 THEN 'recovery@mail.ru' ELSE '' END AS reply_to,
        CASE doc_id % 3 WHEN 0 THEN 'pass' WHEN 1 THEN 'softfail' ELSE 'none' END AS spf,
        CASE doc_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' ELSE 'pass' END AS dmarc,
        concat(source, '-', lang) AS group_key FROM documents""",
    "fx_mail": """SELECT m.*, CASE message_id % 6 WHEN 0 THEN 'fail' WHEN 1 THEN 'none' ELSE 'pass' END AS dkim,
        CASE WHEN message_id % 9 = 0 THEN 'bounce@mailer.example' ELSE '' END AS return_path, message_id % 7 AS received_hops, message_id % 4 AS recipients, p.html,
        CASE message_id % 10 WHEN 0 THEN 'invoice.pdf.exe' WHEN 1 THEN 'report.docm' WHEN 2 THEN 'photos.zip' WHEN 3 THEN 'terms.pdf' WHEN 4 THEN 'notes' ELSE '' END AS att_name,
        CASE message_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' ELSE '' END AS att_kind, (message_id * 37) % 90000 AS att_size,
        message_id % 4 <> 0 AS available, message_id % 40 = 0 AS first_seen, message_id % 40 AS prior_messages, message_id % 11 AS prior_replies, message_id % 3 AS thread_depth,
        message_id % 24 AS hour_local, message_id % 7 < 2 AS is_weekend, message_id % 30 AS bcc_count, message_id % 28 AS recipient_count, message_id % 2 = 0 AS external_sender,
        message_id % 13 AS domain_report_count, CAST(message_id % 10 AS DOUBLE) / 10 AS domain_click_rate, message_id % 50 AS burst_count_1h, message_id % 4 AS display_name_alias_count, (message_id * 31) % 4000 AS domain_age_days
        FROM fx_messages m LEFT JOIN pages p ON p.page_id = m.message_id""",
    "fx_links": """SELECT doc_id AS message_id, 0 AS pos,
        CASE doc_id % 6 WHEN 0 THEN 'http://192.168.4.9:8080/login' WHEN 1 THEN 'https://www.paypal.com/signin'
            WHEN 2 THEN 'https://microsoft.com.security-update.cf/login' WHEN 3 THEN 'https://relay.example/r?url=https%3A%2F%2Fbad-domain.tk%2Flogin'
            WHEN 4 THEN 'https://bit.ly/abc1234' ELSE 'https://evil.pages.dev/account/verify?id=7' END AS href,
        CASE WHEN doc_id % 7 = 0 THEN 'https://www.paypal.com/signin' ELSE '' END AS label
        FROM documents WHERE doc_id % 4 > 0
        UNION ALL SELECT doc_id, 1, 'https://www.example.com/orders', '' FROM documents WHERE doc_id % 4 > 2""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input for each core below which a table is dealt anew: a small file is one row group, and so one task.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores where its input is small for them; a large table keeps the partitions of its scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    inputs = df._jdf.queryExecution().analyzed().collectLeaves()
    size = sum(int(inputs.apply(i).stats().sizeInBytes()) for i in range(inputs.size()))
    return df.repartition(cores) if size <= cores * SMALL else df


def _reads(name: str, among: list[str]) -> list[str]:
    return [x for x in among if re.search(rf"\b(?:FROM|JOIN) {x}\b", VIEWS[name])]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A mail-shaped view as a DataFrame."""
    text, frames = VIEWS[name], {}
    for x in _reads(name, [*VIEWS, *BASE]):
        frames[x] = view(spark, sf_dir, x) if x in VIEWS else table(spark, sf_dir, x)
        text = re.sub(rf"\b(FROM|JOIN) {x}\b", rf"\1 {{{x}}}", text)
    return spark.sql(text, **frames)


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with all that features read: HTML, an attachment and the sender's context."""
    one = F.array(F.struct(F.col("att_name").alias("filename"), F.col("att_kind").alias("content_type"), F.col("att_size").alias("size_bytes")))
    x = spread(view(spark, sf_dir, "fx_mail"))
    return x.withColumn("attachments", F.when(F.col("att_name") != "", one)).drop("att_name", "att_kind", "att_size")


def ctes(*names: str) -> str:
    """A WITH clause that defines views, and those they read, for a query's text."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for x in _reads(name, list(VIEWS)):
            add(x)
        out.setdefault(name, f"{name} AS ({VIEWS[name]})")

    for name in names:
        add(name)
    return "WITH " + ",\n".join(out.values())
