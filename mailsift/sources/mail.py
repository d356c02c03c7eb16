"""Mail archives and labelled corpora as tables.

Archives are read as binary files and parsed by the standard library's mail parser, one file or one
message at a time in ``mapInPandas``; what can't be read goes to a table of rejects with a reason.
"""

from __future__ import annotations

import email
import email.policy
import re
from collections.abc import Iterator
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNDATED = "1970-01-01T00:00:00+00:00"
MESSAGE = (
    "path string, part int, subject string, body string, html_body string, sender string, reply_to string, return_path string, recipients array<string>, attachments array<struct<filename:string,content_type:string,size_bytes:bigint>>, "
    "spf string, dkim string, dmarc string, received_hops int, received_at string, source string, html_only boolean, reason string"
)
VERDICTS = {"spf": ("pass", "fail", "softfail", "neutral", "none"), "dkim": ("pass", "fail", "none"), "dmarc": ("pass", "fail", "none")}


def html_text(html: Column) -> Column:
    """Text of HTML: scripts and styles dropped, link text kept, common references decoded."""
    x = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/div|/tr|/li|/h[1-6])\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]*>", "")
    for name, char in {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.btrim(F.regexp_replace(x, r"[ \t]+", " "), F.lit(" \n\r"))


def _content(part: EmailMessage) -> str:
    try:
        return part.get_content()
    except (LookupError, ValueError):  # an unknown or wrong charset
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def _verdicts(mail: EmailMessage) -> dict[str, str]:
    """Of the topmost Authentication-Results alone; SPF else from Received-SPF."""
    first = str(next(iter(mail.get_all("Authentication-Results", [])), "")).lower()
    out = {}
    for name, known in VERDICTS.items():
        m = re.search(rf"\b{name}\s*=\s*([a-z]+)", first)
        out[name] = m[1] if m and m[1] in known else "none"
    if out["spf"] == "none" and (m := re.match(r"\s*([a-z]+)", str(mail.get("Received-SPF", "")).lower())) and m[1] in VERDICTS["spf"]:
        out["spf"] = m[1]
    return out


def parse(raw: bytes) -> dict:
    """One message as a row of ``MESSAGE``, without path, part and source."""
    mail = email.message_from_bytes(raw, policy=email.policy.default)
    if not any(mail.get(h) for h in ("From", "Subject", "Date", "Received", "To")):
        raise ValueError("no mail headers")
    texts, htmls, attachments = [], [], []
    for part in mail.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            attachments.append({"filename": name or "", "content_type": part.get_content_type(), "size_bytes": len(part.get_payload(decode=True) or b"")})
        elif part.get_content_type() == "text/html":
            htmls.append(_content(part))
        elif part.get_content_maintype() == "text":
            texts.append(_content(part))
    head = lambda h: str(mail.get(h, "") or "")
    try:
        when = mail["Date"].datetime.isoformat() if mail["Date"] is not None and mail["Date"].datetime else UNDATED
    except (AttributeError, TypeError, ValueError):
        when = UNDATED
    to = [a.addr_spec for a in getattr(mail["To"], "addresses", ())] if mail["To"] is not None else []
    return {"subject": head("Subject"), "body": "\n".join(texts), "html_body": "\n".join(htmls), "sender": head("From"), "reply_to": head("Reply-To"), "return_path": head("Return-Path"), "recipients": to, "attachments": attachments, **_verdicts(mail), "received_hops": len(mail.get_all("Received", [])), "received_at": when}


def messages_of(path: str, content: bytes) -> Iterator[tuple[int, dict]]:
    """(number, row) of each message of a file: an mbox by its name or first line, else one message."""
    box = path.lower().endswith(".mbox") or content.startswith(b"From ")
    parts = re.split(rb"(?m)^From [^\n]*\n", content)[1:] if box else [content]
    for i, raw in enumerate(parts):
        try:
            yield i, parse(raw) | {"reason": None}
        except (ValueError, LookupError, TypeError, AttributeError) as e:
            yield i, {"reason": f"unreadable: {e}"}


def read_archives(spark: SparkSession, path: str, source: str = "archive") -> tuple[DataFrame, DataFrame]:
    """(messages, rejects) of all .eml and .mbox files below a path."""
    names = [x.split()[0] for x in re.split(r", (?![a-z_]+:)", MESSAGE)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for where, content in zip(f.path, f.content, strict=True):
                rows = []
                for i, row in messages_of(where, bytes(content)):
                    html_only = not (row.get("body") or "").strip() and bool((row.get("html_body") or "").strip())
                    rows.append({n: row.get(n) for n in names} | {"path": where, "part": i, "source": source, "html_only": html_only})
                yield pd.DataFrame(rows, columns=names)

    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content").mapInPandas(run, MESSAGE)
    good = rows.filter("reason is null").drop("reason")
    good = good.withColumn("body", F.when(F.col("html_only"), html_text(F.col("html_body"))).otherwise(F.col("body"))).withColumn("received_at", F.to_timestamp("received_at"))
    return good, rows.filter("reason is not null").select("path", "part", "source", "reason")


def load_report(good: DataFrame, rejects: DataFrame) -> DataFrame:
    """Counts of what was kept, converted and refused."""
    kept = good.agg(F.count(F.lit(1)).alias("kept"), F.count_if("html_only").alias("html_only_converted"), F.count_if(F.col("received_at") == F.to_timestamp(F.lit(UNDATED))).alias("undated"))
    return kept.join(rejects.agg(F.count(F.lit(1)).alias("rejected")), F.lit(True))


#: Names under which labelled tables hold each column.
ALIASES = {"subject": ("subject", "title"), "body": ("body", "text", "message", "content", "emailtext"), "sender": ("sender", "from", "fromaddress"), "label": ("label", "class", "target", "emailtype", "category")}
PHISH, LEGIT, SPAM = ("phishing", "phish", "phishingemail", "malicious", "1"), ("legitimate", "legit", "ham", "safe", "safeemail", "benign", "0"), ("spam", "junk")


def read_labelled_csv(spark: SparkSession, path: str, label_column: str | None = None, spam_as: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with label 0 or 1, rejects) of labelled CSV files; columns are found whatever their case and separators."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    plain = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in raw.columns}
    found = {k: next((plain[a] for a in names if a in plain), None) for k, names in ALIASES.items()}
    if label_column:
        found["label"] = plain.get(re.sub(r"[^a-z0-9]", "", label_column.lower()))
    if found["label"] is None:
        raise ValueError("no label column")
    rows = raw.select(*(F.col(f"`{found[k]}`").alias(k) if found[k] else F.lit("").alias(k) for k in ("subject", "body", "sender")), F.regexp_replace(F.lower(F.trim(F.col(f"`{found['label']}`"))), r"[^a-z0-9\-.]", "").alias("raw_label"))
    rows = rows.withColumn("raw_label", F.regexp_replace("raw_label", r"\.0+$", ""))
    signed = rows.filter("raw_label = '-1'").limit(1).count() > 0  # the one value that turns the convention, over all rows
    return resolve_labels(rows, {"-1"} if signed else set(), spam_as)


def resolve_labels(rows: DataFrame, values: set, spam_as: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels by the convention that the distinct values show: -1 is phishing beside 1, else 1 is; names as they say."""
    v = F.col("raw_label")
    if "-1" in values:
        label = F.when(v == "-1", 1).when(v == "1", 0)
    else:
        label = F.when(v.isin(*PHISH), 1).when(v.isin(*LEGIT), 0)
    if spam_as is not None:
        label = F.when(v.isin(*SPAM), spam_as).otherwise(label)
    reason = F.when(v.isin(*SPAM), "spam").otherwise("unknown_label")
    x = rows.withColumn("label", label)
    return x.filter("label is not null").drop("raw_label"), x.filter("label is null").select("raw_label", reason.alias("reason")).groupBy("reason", "raw_label").count()


def read_url_list(spark: SparkSession, path: str, source: str = "urls") -> DataFrame:
    """One message for each line that holds a URL."""
    lines = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> '' and not url like '#%'")
    return lines.select(F.sha1("url").alias("message_id"), F.lit("").alias("subject"), F.col("url").alias("body"), F.lit("").alias("sender"), F.lit(source).alias("source"))


def union_sources(parts: list[tuple[DataFrame, int | None]]) -> DataFrame:
    """Sources as one table; those of a single class take the label given with them."""
    out = None
    for df, label in parts:
        df = df if label is None else df.withColumn("label", F.lit(label))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


#: Bounds of a message's fields: a name for the breach, and the condition of it.
CONTRACT = {
    "subject_too_long": "length(subject) > 2000",
    "body_too_long": "length(body) > 200000",
    "sender_too_long": "length(sender) > 512",
    "bad_spf": "spf is not null and spf not in ('pass', 'fail', 'softfail', 'neutral', 'none')",
    "bad_dmarc": "dmarc is not null and dmarc not in ('pass', 'fail', 'none')",
    "no_id": "message_id is null",
}


def check_contract(rows: DataFrame, contract: dict[str, str] = CONTRACT) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with the names of what they breach)."""
    found = F.array_compact(F.array(*(F.when(F.expr(c), k) for k, c in contract.items())))
    x = rows.withColumn("breaches", found)
    return x.filter("size(breaches) = 0").drop("breaches"), x.filter("size(breaches) > 0")
