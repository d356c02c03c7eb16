"""Queries over rewritten phishing mail, scored by the rules before and after."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators import links, reports, rules
from mailsift.operators import rewrites as R
from mailsift.sources.sinks import shared_folder
from mailsift.sources.tables import mails, spread, table, view

from .catalogue import CONTROLS, query
from .mail import rule_table


def phishing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages labelled as the class to find, their links in the body."""
    labels = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("message_id"))
    urls = view(spark, sf_dir, "fx_links").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.array_agg(F.struct("pos", "href"))), lambda x: x["href"]), "\n").alias("_links"))  # two a message
    x = mails(spark, sf_dir).join(labels, "message_id").join(urls, "message_id", "left")
    return x.withColumn("body", F.concat_ws("\n\n", "body", "_links")).drop("_links")


def scores(messages: DataFrame, id: str) -> DataFrame:
    """(id, score) by the rules, links taken from the messages themselves."""
    both = messages.withColumn("_both", F.concat_ws("\n", "html", "body"))
    found = links.extract(both, id, "_both", None)
    return rules.rule_score(rule_table(messages, found, id), id).select(id, "score")


_SCORED: dict[tuple[str, str], str] = {}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, rewrite, score) of a folder's phishing messages, as they are ('') and rewritten.

    Written once for a session and folder: the rewritten messages first, since links and features both read them, then their scores.
    """
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _SCORED:
        path = f"{shared_folder(spark)}/rewrites-{uuid.uuid4().hex}"
        own = phishing(spark, sf_dir)
        both = R.rewritten(own).unionByName(own.withColumn("rewrite", F.lit("")))
        both.withColumn("_id", F.concat_ws("|", F.col("message_id").cast("string"), "rewrite")).write.parquet(f"{path}/mails")
        found = scores(spread(spark.read.parquet(f"{path}/mails")), "_id")
        found.select(F.substring_index("_id", "|", 1).cast("long").alias("message_id"), F.substring_index("_id", "|", -1).alias("rewrite"), "score").write.parquet(f"{path}/scores")
        _SCORED[key] = path
    return spark.read.parquet(f"{_SCORED[key]}/scores")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scored(spark, sf_dir)
    return R.paired(x.filter("rewrite = ''"), x.filter("rewrite <> ''"))


@query("transform_sweep")
def _(spark, d):
    return R.sweep(pairs(spark, d), scored(spark, d).filter("rewrite = ''").count())


@query("robustness_register")
def _(spark, d):
    return reports.risk_register(R.worst_by_family(pairs(spark, d)), CONTROLS)


@query("perturbed_messages")
def _(spark, d):
    x = R.perturbed(phishing(spark, d), copies=2)
    return x.select("message_id", "copy", F.concat_ws(",", "rewrites").alias("rewrites"), F.sha2(F.concat_ws("\x1f", "subject", "body", "html", "sender", "reply_to"), 256).alias("sha256"))
