"""Sender history of messages, from the mail log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cumulated

HOUR = 3600


def prior_messages(log: DataFrame) -> DataFrame:
    """Messages of the same sender to the same recipient strictly before each one, and whether there are none."""
    before = Window.partitionBy("sender", "recipient").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    x = log.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return x.select("msg_id", F.count(F.lit(1)).over(before).alias("prior_messages")).withColumn("first_seen", F.col("prior_messages") == 0)


def prior_replies(log: DataFrame) -> DataFrame:
    """Messages from the recipient to the sender strictly before each one.

    A message is an event of its own pair and a reply event of the mirrored pair; one window over
    both kinds counts replies without a range join.
    """
    x = log.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    own = x.select("msg_id", F.col("sender").alias("a"), F.col("recipient").alias("b"), "t", F.lit(0).alias("reply"))
    back = x.select(F.lit(None).cast("long").alias("msg_id"), F.col("recipient").alias("a"), F.col("sender").alias("b"), "t", F.lit(1).alias("reply"))
    before = Window.partitionBy("a", "b").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(back).withColumn("prior_replies", F.coalesce(F.sum("reply").over(before), F.lit(0)))
    return both.filter("msg_id is not null").select("msg_id", "prior_replies")


def burst_1h(log: DataFrame) -> DataFrame:
    """Messages of the sender's domain in the hour up to each one, itself included.

    Each message stands in its own hour's bucket and the next one's, so a busy domain is cut by time
    into windows of two hours.
    """
    x = log.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("h", F.floor(F.col("t") / (HOUR * 1_000_000)))
    x = x.select("msg_id", "sender_domain", "t", "h", F.explode(F.array(F.col("h"), F.col("h") + 1)).alias("bucket"))
    last = Window.partitionBy("sender_domain", "bucket").orderBy("t").rangeBetween(-HOUR * 1_000_000, Window.currentRow)
    return x.withColumn("burst_count_1h", F.count(F.lit(1)).over(last)).filter("bucket = h").select("msg_id", "burst_count_1h")


def alias_counts(log: DataFrame) -> DataFrame:
    """Distinct senders behind each display name."""
    return log.groupBy("display_name").agg(F.countDistinct("sender").alias("display_name_alias_count"))


def running_aliases(log: DataFrame) -> DataFrame:
    """Distinct senders seen behind a message's display name up to it: first messages of a (name, sender), added up over time.

    A message looks its own time up among its name's running totals, so neither many senders of a name nor many messages of it meet each other.
    Messages without a name or a time have seen nobody; a null sender is nobody.
    """
    x = log.select("msg_id", "display_name", "sender", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    seen = x.filter("display_name is not null and t is not null")
    first = seen.groupBy("display_name", "sender").agg(F.min("t").alias("t"), F.first(F.col("sender").isNotNull().cast("long")).alias("n"))
    each = first.select("display_name", "t", "n").unionByName(seen.select("display_name", "t", F.lit(0).cast("long").alias("n"))).groupBy("display_name", "t").agg(F.sum("n").alias("n"))
    upto = cumulated(each, "t", ("n",), ("display_name",)).select("display_name", "t", "n_upto")
    return x.join(upto, ["display_name", "t"], "left").select("msg_id", F.coalesce("n_upto", F.lit(0)).alias("display_name_alias_count"))


def domain_age(log: DataFrame) -> DataFrame:
    """Days from the first message of the sender's domain to each message."""
    first = log.groupBy("sender_domain").agg(F.min("ts").alias("first_ts"))
    days = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("first_ts").cast("timestamp"))) / 86_400_000_000)
    return log.join(first, "sender_domain").select("msg_id", days.cast("long").alias("domain_age_days"))


def local_time(log: DataFrame) -> DataFrame:
    """Hour of day, off-hours and weekend flags."""
    hour = F.hour("ts")
    return log.select("msg_id", hour.alias("hour_local"), ((hour < 7) | (hour >= 21)).alias("off_hours"), F.dayofweek("ts").isin(1, 7).alias("is_weekend"))


def domain_reports(log: DataFrame) -> DataFrame:
    """Reports (event type error) filed on the sender's domain before each message, and its click share until then."""
    x = log.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    x = x.withColumns({"h": F.floor(F.col("t") / (HOUR * 1_000_000)), "rep": (F.col("event_type") == "error").cast("long"), "clk": (F.col("event_type") == "click").cast("long"), "n": F.lit(1).cast("long")})
    # Each domain's events are summed by hour first; a window over hours, then one inside each hour.
    hours = x.groupBy("sender_domain", "h").agg(*(F.sum(k).alias(k) for k in ("rep", "clk", "n")))
    upto = Window.partitionBy("sender_domain").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    earlier = hours.select("sender_domain", "h", *(F.coalesce(F.sum(k).over(upto), F.lit(0)).alias(f"{k}_before") for k in ("rep", "clk", "n")))
    inside = Window.partitionBy("sender_domain", "h").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"{k}_in": F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in ("rep", "clk", "n")}).join(earlier, ["sender_domain", "h"])
    total = {k: F.col(f"{k}_in") + F.col(f"{k}_before") for k in ("rep", "clk", "n")}
    rate = F.round(F.when(total["n"] > 0, total["clk"] / total["n"]).otherwise(0.0), 6)
    return x.select("msg_id", total["rep"].alias("domain_report_count"), rate.alias("domain_click_rate"))


def thread_depth(conversations: DataFrame) -> DataFrame:
    """Turns before each message of its conversation."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.select("conv_id", "turn", (F.row_number().over(by) - 1).alias("thread_depth"))


#: What a message's context may hold, and its value where nothing is known.
CONTEXT = {
    "available": "false", "first_seen": "false", "prior_messages": "0", "prior_replies": "0", "thread_depth": "0", "hour_local": "12", "is_weekend": "false", "bcc_count": "0", "recipient_count": "1",
    "external_sender": "false", "domain_report_count": "0", "domain_click_rate": "0D", "burst_count_1h": "1", "display_name_alias_count": "1", "domain_age_days": "0",
}


def context(df: DataFrame, among: dict[str, str] = CONTEXT) -> dict[str, Column]:
    """Context columns of df, with defaults for those that are missing or null."""
    return {k: F.coalesce(F.col(k), F.expr(d)) if k in df.columns else F.expr(d) for k, d in among.items()}


def features(c: dict[str, Column], financial: Column, ask: Column, urgent: Column) -> dict[str, Column]:
    """The behavioural columns of a message in its context; ask and urgent are what its text asks for.

    Interactions bind what a text says to a history that its writer cannot rewrite.
    """
    flag = lambda x: x.cast("double")
    least = lambda x, n=0: F.greatest(x, F.lit(n)).cast("double")
    part = lambda x, n: F.least(x / n, F.lit(1.0))
    known = c["available"].cast("boolean")
    prior, replies, reports = least(c["prior_messages"]), least(c["prior_replies"]), least(c["domain_report_count"])
    ratio = F.when(prior > 0, replies / prior).otherwise(0.0)
    bond = F.when(known, 0.6 * (1 - F.exp(-prior / 8)) + 0.4 * F.least(ratio, F.lit(1.0))).otherwise(0.0)
    hour = F.pmod(c["hour_local"].cast("int"), F.lit(24))
    off = flag((hour < 7) | (hour >= 21))
    new = flag(c["first_seen"].cast("boolean") | ~known)
    age, burst, names = least(c["domain_age_days"]), least(c["burst_count_1h"], 1), least(c["display_name_alias_count"], 1)
    young = flag(known & (age < 90))
    to, bcc, depth = least(c["recipient_count"], 1), least(c["bcc_count"]), c["thread_depth"].cast("int")
    outside = flag(c["external_sender"].cast("boolean"))
    deficit = 0.25 * new + 0.25 * young + 0.10 * off + 0.20 * (1 - bond) + 0.20 * part(ask, 6)
    return {
        "beh_context_available": flag(known),
        "beh_sender_first_seen": new,
        "beh_prior_messages": prior,
        "beh_prior_messages_log": F.log1p(prior),
        "beh_prior_replies": replies,
        "beh_reply_ratio": ratio,
        "beh_relationship_strength": bond,
        "beh_thread_depth": least(depth),
        "beh_is_new_thread": flag(depth <= 0),
        "beh_cold_contact_with_ask": new * part(ask, 4),
        "beh_hour_local": hour.cast("double"),
        "beh_off_hours": off,
        "beh_is_weekend": flag(c["is_weekend"].cast("boolean")),
        "beh_odd_hour_and_urgent": off * part(urgent, 3),
        "beh_recipient_count": to,
        "beh_bcc_count": bcc,
        "beh_bcc_ratio": bcc / (to + bcc),
        "beh_mass_mailing": flag((to >= 25) | (bcc >= 25)),
        "beh_external_sender": outside,
        "beh_external_and_financial": outside * part(financial, 4),
        "beh_domain_report_count": reports,
        "beh_domain_reported": flag(reports > 0),
        "beh_domain_click_rate": F.least(F.greatest(c["domain_click_rate"].cast("double"), F.lit(0.0)), F.lit(1.0)),
        "beh_burst_count_1h": burst,
        "beh_burst_log": F.log1p(burst),
        "beh_campaign_shape": F.least(F.log1p(burst) / 4, F.lit(1.0)) * new,
        "beh_display_name_alias_count": names,
        "beh_display_name_reuse": flag(names > 1),
        "beh_domain_age_days": age,
        "beh_domain_age_log": F.log1p(age),
        "beh_young_domain": young,
        "beh_young_domain_and_ask": young * part(ask, 4),
        "beh_trust_deficit": F.round(F.least(F.greatest(deficit, F.lit(0.0)), F.lit(1.0)), 6),
    }


def signals(named: dict[str, Column]) -> tuple[Column, Column, Column]:
    """financial, ask and urgent of a message's text features."""
    c = lambda k: named[k].cast("double")
    financial = c("body_lex_financial")
    return financial, c("body_lex_credential") + financial + c("body_urgency_phrases"), c("subj_urgency_phrases") + c("body_lex_urgency")


def history(log: DataFrame, home: tuple[str, ...] = ()) -> DataFrame:
    """Each message of a log with its context, and the relationship and trust scores made of it.

    The windows follow each other on one table, grouped by what they are partitioned by, so the log is read
    once for itself and once as replies; no table of messages is joined to another by id. Domains in ``home`` are not external.
    """
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    x = log.select("msg_id", "ts", "sender", "recipient", "sender_domain", "display_name", "event_type", t.alias("t"), F.lit(0).alias("reply"))
    back = log.select(F.lit(None).cast("long").alias("msg_id"), F.lit(None).cast(log.schema["ts"].dataType).alias("ts"), F.col("recipient").alias("sender"), F.col("sender").alias("recipient"), F.lit(None).cast("string").alias("sender_domain"), F.lit(None).cast("string").alias("display_name"), F.lit(None).cast("string").alias("event_type"), t.alias("t"), F.lit(1).alias("reply"))
    pair = Window.partitionBy("sender", "recipient").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    x = x.unionByName(back).withColumn("prior_messages", F.coalesce(F.sum(1 - F.col("reply")).over(pair), F.lit(0))).withColumn("prior_replies", F.coalesce(F.sum("reply").over(pair), F.lit(0))).filter("reply = 0")
    # A busy domain is cut into hours; what stands before an hour is added up over the hours.
    hour = HOUR * 1_000_000
    x = x.withColumn("h", F.floor(F.col("t") / hour)).withColumn("rep", (F.col("event_type") == "error").cast("long")).withColumn("clk", (F.col("event_type") == "click").cast("long"))
    per = x.groupBy("sender_domain", "h").agg(F.sum("rep").alias("rep"), F.sum("clk").alias("clk"), F.count(F.lit(1)).alias("n"), F.min("t").alias("first"))
    upto = Window.partitionBy("sender_domain").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda v: F.coalesce(v, F.lit(0))
    per = per.select("sender_domain", "h", *(zero(F.sum(k).over(upto)).alias(f"{k}_before") for k in ("rep", "clk", "n")), F.least("first", F.min("first").over(upto)).alias("domain_first"))
    x = x.join(per, ["sender_domain", "h"])
    inside = Window.partitionBy("sender_domain", "h").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    x = x.withColumns({f"{k}_in": zero(F.sum(k).over(inside)) for k in ("rep", "clk")} | {"n_in": zero(F.count(F.lit(1)).over(inside))})
    seen = F.col("n_before") + F.col("n_in")
    x = x.withColumns({
        "domain_report_count": F.col("rep_before") + F.col("rep_in"),
        "domain_click_rate": F.round(F.when(seen > 0, (F.col("clk_before") + F.col("clk_in")) / seen).otherwise(0.0), 6),  # of what came before
        "domain_age_days": F.floor((F.col("t") - F.col("domain_first")) / 86_400_000_000).cast("long"),
    })
    both = x.select("*", F.explode(F.array(F.col("h"), F.col("h") + 1)).alias("bucket"))
    last = Window.partitionBy("sender_domain", "bucket").orderBy("t").rangeBetween(-hour, Window.currentRow)
    x = both.withColumn("burst_count_1h", F.count(F.lit(1)).over(last)).filter("bucket = h")
    name = Window.partitionBy("display_name").orderBy("t")
    fresh = (F.row_number().over(Window.partitionBy("display_name", "sender").orderBy("t", "msg_id")) == 1).cast("int")
    x = x.withColumn("fresh", fresh).withColumn("display_name_alias_count", F.sum("fresh").over(name))
    x = x.withColumns({"available": F.lit(True), "first_seen": F.col("prior_messages") == 0, "hour_local": F.hour("ts"), "is_weekend": F.dayofweek("ts").isin(1, 7), "external_sender": ~F.col("sender_domain").isin(*home) if home else F.lit(True)})
    none = F.lit(0.0)
    out = features(context(x), none, none, none)
    named = {"relationship_strength": "beh_relationship_strength", "campaign_shape": "beh_campaign_shape", "trust_deficit": "beh_trust_deficit"}
    kept = [k for k in CONTEXT if k in x.columns]
    return x.select("msg_id", *kept, *(F.round(out[v], 6).alias(k) for k, v in named.items()))
