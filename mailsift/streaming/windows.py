"""Windowed monitoring of decisions, the same for tables and streams.

Each function takes a batch or streaming DataFrame of decisions with an event time and returns
the same columns either way; on a stream the watermark bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WATERMARK = "1 hour"


def timed(decisions: DataFrame, time: str = "created_ts", watermark: str = WATERMARK) -> DataFrame:
    """decisions with the event time t; streams get a watermark."""
    x = decisions.withColumn("t", F.col(time).cast("timestamp"))
    return x.withWatermark("t", watermark) if decisions.isStreaming else x


def band_ratios(decisions: DataFrame, size: str = "30 minutes") -> DataFrame:
    """Shares of bands and of missing context over tumbling windows."""
    n = F.count(F.lit(1))
    share = lambda c, name: F.round(F.count_if(c) / n, 6).alias(name)
    x = timed(decisions).groupBy(F.window("t", size).alias("w")).agg(n.alias("n"), share(F.col("band") == "BLOCK", "block_share"), share(F.col("band") == "REVIEW", "review_share"), share(F.col("behavioral_available") == 0, "blind_share"))
    return x.select(F.col("w.start").alias("window_start"), "n", "block_share", "review_share", "blind_share")


def latency_windows(decisions: DataFrame, size: str = "5 minutes", limit: float = 150.0, edges: tuple[float, ...] = (5, 10, 25, 50, 75, 100, 150, 250, 500, 1000)) -> DataFrame:
    """The 95th percentile of latency over tumbling windows, interpolated in fixed buckets, and whether it is too long."""
    low = (0.0, *edges)
    counts = [F.count_if(F.col("latency_ms") <= e).alias(f"le_{i}") for i, e in enumerate(edges)]
    x = timed(decisions).groupBy(F.window("t", size).alias("w")).agg(F.count(F.lit(1)).alias("n"), *counts)
    p95 = F.lit(float(edges[-1]))
    for i in reversed(range(len(edges))):
        under = F.col(f"le_{i - 1}") if i else F.lit(0)
        inside = F.nullif(F.col(f"le_{i}") - under, F.lit(0))
        p95 = F.when(F.col(f"le_{i}") >= 0.95 * F.col("n"), low[i] + (edges[i] - low[i]) * (0.95 * F.col("n") - under) / inside).otherwise(p95)
    return x.select(F.col("w.start").alias("window_start"), "n", F.round(p95, 6).alias("p95_ms"), (p95 > limit).alias("slow"))


def counters(decisions: DataFrame, size: str = "1 hour") -> DataFrame:
    """Decisions by window, band and event type."""
    x = timed(decisions).groupBy(F.window("t", size).alias("w"), "band", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("w.start").alias("window_start"), "band", "event_type", "n")


def domain_bursts(log: DataFrame, size: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    """Messages of each sender domain over sliding windows."""
    x = timed(log, "ts").groupBy(F.window("t", size, slide).alias("w"), "sender_domain").agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("w.start").alias("window_start"), "sender_domain", "n")


def user_sessions(log: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Sessions of each sender: closed by a gap without messages."""
    x = timed(log, "ts").groupBy(F.session_window("t", gap).alias("w"), "sender").agg(F.count(F.lit(1)).alias("n"))
    return x.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "sender", "n")


def alerts_for(windows: DataFrame, condition: str, windows_held: int, size_seconds: int) -> DataFrame:
    """Windows at which a condition has held for so many windows in a row (batch).

    A run ends where the condition fails or a window is missing; each day is a partition, with the
    windows before its start that a run can reach into.
    """
    x = windows.withColumn("s", F.unix_timestamp("window_start")).withColumn("bad", F.expr(condition).cast("int"))
    x = x.withColumn("day", F.floor(F.col("s") / 86400))
    reach = windows_held * size_seconds
    x = x.select("*", F.explode(F.sequence("day", F.floor((F.col("s") + reach) / 86400))).alias("part"))
    held = Window.partitionBy("part").orderBy("s").rangeBetween(-(windows_held - 1) * size_seconds, 0)
    x = x.withColumn("held", F.sum("bad").over(held)).filter("part = day")
    return x.filter(F.col("held") == windows_held).select("window_start", "n")
