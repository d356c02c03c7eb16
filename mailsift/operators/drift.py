"""Drift monitoring: binned and rank distances between a reference and live rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import cumulated, quantiles

QUANTITIES = ("score", "latency_ms", "log_body_length", "recipient_count", "attachment_count", "behavioral_available")
FLOOR, MINOR, MAJOR = 1e-4, 0.10, 0.25


def monitored(decisions: DataFrame, *more: str) -> DataFrame:
    """The monitored quantities of each decision, as doubles, with further columns as they are."""
    return decisions.withColumn("log_body_length", F.log1p("body_length")).select("decision_id", "created_ts", *more, *(F.col(q).cast("double").alias(q) for q in QUANTITIES))


def long(rows: DataFrame) -> DataFrame:
    """(created_ts, quantity, value): one row for each quantity."""
    return rows.select("created_ts", F.explode(F.array(*(F.struct(F.lit(q).alias("quantity"), F.col(q).alias("value")) for q in QUANTITIES))).alias("x")).select("created_ts", "x.*").filter("value is not null")


def edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """Inner quantile edges of each quantity: linear interpolation, distinct, in order."""
    q = quantiles(reference, "value", tuple(i / bins for i in range(1, bins)), ("quantity",))
    return q.select("quantity", F.array_sort(F.array_distinct("q")).alias("edges"))


def binned(rows: DataFrame, edges_: DataFrame, *by: str) -> DataFrame:
    """Rows of each left-closed bin."""
    at = F.size(F.filter("edges", lambda e: e <= F.col("value")))
    return rows.join(F.broadcast(edges_), "quantity").groupBy(*by, "quantity", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def psi(reference: DataFrame, live: DataFrame, *by: str) -> DataFrame:
    """Population stability index of each quantity, with shares floored and made to add up again."""
    e = edges(reference)
    grid = e.select("quantity", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    expected, actual = binned(reference, e), binned(live, e, *by)
    keys = actual.select(*by, "quantity").distinct()
    x = keys.join(F.broadcast(grid), "quantity").join(F.broadcast(expected.withColumnRenamed("n", "e")), ["quantity", "bin"], "left").join(actual.withColumnRenamed("n", "a"), [*by, "quantity", "bin"], "left").na.fill(0, ["e", "a"])
    by_all = Window.partitionBy(*by, "quantity")

    def share(c: str) -> Column:
        return F.greatest(F.col(c) / F.sum(c).over(by_all), F.lit(FLOOR))

    x = x.withColumn("pe", share("e")).withColumn("pa", share("a"))
    x = x.withColumn("pe", F.col("pe") / F.sum("pe").over(by_all)).withColumn("pa", F.col("pa") / F.sum("pa").over(by_all))
    out = x.groupBy(*by, "quantity").agg(F.round(F.sum((F.col("pa") - F.col("pe")) * F.ln(F.col("pa") / F.col("pe"))), 6).alias("psi"), F.sum("a").alias("n"))
    return out.withColumn("severity", F.when(F.col("psi") >= MAJOR, "significant").when(F.col("psi") >= MINOR, "moderate").otherwise("stable"))


def ks(reference: DataFrame, live: DataFrame) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic and its asymptotic p-value, over the values as they are.

    Quantities that one of the two sides lacks have neither.
    """
    both = reference.select("quantity", "value", F.lit(1).alias("r"), F.lit(0).alias("l")).unionByName(live.select("quantity", "value", F.lit(0).alias("r"), F.lit(1).alias("l")))
    each = both.groupBy("quantity", "value").agg(F.sum("r").alias("r"), F.sum("l").alias("l"))
    n, m = F.nullif("r_all", F.lit(0)), F.nullif("l_all", F.lit(0))
    gap = F.abs(F.col("r_upto") / n - F.col("l_upto") / m)
    x = cumulated(each, "value", ("r", "l"), ("quantity",)).groupBy("quantity", n.alias("n"), m.alias("m")).agg(F.max(gap).alias("d"))
    t = F.col("d") * F.sqrt(F.col("n") * F.col("m") / (F.col("n") + F.col("m")))
    series = reduce(lambda a, b: a + b, [2.0 * (-1) ** (k - 1) * F.exp(-2.0 * k * k * t * t) for k in range(1, 26)])
    return x.select("quantity", F.round("d", 6).alias("ks"), F.round(F.least(F.greatest(F.when(t < 0.2, 1.0).otherwise(series), F.lit(0.0)), F.lit(1.0)), 6).alias("p_value"))


def split_by_time(decisions: DataFrame, share: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Reference rows before the point of time that ``share`` of all rows precede, and live rows from it on."""
    rows = monitored(decisions).withColumn("s", F.unix_micros(F.col("created_ts").cast("timestamp")))
    at = quantiles(rows, "s", (share,), discrete=True).first()  # one number, so that neither side's plan holds the search for it
    at = F.lit(None if at is None else at.q[0]).cast("long")
    return long(rows.filter(F.col("s") < at)), long(rows.filter(F.col("s") >= at))


def weekly(decisions: DataFrame) -> DataFrame:
    """PSI of each quantity by week, against the first half of the rows."""
    reference, live = split_by_time(decisions)
    return psi(reference, live.withColumn("week", F.to_date(F.date_trunc("week", "created_ts"))), "week")


def time_series(decisions: DataFrame, unit: str = "day") -> DataFrame:
    """Volumes, mean score, band shares and latency by unit of time."""
    day = F.to_date(F.date_trunc(unit, "created_ts"))
    share = lambda b: F.round(F.avg((F.col("band") == b).cast("double")), 6).alias(f"{b.lower()}_share")
    x = decisions.withColumn("day", day)
    late = quantiles(x, "latency_ms", (0.95,), ("day",)).select("day", F.round(F.col("q")[0], 6).alias("p95_ms"))
    return x.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"), *(share(b) for b in ("ALLOW", "REVIEW", "BLOCK"))).join(F.broadcast(late), "day", "left")
