"""Drift thresholds from the reference itself: how far stable windows made of whole groups lie from the rest.

Each round draws whole groups by a hash until one window is full, cuts bins at the quantiles of all
other rows, and keeps the largest PSI of all quantities. Thresholds are percentiles of that.

No round sorts the reference. Each distinct value has its place in the order of all rows, worked out
once; taking the held rows out moves a rank by the held rows before it, so a round's quantiles need
the held rows alone, and a look-up of a bounded number of places (18 a round and quantity).
A round costs the rows that it holds; the reference is read for counts only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.sources.sinks import shared_folder

from .drift import FLOOR, MAJOR, MINOR
from .quantiles import cumulated

ROUNDS, BINS, LEAST_ROUNDS, LEAST_REST, CLASSES, BLOCKS = 400, 10, 20, 30, 1024, 4096


def held_groups(sizes: DataFrame, window: int, rounds: int = ROUNDS, seed: int = 0) -> DataFrame:
    """(round, g, size, before): the groups of each round, in its order, up to the one that fills the window; sizes has (g, size).

    A round's order is that of a hash's class, the hash and the group. Classes are added up first, so
    only the groups of the few classes that are needed stand in a window of a round.
    """
    h = F.xxhash64(F.lit(seed), "round", "g")
    drawn = sizes.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("h", h).withColumn("class", F.pmod("h", F.lit(CLASSES)))
    up = Window.partitionBy("round").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    classes = drawn.groupBy("round", "class").agg(F.sum("size").alias("s")).select("round", "class", F.coalesce(F.sum("s").over(up), F.lit(0)).alias("base"))
    classes = classes.filter(F.col("base") < window)  # at most rounds * CLASSES rows
    inside = Window.partitionBy("round", "class").orderBy("h", "g").rowsBetween(Window.unboundedPreceding, -1)
    x = drawn.join(F.broadcast(classes), ["round", "class"])
    x = x.withColumn("before", F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return x.filter(F.col("before") < window).select("round", "g", "size", "before")


def _psi(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """rows with psi, of two arrays of counts; shares are floored and made to add up again."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    for c in (expected, actual):
        rows = rows.withColumn("_t", total(c)).withColumn(c, F.transform(c, lambda v: F.greatest(v / F.col("_t"), F.lit(FLOOR))))
        rows = rows.withColumn("_t", total(c)).withColumn(c, F.transform(c, lambda v: v / F.col("_t")))
    return rows.withColumn("psi", total(F.zip_with(expected, actual, lambda e, a: (a - e) * F.ln(a / e)))).drop("_t")


def worst_psi(rows: DataFrame, group: str, names: tuple[str, ...], window: int, rounds: int = ROUNDS, seed: int = 0, id: str = "decision_id") -> DataFrame:
    """(round, worst): each usable round's largest PSI over the quantities ``names``.

    A row without a group is a group of its own. Of the last group drawn, only a share fits the window:
    its rows count by that share. A row without a value leaves that quantity alone. Rounds that can't
    fill the window, or leave fewer rows than half of it or 30, are left out.
    """
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/drift-null-{uuid.uuid4().hex}"

    def written(x: DataFrame, name: str) -> DataFrame:
        x.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    g = F.coalesce(F.concat(F.lit("group:"), F.col(group).cast("string")), F.concat(F.lit("row:"), F.col(id).cast("string")))
    own = rows.select(g.alias("g"), *(F.col(q).cast("double").alias(q) for q in names))
    long = own.select("g", F.explode(F.array(*(F.struct(F.lit(q).alias("quantity"), F.col(q).alias("value")) for q in names))).alias("x")).select("g", "x.*").filter("value is not null")
    cells = written(long.groupBy("g", "quantity", "value").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = written(own.groupBy("g").agg(F.count(F.lit(1)).alias("size")), "sizes")
    places = cumulated(cells.groupBy("quantity", "value").agg(F.sum("n").alias("n")), "value", ("n",), ("quantity",))
    places = written(places.select("quantity", "value", (F.col("n_upto") - F.col("n")).alias("start"), F.col("n_upto").alias("stop"), "n_all"), "places")

    held = written(held_groups(sizes, window, rounds, seed), "held")
    everything = sizes.agg(F.sum("size").alias("total"))
    usable = held.groupBy("round").agg(F.sum("size").alias("taken")).join(F.broadcast(everything), F.lit(True))
    usable = usable.filter((F.col("taken") >= window) & (F.col("total") - F.col("taken") >= max(LEAST_REST, window // 2))).select("round")
    part = F.least(F.lit(1.0), (F.lit(window) - F.col("before")) / F.col("size"))
    drawn = held.join(F.broadcast(usable), "round").select("round", "g", part.alias("part"))
    # Held rows by round and value: h of them are taken out, w of them are the window.
    taken = cells.join(drawn, "g").groupBy("round", "quantity", "value").agg(F.sum("n").alias("h"), F.sum(F.col("n") * F.col("part")).alias("w"))
    up = Window.partitionBy("round", "quantity").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    taken = taken.join(places, ["quantity", "value"]).withColumn("key", F.col("start") - F.coalesce(F.sum("h").over(up), F.lit(0)))
    taken = written(taken.select("round", "quantity", "value", "h", "w", "key", "n_all"), "taken")

    # Ranks of the inner quantiles among the rows that stay, and where those stand among all rows.
    inner = range(1, BINS)
    rest = taken.groupBy("round", "quantity").agg((F.max("n_all") - F.sum("h")).alias("rest")).filter("rest > 0")
    low = {k: F.floor((F.col("rest") - 1) * k / BINS).cast("long") for k in inner}
    high = {k: low[k] + (((F.col("rest") - 1) * k % BINS) > 0).cast("long") for k in inner}
    moved = lambda r: (r + F.sum(F.when(F.col("key") <= r, F.col("h")).otherwise(0)))
    x = taken.join(F.broadcast(rest), ["round", "quantity"])
    ranks = x.select("round", "quantity", "rest", "key", "h", *(low[k].alias(f"l{k}") for k in inner), *(high[k].alias(f"u{k}") for k in inner))
    keys = ["round", "quantity", "rest", *(f"{c}{k}" for c in "lu" for k in inner)]
    at = ranks.groupBy(*keys).agg(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"l{k}").alias("low"), moved(F.col(f"l{k}")).alias("a"), moved(F.col(f"u{k}")).alias("b")) for k in inner)).alias("at"))
    at = written(at.select("round", "quantity", "rest", F.explode("at").alias("x")).select("round", "quantity", "rest", "x.*"), "at")  # at most 9 a round and quantity

    wide = F.greatest(F.lit(1), F.ceil(F.col("n_all") / BLOCKS)).cast("long")
    asked = at.select("quantity", F.explode(F.array("a", "b")).alias("place")).distinct()
    blocks = F.sequence(F.expr("start div wide"), F.expr("(stop - 1) div wide"))
    width = places.select("quantity", wide.alias("wide")).distinct()
    asked = asked.join(F.broadcast(width), "quantity").withColumn("block", F.expr("place div wide")).drop("wide")
    found = places.withColumn("wide", wide).withColumn("block", F.explode(blocks)).join(F.broadcast(asked), ["quantity", "block"])
    found = written(found.filter((F.col("start") <= F.col("place")) & (F.col("place") < F.col("stop"))).select("quantity", "place", "value", "start"), "found")
    a, b = found.select("quantity", F.col("place").alias("a"), F.col("value").alias("va"), "start"), found.select("quantity", F.col("place").alias("b"), F.col("value").alias("vb"))
    step = ((F.col("rest") - 1) * F.col("k") % BINS) / F.lit(float(BINS))
    edge = F.when((step == 0) | (F.col("va") == F.col("vb")), F.col("va")).otherwise(F.col("va") + step * (F.col("vb") - F.col("va")))
    edges = at.join(F.broadcast(a), ["quantity", "a"]).join(F.broadcast(b), ["quantity", "b"]).withColumn("e", edge)
    # Rows that stay below an edge between two of them are those up to the lower one; an edge on a value has all below that value but the held.
    edges = edges.groupBy("round", "quantity", "rest", "e").agg(F.max(F.when(F.col("e") > F.col("va"), F.col("low") + 1)).alias("under"), F.max(F.when(F.col("e") == F.col("va"), F.col("start"))).alias("start"))
    edges = edges.groupBy("round", "quantity", "rest").agg(F.array_sort(F.collect_list(F.struct("e", "under", "start"))).alias("edges"))

    bin_ = F.size(F.filter("edges", lambda s: s["e"] <= F.col("value")))
    y = taken.join(F.broadcast(edges), ["round", "quantity"]).select("round", "quantity", "rest", "edges", "h", "w", bin_.alias("bin"))
    each = [F.array(*(F.sum(F.when(F.col("bin") == j, F.col(c)).otherwise(0)).cast("double") for j in range(BINS))).alias(c) for c in "hw"]
    y = y.groupBy("round", "quantity", "rest", "edges").agg(*each)
    gone = F.aggregate(F.slice("h", F.lit(1), F.col("j") + 1), F.lit(0.0), lambda s, v: s + v)
    below = F.coalesce(F.col("x.under"), F.col("x.start") - gone)
    under = y.select("round", "quantity", "rest", "w", "h", F.posexplode("edges").alias("j", "x")).select("round", "quantity", "rest", "w", "j", below.alias("below"))
    under = under.groupBy("round", "quantity", "rest", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "below"))), lambda s: s["below"]).alias("under"))
    under = under.withColumn("under", F.concat(F.array(F.lit(0.0)), "under", F.array(F.col("rest").cast("double"))))
    expected = F.zip_with(F.slice("under", F.lit(2), F.size("under") - 1), F.slice("under", F.lit(1), F.size("under") - 1), lambda hi, lo: hi - lo)
    x = under.select("round", expected.alias("e"), F.slice("w", F.lit(1), F.size("under") - 1).alias("a"))
    return _psi(x, "e", "a").groupBy("round").agg(F.max("psi").alias("worst"))


def null_thresholds(rows: DataFrame, group: str, names: tuple[str, ...], window: int, rounds: int = ROUNDS, seed: int = 0, id: str = "decision_id") -> DataFrame:
    """One row (moderate, significant, null_median, rounds, calibrated): the 95th and 99th percentile of the rounds' worst PSI, never below the common bounds; those alone where fewer than 20 rounds are usable."""
    x = worst_psi(rows, group, names, window, rounds, seed, id).agg(F.count(F.lit(1)).alias("rounds"), *(F.expr(f"percentile(worst, {q})").alias(c) for q, c in ((0.95, "a"), (0.99, "b"), (0.5, "m"))))
    enough = F.col("rounds") >= LEAST_ROUNDS
    at = lambda c, least: F.round(F.when(enough, F.greatest(F.col(c), F.lit(least))).otherwise(least), 4)
    return x.select(at("a", MINOR).alias("moderate"), at("b", MAJOR).alias("significant"), F.when(enough, F.round("m", 4)).alias("null_median"), "rounds", enough.alias("calibrated"))
