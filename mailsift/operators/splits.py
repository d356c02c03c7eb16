"""Splits of whole groups that fill quotas of rows, in an order drawn by a seed.

Groups are counted first; only groups are ordered, by running totals that no task holds whole. What
comes to the driver is one row a class and step. Rows without a group are groups of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.sources.sinks import shared_folder

from .quantiles import cumulated


def _keyed(rows: DataFrame, group: str, id: str, seed: str) -> DataFrame:
    """rows with _g, their group, and _k, its place in the order of the seed."""
    g = F.coalesce(F.concat(F.lit("group:"), F.col(group).cast("string")), F.concat(F.lit("row:"), F.col(id).cast("string")))
    return rows.withColumn("_g", g).withColumn("_k", F.md5(F.concat(F.lit(f"{seed}|"), "_g")))


def _written(x: DataFrame) -> DataFrame:
    path = f"{shared_folder(x.sparkSession)}/groups-{uuid.uuid4().hex}"
    x.write.parquet(path)
    return x.sparkSession.read.parquet(path)


def quota_split(rows: DataFrame, group: str, label: str, share: float = 0.25, seed: str = "split", id: str = "message_id") -> DataFrame:
    """Adds part: of each class's groups, test takes ``share`` of the rows, greedily in the order of the seed.

    A group belongs to the class of most of its rows with a label (1 where they are equal; groups without labels
    are a class of their own). A group that would pass the quota by more than half its size is skipped, and
    smaller ones after it may still fit. Since room only shrinks, a group too large for the room at hand
    is too large for good: each step takes all groups that fit up to the first that no longer does, so a step
    is one running total, and steps end when nothing fits.
    """
    x = _keyed(rows, group, id, seed)
    votes = 2 * F.count_if(F.col(label) == 1) >= F.count(label)
    sizes = _written(x.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(label) == 0, -1).otherwise(votes.cast("int")).alias("class")))
    # In halves of rows, so that nothing is rounded: a group of n fits where 2 * taken + n <= 2 * quota.
    state = {r["class"]: ("", 0, int(2 * share * r.n)) for r in sizes.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    steps = []
    while state:
        at = lambda i: F.element_at(F.create_map(*(F.lit(v) for c, s in state.items() for v in (c, s[i]))), F.col("class"))  # noqa: B023, E731
        fit = sizes.filter(F.col("class").isin(*state)).filter((F.col("_k") > at(0)) & (2 * at(1) + F.col("n") <= at(2)))
        run = cumulated(fit, "_k", ("n",), ("class",))
        over = 2 * (at(1) + F.col("n_upto")) - F.col("n") > at(2)
        found = run.groupBy("class").agg(F.min(F.when(over, F.struct("_k", (F.col("n_upto") - F.col("n")).alias("sum")))).alias("stop"), F.max("n_all").alias("all")).collect()
        after = {}
        for r in found:
            low, taken, twice = state[r["class"]]
            steps.append((r["class"], low, r.stop._k if r.stop else None, twice - 2 * taken))
            if r.stop:
                after[r["class"]] = r.stop._k, taken + r.stop.sum, twice
        state = after
    test: Column = F.lit(False)
    for c, low, high, room in steps:
        inside = (F.col("class") == c) & (F.col("_k") > low) & (F.col("n") <= room)
        test = test | (inside if high is None else inside & (F.col("_k") < high))
    parts = sizes.select("_k", F.when(test, "test").otherwise("train").alias("part"))
    return x.join(parts, "_k").drop("_g", "_k")


def filled_pools(rows: DataFrame, group: str, targets: dict[str, int], rest: str = "fit", seed: str = "pools", id: str = "message_id") -> DataFrame:
    """Adds pool: whole groups in the order of the seed fill each pool of ``targets`` until it has its rows, the next one after it; what is left is ``rest``."""
    x = _keyed(rows, group, id, seed)
    sizes = _written(cumulated(x.groupBy("_k").agg(F.count(F.lit(1)).alias("n")), "_k", ("n",)).select("_k", (F.col("n_upto") - F.col("n")).alias("before"), F.col("n_upto").alias("upto")))
    pool, start = F.lit(None).cast("string"), 0
    for name, target in targets.items():
        inside = (F.col("before") >= start) & (F.col("before") < start + target)
        pool = F.when(pool.isNull() & inside, name).otherwise(pool)
        start = sizes.filter(inside).agg(F.max("upto")).first()[0] or start
    return x.join(sizes.select("_k", F.coalesce(pool, F.lit(rest)).alias("pool")), "_k").drop("_g", "_k")
