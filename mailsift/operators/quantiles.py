"""Running totals over ordered values, and exact quantiles, without a task that holds all values.

Values are counted first, so each stands once. A sample of them by their hashes (one for each of
``SAMPLE`` classes of hashes, the same at each run) cuts a group's values into steps of about equal
numbers, however they are spread; the steps' totals (``SAMPLE`` + 1 rows a group) are added up in
order, and each step's values in a window of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 128


def cumulated(each: DataFrame, value: str, sums: tuple[str, ...], by: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """each with, for every name in ``sums``, ``<name>_all``, its total over the group, and ``<name>_upto``, that of the values up to and with the row's own (from the largest one, if descending).

    ``each`` has one row a group and value; rows without a value or with a null in ``by`` go.
    """
    h, v = F.xxhash64(value), F.col(value)
    own = each.filter(v.isNotNull()).select(*by, F.pmod(h, F.lit(SAMPLE)).alias("_class"), F.struct(h.alias("h"), v.alias("v")).alias("_s"), *sums)
    cuts = own.groupBy(*by, "_class").agg(F.min("_s").alias("_s"), *(F.sum(c).alias(c) for c in sums))
    cuts = cuts.groupBy(*by).agg(F.array_sort(F.array_agg("_s.v")).alias("_cuts"), *(F.sum(c).alias(f"{c}_all") for c in sums))
    x = each.join(cuts, list(by)) if by else each.join(F.broadcast(cuts), F.lit(True))
    x = x.filter(v.isNotNull()).withColumn("_step", F.size(F.filter("_cuts", lambda c: c <= v))).drop("_cuts")
    turn = F.desc if descending else F.asc
    before = Window.partitionBy(*by).orderBy(turn("_step")).rowsBetween(Window.unboundedPreceding, -1)
    steps = x.groupBy(*by, "_step").agg(*(F.sum(c).alias(f"_s_{c}") for c in sums))
    steps = steps.select(*by, "_step", *(F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums))
    inside = Window.partitionBy(*by, "_step").orderBy(turn(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({f"_i_{c}": F.sum(c).over(inside) for c in sums}).join(steps if by else F.broadcast(steps), [*by, "_step"])
    return x.select(*each.columns, *(f"{c}_all" for c in sums), *((F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(f"{c}_upto") for c in sums))


def quantiles(rows: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = (), discrete: bool = False) -> DataFrame:
    """(by, q): one row a group with an array of quantiles, linear between neighbours, or (discrete) the least value that reaches the share."""
    x = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    x = cumulated(x, "_v", ("_n",), by).withColumnsRenamed({"_n_all": "_all", "_n_upto": "_upto"}).withColumn("_from", F.col("_upto") - F.col("_n"))

    def at(rank):
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_upto")), F.col("_v")))

    found = []
    for q in shares:
        if discrete:
            found.append(at(F.greatest(F.ceil(F.col("_all") * F.lit(q)) - 1, F.lit(0))))
            continue
        rank = (F.col("_all") - 1) * F.lit(q)
        low = F.floor(rank)
        a, b, part = at(low).cast("double"), at(F.ceil(rank)).cast("double"), F.max(rank - low)
        found.append(a + part * (b - a))
    return x.groupBy(*by).agg(F.array(*found).alias("q"))
