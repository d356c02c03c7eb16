"""Policies with abstention: rates of every policy of a grid from one count of the scores, priced many times.

A row matters to a policy only by the cells of the grid that its score, its least, second and largest
member and its spread fall into, so rows are counted by these cells first (a bounded table however many
rows there are) and each policy reads the counts. Costs are linear in the rates, so assumptions are
priced by joining small tables to the rate table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import COSTS, GRID, MEMBERS

#: Spreads from which members contradict; 9 is never.
ABSTAIN = (*(round(0.25 + 0.05 * i, 2) for i in range(13)), 9.0)
MISSES, SHARES = (50.0, 100.0, 200.0, 400.0, 800.0, 1600.0), (0.0, 0.05, 0.10, 0.20, 0.30)
KEYS = ("review", "block", "abstain", "mode")
RATES = ("p_allow_phish", "p_review_phish", "p_review_ham", "p_block_ham")


def _cell(value: Column, grid: tuple[float, ...]) -> Column:
    """How many thresholds of the grid a value reaches."""
    return F.expr("0") + sum(((value >= t).cast("int") for t in grid), F.lit(0))


def policies(spark) -> DataFrame:
    """Every pair review <= block with every spread and mode, by value and by cell; without abstention modes are one."""
    rows = [(r, b, a, m, i + 1, j + 1, k + 1) for i, r in enumerate(GRID) for j, b in enumerate(GRID) if b >= r for k, a in enumerate(ABSTAIN) for m in ("symmetric", "escalate") if a <= 1 or m == "symmetric"]
    return spark.createDataFrame(rows, "review double, block double, abstain double, mode string, r int, b int, a int")


def rate_table(scored: DataFrame, members: tuple[str, ...] = MEMBERS) -> DataFrame:
    """Rates of each policy, over ordinary rows and (named hard_...) over those marked ``hard``."""
    given = F.array_sort(F.array(*members))
    x = scored.select("y", "hard", "score", given.alias("m"))
    x = x.select("y", "hard", _cell(F.col("score"), GRID).alias("s"), _cell(F.col("m")[0], GRID).alias("lo"), _cell(F.element_at("m", -2), GRID).alias("second"), _cell(F.element_at("m", -1), GRID).alias("hi"), _cell(F.round(F.element_at("m", -1) - F.col("m")[0], 9), ABSTAIN).alias("w"))
    cells = x.groupBy("s", "lo", "second", "hi", "w", "hard").agg(F.sum((F.col("y") == 1).cast("long")).alias("pos"), F.sum((F.col("y") == 0).cast("long")).alias("neg"))
    every = cells.join(F.broadcast(policies(scored.sparkSession)), F.lit(True))  # a fixed number of policies
    held = (F.col("s") >= F.col("r")) & (F.col("s") < F.col("b"))
    blocked = F.col("s") >= F.col("b")
    moved = (F.col("w") >= F.col("a")) & (F.col("lo") < F.col("r")) & ((F.col("second") >= F.col("r")) | (F.col("hi") >= F.col("b"))) & ~held & ~((F.col("mode") == "escalate") & blocked)
    band = F.when(moved | held, "R").when(blocked, "B").otherwise("A")
    every = every.withColumn("band", band)

    def rate(n: str, b: str, hard: bool) -> Column:
        here = F.col("hard") == hard
        return F.sum(F.when(here & (F.col("band") == b), F.col(n)).otherwise(0)) / F.nullif(F.sum(F.when(here, F.col(n)).otherwise(0)), F.lit(0))

    named = dict(zip(RATES, (("pos", "A"), ("pos", "R"), ("neg", "R"), ("neg", "B")), strict=True))
    return every.groupBy(*KEYS).agg(*(rate(*v, hard).alias(("hard_" if hard else "") + k) for hard in (False, True) for k, v in named.items()))


def _price(miss: Column, share: Column, c: dict[str, float] = COSTS) -> Column:
    mix = {k: (1 - share) * F.col(k) + share * F.col(f"hard_{k}") for k in RATES}
    p, e = c["prevalence"], c["analyst_error"]
    held = p * mix["p_review_phish"] * (c["review"] + e * miss) + (1 - p) * mix["p_review_ham"] * (c["review"] + e * c["false_block"])
    return F.round(1000 * (p * mix["p_allow_phish"] * miss + held + (1 - p) * mix["p_block_ham"] * c["false_block"]), 6)


def priced(rates: DataFrame, miss: float = COSTS["miss"], share: float = 0.10) -> DataFrame:
    """The rate table with the expected cost per 1,000 messages, of which a share of mail is hard."""
    return rates.withColumn("cost", _price(F.lit(miss), F.lit(share))).select(*KEYS, *(F.round(k, 6).alias(k) for k in RATES), "cost")


def _order() -> Column:
    """Ties go to the lower spread, the symmetric mode and the lower thresholds."""
    return F.struct("cost", "abstain", (F.col("mode") != "symmetric").alias("m"), "review", "block", "mode")


def sensitivity(rates: DataFrame, misses: tuple[float, ...] = MISSES, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """The cheapest policy under each cost of a miss and each share of hard mail."""
    asked = rates.sparkSession.createDataFrame([(m, s) for m in misses for s in shares], "miss double, share double")
    x = rates.join(F.broadcast(asked), F.lit(True)).withColumn("cost", _price(F.col("miss"), F.col("share")))
    return x.groupBy("miss", "share").agg(F.min(_order()).alias("p")).select("miss", "share", "p.review", "p.block", "p.abstain", "p.mode", "p.cost")


def break_even(rates: DataFrame, step: float = 0.0025, most: int = 120, miss: float = COSTS["miss"]) -> DataFrame:
    """The least share of hard mail from which abstention pays."""
    shares = rates.sparkSession.range(most + 1).select((F.col("id") * step).alias("share"))
    x = rates.join(F.broadcast(shares), F.lit(True)).withColumn("cost", _price(F.lit(miss), F.col("share")))
    best = x.groupBy("share").agg(F.min("cost").alias("any"), F.min(F.when(F.col("abstain") > 1, F.col("cost"))).alias("off"))
    return best.filter(F.col("any") < F.col("off") - 1e-9).agg(F.min("share").alias("share"))


def curve(rates: DataFrame, review: float, share: float = 0.10) -> DataFrame:
    """The cost as the block threshold moves, with the review threshold held and without abstention."""
    x = rates.filter((F.abs(F.col("review") - review) < 1e-9) & (F.col("abstain") > 1))
    return priced(x, share=share).select("block", "cost")
