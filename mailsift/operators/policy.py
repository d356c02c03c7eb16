"""Decision policy: bands, abstention, the velocity guard, and the expected cost of policies."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import BLOCK, REVIEW, band

ABSTAIN_SPREAD, LEAST_MEMBERS = 0.45, 3
MEMBERS = ("m_rules", "m_engineered", "m_charngram", "m_wordtfidf")
#: Thresholds of the policy grid: 0.05, 0.10, ... 0.95.
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
#: Cost assumptions per message, in one currency: a missed phish, a review, a falsely blocked message; share of phish in deployment; analysts' error.
COSTS = {"miss": 200.0, "review": 1.0, "false_block": 15.0, "prevalence": 0.05, "analyst_error": 0.05}


def spread(members: tuple[str, ...] = MEMBERS) -> Column:
    """Largest less smallest member score; 0 with fewer than three."""
    given = F.filter(F.array(*members), lambda m: m.isNotNull())
    return F.when(F.size(given) >= LEAST_MEMBERS, F.array_max(given) - F.array_min(given)).otherwise(0.0)


def contradicted(members: tuple[str, ...] = MEMBERS, review: float = REVIEW, block: float = BLOCK, limit: float = ABSTAIN_SPREAD) -> Column:
    """Whether members are far apart, one calm, and two alarmed or one certain."""
    given = F.filter(F.array(*members), lambda m: m.isNotNull())
    calm, alarmed = F.exists(given, lambda m: m < review), F.size(F.filter(given, lambda m: m >= review)) >= 2
    return (F.round(spread(members), 9) >= limit) & calm & (alarmed | (F.array_max(given) >= block))


def abstention(scored: DataFrame, members: tuple[str, ...] = MEMBERS, escalate: bool = False, review: float = REVIEW, block: float = BLOCK) -> DataFrame:
    """Adds spread, base_band, band and abstained; escalate keeps BLOCK where members contradict."""
    plain = band("score", review, block)
    moved = contradicted(members, review, block) & (F.col("base_band") != "REVIEW")
    moved = moved & (F.col("base_band") != "BLOCK") if escalate else moved
    x = scored.withColumn("spread", spread(members)).withColumn("base_band", plain).withColumn("abstained", moved)
    return x.withColumn("band", F.when(F.col("abstained"), "REVIEW").otherwise(F.col("base_band")))


def velocity_guard(scored: DataFrame) -> DataFrame:
    """Adds guarded, the score after what a sender's recent behaviour adds to it.

    Reads score, available, burst_count_1h, first_seen, domain_report_count and display_name_alias_count.
    """
    campaign = F.least(F.log1p("burst_count_1h") / 4, F.lit(1.0)) * F.col("first_seen").cast("double")
    bump = F.least(0.10 * campaign + 0.04 * (F.col("domain_report_count") > 0).cast("double") + 0.03 * (F.col("display_name_alias_count") > 1).cast("double"), F.lit(0.15))
    raised = F.greatest("score", F.least(F.col("score") + bump * (1 - F.col("score")), F.lit(0.99)))
    use = F.col("available") & (bump > 0.005) & (raised - F.col("score") >= 0.0005)
    return scored.withColumn("guarded", F.when(use, raised).otherwise(F.col("score")))


def threshold_counts(scored: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Positives and negatives at or above each threshold: rows are counted by cell, then cells add up."""
    cell = sum((F.col("score") >= t).cast("int") for t in grid)
    x = scored.groupBy(cell.alias("cell")).agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("n"))
    cells = scored.sparkSession.range(len(grid) + 1).select(F.col("id").cast("int").alias("cell"))
    down = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # one row a threshold
    x = cells.join(x, "cell", "left").select("cell", F.sum(F.coalesce("p", F.lit(0))).over(down).alias("pos"), F.sum(F.coalesce("n", F.lit(0))).over(down).alias("neg"))
    names = scored.sparkSession.createDataFrame([(0, 0.0), *((i + 1, t) for i, t in enumerate(grid))], "cell int, threshold double")
    return x.join(F.broadcast(names), "cell").select("threshold", "pos", "neg")


RATES = ("p_allow_phish", "p_review_phish", "p_review_ham", "p_block_ham")


def policy_rates(scored: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Rates of every pair review <= block of the grid, from one count of the scores."""
    at = threshold_counts(scored, grid)
    pairs = scored.sparkSession.createDataFrame([(a, b) for a, b in combinations_with_replacement(grid, 2)], "review double, block double")
    # All thresholds in one row of arrays (a place a threshold): each pair looks its own up, so the scores are counted once.
    row = at.agg(F.sort_array(F.collect_list(F.struct("threshold", "pos", "neg"))).alias("c"))
    x = pairs.join(F.broadcast(row), F.lit(True))
    of = lambda t: F.filter("c", lambda v: F.abs(v["threshold"] - t) < 1e-9)[0]
    x = x.select("review", "block", of(F.lit(0.0)).alias("all"), of(F.col("review")).alias("r"), of(F.col("block")).alias("b"))
    n1, n0 = F.nullif(F.col("all.pos"), F.lit(0)), F.nullif(F.col("all.neg"), F.lit(0))
    found = (1 - F.col("r.pos") / n1, (F.col("r.pos") - F.col("b.pos")) / n1, (F.col("r.neg") - F.col("b.neg")) / n0, F.col("b.neg") / n0)
    return x.select("review", "block", *(v.alias(k) for k, v in zip(RATES, found, strict=True)))


def _priced(rates: DataFrame, miss: Column, c: dict[str, float]) -> DataFrame:
    prior, e = c["prevalence"], c["analyst_error"]
    x = rates.withColumns({
        "missed_cost": 1000 * prior * miss * (F.col("p_allow_phish") + e * F.col("p_review_phish")),
        "reviews": 1000 * (prior * F.col("p_review_phish") + (1 - prior) * F.col("p_review_ham")),
        "false_block_cost": 1000 * (1 - prior) * c["false_block"] * (F.col("p_block_ham") + e * F.col("p_review_ham")),
    })
    return x.withColumn("cost", F.round(F.col("missed_cost") + c["review"] * F.col("reviews") + F.col("false_block_cost"), 6))


def policy_costs(scored: DataFrame, grid: tuple[float, ...] = GRID, costs: dict[str, float] = COSTS, miss: float | None = None) -> DataFrame:
    """Rates and expected cost per 1,000 messages of every pair review <= block of the grid."""
    c = costs | ({"miss": miss} if miss is not None else {})
    x = _priced(policy_rates(scored, grid), F.lit(c["miss"]), c)
    return x.select("review", "block", *(F.round(k, 6).alias(k) for k in (*RATES, "missed_cost", "reviews", "false_block_cost")), "cost")


def _under(scored: DataFrame, misses: tuple[float, ...], costs: dict[str, float] = COSTS) -> DataFrame:
    """(miss, review, block, cost): one rate table priced under each cost of a miss."""
    asked = scored.sparkSession.createDataFrame([(float(m),) for m in misses], "miss double")
    return _priced(policy_rates(scored).join(F.broadcast(asked), F.lit(True)), F.col("miss"), costs).select("miss", "review", "block", "cost")


def policy_best(scored: DataFrame, misses: tuple[float, ...] = (50.0, 100.0, 200.0, 400.0, 800.0)) -> DataFrame:
    """The cheapest policy for each cost of a missed phish; ties go to the lower thresholds."""
    return _under(scored, misses).groupBy("miss").agg(F.min(F.struct("cost", "review", "block")).alias("b")).select("miss", "b.review", "b.block", "b.cost")


def frontier(scored: DataFrame) -> DataFrame:
    """Policies that no other one beats in both reviews and missed phish."""
    x = policy_costs(scored).groupBy("reviews", "p_allow_phish").agg(F.min(F.struct("review", "block")).alias("p"))  # the grid's pairs
    least = Window.orderBy("reviews").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("reviews", "p_allow_phish")
    x = x.withColumn("best", F.min("p_allow_phish").over(least)).withColumn("earlier", F.min("p_allow_phish").over(before.rowsBetween(Window.unboundedPreceding, -1)))
    keep = (F.col("p_allow_phish") == F.col("best")) & (F.col("earlier").isNull() | (F.col("p_allow_phish") < F.col("earlier")))
    return x.filter(keep).select("p.review", "p.block", "reviews", "p_allow_phish")


def minimax_regret(scored: DataFrame, misses: tuple[float, ...] = (50.0, 100.0, 200.0, 800.0)) -> DataFrame:
    """Worst regret of each policy over cost profiles, the policy of least worst regret first."""
    x = _under(scored, misses)
    x = x.withColumn("regret", F.col("cost") - F.min("cost").over(Window.partitionBy("miss")))  # a row a policy
    return x.groupBy("review", "block").agg(F.round(F.max("regret"), 6).alias("worst_regret")).orderBy("worst_regret", "review", "block")


def policy_regret(scored: DataFrame, review: float, block: float) -> DataFrame:
    """One policy's worst regret over the cost profiles, beside the least that any policy has."""
    x = minimax_regret(scored)
    mine = F.max(F.when((F.abs(F.col("review") - review) < 1e-9) & (F.abs(F.col("block") - block) < 1e-9), F.col("worst_regret")))
    return x.agg(mine.alias("regret"), F.min("worst_regret").alias("least_regret"))
