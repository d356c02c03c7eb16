"""The detector: members, fusion, calibration and thresholds, trained over labelled messages and written as a model.

1. ``feature_table``: every message once, with its canonical text, its engineered features, its label
   (null where there is none) and its pool. It is written, so no fit works out a feature twice.
2. Whole groups are dealt to four disjoint pools by a hash: ``fit`` trains the members, ``stack`` their
   fusion, ``cal`` the calibration and the thresholds, ``test`` is only scored.
3. ``train`` writes the fitted stages, and the scores of the messages with labels. Those of all others are
   worked out and written when they are first asked for: no fit and no measure of quality reads them.

What comes to the driver are weights, thresholds and counts; sizes are those of hashed feature spaces.

Defined cases: a null text is empty; null labels are scored and never trained on; labels are 0 and 1;
a label given twice counts once, a positive one before a negative one; a pool without both classes
leaves its stage out: scores are then the members' mean, or uncalibrated, and the reason is in ``thresholds``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.sources.sinks import shared_folder

from . import messages, models

FAMILIES = ("subject", "body", "lexicon", "obfuscation")
MEMBERS = ("m_trees", "m_words", "m_chars")
SHARES = {"test": 0.2, "cal": 0.2, "stack": 0.2}
LEAST_ISOTONIC = 250


class Detector(NamedTuple):
    """Where a model is, and what its queries read."""

    path: str
    weights: dict[str, float]  # of the fusion, with its intercept
    review: float
    block: float
    reason: str
    calibration: str  # isotonic, platt or none
    rest: list[Callable[[], None]]  # what writes the rows and scores of messages without label, until it is done

    def scores(self, spark: SparkSession) -> DataFrame:
        """(message_id, y, pool, the members' scores, raw, score) of every message."""
        return self._whole(spark, "scores")

    def rows(self, spark: SparkSession) -> DataFrame:
        return self._whole(spark, "rows")

    def labelled(self, spark: SparkSession) -> DataFrame:
        """The scores of messages with labels, among them all that any stage was fitted on."""
        return spark.read.parquet(f"{self.path}/scores/labelled")

    def _whole(self, spark: SparkSession, name: str) -> DataFrame:
        while self.rest:
            self.rest[-1]()
            self.rest.pop()
        return spark.read.parquet(f"{self.path}/{name}/labelled", f"{self.path}/{name}/rest")

    def member(self, name: str) -> PipelineModel:
        models.with_functions(SparkSession.active())
        return PipelineModel.load(f"{self.path}/{name}")


def pooled(rows: DataFrame, group: str) -> DataFrame:
    """Adds pool by a hash of the group: whole groups, never split."""
    at, pool, upper = F.pmod(F.xxhash64(F.col(group)), F.lit(10_000)) / 10_000.0, F.lit("fit"), sum(SHARES.values())
    for name in reversed(SHARES):
        pool = F.when(at < upper, name).otherwise(pool)
        upper -= SHARES[name]
    return rows.withColumn("pool", pool)


def feature_table(mails: DataFrame) -> DataFrame:
    """(message_id, y, pool, text, features) of messages with their labels in y. Groups are equal canonical texts, so copies share a pool."""
    x = messages.prepared(mails)
    own = {k: F.round(v, 6) for k, v in messages.columns(*FAMILIES).items()}
    x = x.select("message_id", F.col("_canon").alias("text"), *(v.alias(k) for k, v in own.items()), "y")
    return pooled(x.withColumn("_g", F.sha2("text", 256)), "_g").drop("_g")


def _both(rows: DataFrame, least: int = 1) -> bool:
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return min(n.get(0.0, 0), n.get(1.0, 0)) >= least


def platt(rows: DataFrame, score: str = "raw"):
    """A sigmoid over the log-odds of a score: for few rows, where steps would follow each of them."""
    model = LogisticRegression(featuresCol="_s", labelCol="y").fit(_log_odds(rows, score))
    return lambda x: _log_odds(x, score).withColumn("score", _sigmoid(float(model.coefficients[0]), float(model.intercept), score)).drop("_s")


def _logit(score: str):
    p = F.least(F.greatest(F.col(score), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _log_odds(rows: DataFrame, score: str) -> DataFrame:
    return VectorAssembler(inputCols=["_l"], outputCol="_s").transform(rows.withColumn("_l", _logit(score))).drop("_l")


def _sigmoid(a: float, b: float, score: str):
    return 1 / (1 + F.exp(-(_logit(score) * a + b)))


def calibrated(cal: DataFrame):
    """(kind, how scores become calibrated ones): isotonic with enough rows, else Platt's sigmoid; none where a class is missing."""
    clip = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    if not _both(cal):
        return "none", lambda x: x.withColumn("score", F.col("raw"))
    if cal.count() < LEAST_ISOTONIC:
        return "platt", platt(cal)
    steps = models.calibrate(cal)
    return "isotonic", lambda x: steps.transform(x).withColumn("score", clip).drop("prediction")


def fused_by(stack: DataFrame, members: tuple[str, ...] = MEMBERS):
    """(weights, how members' scores become one): a logistic regression with both classes at equal weight; their mean where a class is missing."""
    if not _both(stack):
        return {m: 1.0 / len(members) for m in members} | {"intercept": 0.0}, lambda x: x.withColumn("raw", sum(F.col(m) for m in members) / len(members))
    model = models.fuse(stack, list(members)).stages[-1]
    weights = {m: float(w) for m, w in zip(members, model.coefficients, strict=True)} | {"intercept": float(model.intercept)}
    return weights, lambda x: x.withColumn("raw", fuse_columns(weights))


def fuse_columns(weights: dict[str, float]):
    total = F.lit(weights["intercept"])
    for m, w in weights.items():
        if m != "intercept":
            total = total + F.col(m) * w
    return 1 / (1 + F.exp(-total))


def train(mails: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 4, features: int = 1 << 16) -> Detector:
    """Fits and writes a detector, and scores every message with a label; the others are scored once they are asked for."""
    spark = mails.sparkSession
    path = f"{shared_folder(spark)}/detector-{uuid.uuid4().hex}"
    truth = labels.filter("message_id is not null and y is not null").groupBy("message_id").agg(F.max(F.col("y").cast("double")).alias("y"))
    feature_table(mails.drop("y").join(truth, "message_id")).write.parquet(f"{path}/rows/labelled")
    rows = spark.read.parquet(f"{path}/rows/labelled")
    columns = [c for c in rows.columns if c not in ("message_id", "y", "pool", "text")]
    fit = rows.filter("pool = 'fit'")
    if not _both(fit):
        raise ValueError("the rows to fit hold one class only")
    weighted = models.balanced(fit).cache()
    n = weighted.count()
    made = {"m_trees": models.tree_member(columns, trees, depth), "m_words": models.word_member(features=features, n_rows=n), "m_chars": models.char_member(features=4 * features, n_rows=n)}

    def fitted_one(name: str):
        model = made[name].fit(weighted)
        model.write().save(f"{path}/{name}")
        return model

    # Side by side: a fit is a row of small jobs, and one's waits leave cores to the others.
    with ThreadPool(len(made)) as pool:
        fitted = dict(zip(made, pool.map(inheritable_thread_target(spark)(fitted_one), made), strict=True))
    weighted.unpersist()
    models.member_scores(fitted, rows, ["message_id", "y", "pool"]).write.parquet(f"{path}/members")
    members = spark.read.parquet(f"{path}/members")
    weights, fuse = fused_by(members.filter("pool = 'stack'"))
    kind, calibrate = calibrated(fuse(members.filter("pool = 'cal'")))

    def write(scored: DataFrame, part: str) -> None:
        calibrate(fuse(scored)).select("message_id", "y", "pool", *MEMBERS, "raw", "score").write.mode("overwrite").parquet(f"{path}/scores/{part}")

    def rest() -> None:
        others = mails.drop("y").join(truth.select("message_id"), "message_id", "left_anti").withColumn("y", F.lit(None).cast("double"))
        feature_table(others).write.mode("overwrite").parquet(f"{path}/rows/rest")
        write(models.member_scores(fitted, spark.read.schema(rows.schema).parquet(f"{path}/rows/rest"), ["message_id", "y", "pool"]), "rest")

    write(members, "labelled")
    review, block, reason = models.thresholds(spark.read.parquet(f"{path}/scores/labelled").filter("pool = 'cal'"))
    return Detector(path, weights, float(review), float(block), reason, kind, [rest])


def quality(scored: DataFrame, systems: dict[str, str], bins: int = 15) -> DataFrame:
    """One row a system over (y, scores): macro-F1, false and missed alarms, ECE and Brier score, all systems in one aggregate."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("system"), F.col(c).cast("double").alias("s")) for k, c in systems.items())))
    x = scored.select("y", each.alias("x")).select("y", "x.*")
    bin_ = F.least(F.floor(F.col("s") * bins), F.lit(bins - 1))
    by = x.groupBy("system", bin_.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("s").alias("conf"), F.sum("y").alias("pos"), F.sum((F.col("s") - F.col("y")) ** 2).alias("sq"),
        *(F.count_if((F.col("y") == y) & ((F.col("s") >= 0.5) == hit)).alias(k) for k, y, hit in (("tn", 0, False), ("fp", 0, True), ("fn", 1, False), ("tp", 1, True))),
    )
    out = by.groupBy("system").agg(*(F.sum(c).alias(c) for c in ("n", "sq", "tn", "fp", "fn", "tp")), F.sum(F.abs(F.col("conf") - F.col("pos"))).alias("gap"))
    f1 = lambda hit: F.coalesce(2 * F.col(hit) / F.nullif(2 * F.col(hit) + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return out.select("system", "n", "tn", "fp", "fn", "tp", F.round((f1("tp") + f1("tn")) / 2, 6).alias("macro_f1"), F.round(F.col("gap") / F.col("n"), 6).alias("ece"), F.round(F.col("sq") / F.col("n"), 6).alias("brier"))


def without_each(detector: Detector, spark: SparkSession) -> DataFrame:
    """Quality on the test pool with each member left out: its fusion and calibration fitted anew on the pools they belong to."""
    scores = detector.labelled(spark).drop("raw", "score")
    out = None
    for left in (None, *MEMBERS):
        members = tuple(m for m in MEMBERS if m != left)
        weights, fuse = fused_by(scores.filter("pool = 'stack'"), members)
        _, calibrate = calibrated(fuse(scores.filter("pool = 'cal'")))
        one = quality(calibrate(fuse(scores.filter("pool = 'test'"))), {left or "none": "score"}).withColumnRenamed("system", "left_out")
        out = one if out is None else out.unionByName(one)
    return out


def explained(detector: Detector, spark: SparkSession, k: int = 10) -> DataFrame:
    """(message_id, member, contribution): each member's share of the fused log-odds, of what is held or blocked."""
    held = detector.scores(spark).filter(F.col("score") >= detector.review)
    parts = [F.struct(F.lit(m).alias("member"), F.round(F.col(m) * w, 6).alias("contribution")) for m, w in detector.weights.items() if m != "intercept"]
    return held.select("message_id", F.explode(F.array(*parts)).alias("x")).select("message_id", "x.*")


def probability(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    """rows with one more column: a member's score."""
    return model.transform(rows).withColumn(name, vector_to_array("probability")[1]).select(*rows.columns, name)


def occluded(detector: Detector, spark: SparkSession, most: int = 24, best: int = 8, least: float = 1e-4) -> DataFrame:
    """(message_id, feature, value, neutral, contribution, place): what the tree member's score loses when a feature is neutral.

    Neutral values are the medians of what was fitted and is legitimate, spreads its standard deviations.
    Of each held message the ``most`` features furthest from neutral, in spreads, are reset one at a time;
    all variants are scored in one pass. Of drops under ``least`` nothing is shown, of others the ``best``.
    """
    rows = detector.rows(spark)
    columns = [c for c in rows.columns if c not in ("message_id", "y", "pool", "text")]
    calm = rows.filter("pool = 'fit' and y = 0")
    r = calm.agg(*(F.percentile_approx(c, 0.5, 10_000).alias(f"m{i}") for i, c in enumerate(columns)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns))).first()
    neutral = {c: float(r[f"m{i}"] or 0.0) for i, c in enumerate(columns)}
    spread = {c: float(r[f"s{i}"] or 0.0) or 1.0 for i, c in enumerate(columns)}
    held = rows.join(detector.scores(spark).filter(F.col("score") >= detector.review).select("message_id", F.col("m_trees").alias("base")), "message_id").drop("text", "y", "pool")
    off = F.array(*(F.struct((F.abs(F.col(c) - neutral[c]) / spread[c]).alias("far"), F.lit(i).alias("at"), F.col(c).alias("value")) for i, c in enumerate(columns)))
    top = F.slice(F.reverse(F.array_sort(F.filter(off, lambda s: s["far"] > 0))), 1, most)
    each = held.withColumn("x", F.explode(top))
    variants = each.select("message_id", "base", F.col("x.at").alias("at"), F.col("x.value").alias("value"), *(F.when(F.col("x.at") == i, F.lit(neutral[c])).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)))
    scored = probability(detector.member("m_trees"), variants, "after").select("message_id", "at", "value", (F.col("base") - F.col("after")).alias("contribution"))
    scored = scored.filter(F.abs("contribution") >= least)
    # At most ``most`` rows a message, so the order of one is never large.
    order = F.array_sort(F.collect_list(F.struct((-F.abs("contribution")).alias("k"), "at", "value", "contribution")))
    listed = scored.groupBy("message_id").agg(F.slice(order, 1, best).alias("x")).select("message_id", F.posexplode("x").alias("place", "x"))
    name = F.element_at(F.array(*map(F.lit, columns)), F.col("x.at") + 1)
    zero = F.element_at(F.array(*(F.lit(neutral[c]) for c in columns)), F.col("x.at") + 1)
    return listed.select("message_id", name.alias("feature"), "x.value", zero.alias("neutral"), F.round("x.contribution", 6).alias("contribution"), (F.col("place") + 1).alias("place"))
