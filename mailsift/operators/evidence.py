"""What an analyst is shown of a held message: terms that weigh, words in place of fragments, sentences in place of feature names, and one ordered list of all evidence.

Defined cases: a message without links, fired rules, moved features or weighing terms has no such items;
rows that repeat an id are one message; a null text has no terms; unknown features are named after their family.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.functions import urls
from mailsift.functions.refdata import FEATURE_FAMILIES, FEATURE_PHRASES, RULES
from mailsift.functions.text import strings

from . import detector as D
from . import models

DISAGREE, RULES_SHOWN, FEATURES_SHOWN, TERMS_SHOWN = 0.25, 6, 6, 4
ITEM = ("message_id", "ord", "kind", "id", "title", "detail", "direction", "weight")


def number(value: Column) -> Column:
    """A number in at most six significant digits, without zeros at its end; whole numbers as they are."""
    v = value.cast("double")
    short = F.format_string("%.5e", v)
    plain = F.regexp_replace(short.cast("double").cast("decimal(30,10)").cast("string"), r"\.?0+$", "")
    far = (F.abs(v) < 1e-4) | (F.abs(short.cast("double")) >= 1e6)
    return F.when(v == F.floor(v), F.format_string("%d", v.cast("long"))).when(far, F.regexp_replace(short, r"\.?0+e", "e")).otherwise(plain)


def phrase(name: Column, value: Column) -> Column:
    """A feature's value as a sentence; features without one are named after their family."""
    known = F.map_from_arrays(strings(list(FEATURE_PHRASES)), strings(list(FEATURE_PHRASES.values())))[name]
    other = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), FEATURE_FAMILIES, name)
    return F.when(known.isNotNull(), F.replace(known, F.lit("{v}"), number(value))).otherwise(F.concat(other, F.lit(" = "), number(value)))


def readable(fragments: Column, text: Column) -> Column:
    """Each fragment's first word that holds it, or the fragment where none does; each once, empty ones left out."""
    return _readable(fragments, _words(text))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)[\w@./-]+"), F.lit(0))


def _readable(fragments: Column, words: Column) -> Column:
    clean = F.filter(F.transform(fragments, lambda f: F.trim(F.regexp_replace(f, r"\s+", " "))), lambda f: f != "")
    return F.array_distinct(F.transform(clean, lambda f: F.coalesce(F.get(F.filter(words, lambda w: F.contains(w, f)), F.lit(0)), f)))


def _heaviest(model: PipelineModel, k: int) -> Column:
    """(term, contribution, place) of the k terms of a column text that weigh most in a text member's log-odds."""
    own = models.linear(model)
    if own.vocabulary is None:
        return models.char_contributions(F.col("text"), own.idf, own.weights, k)
    return models.term_contributions(F.col("text"), own.vocabulary, own.idf, own.weights, k)


def term_contributions(model: PipelineModel, rows: DataFrame, id: str, k: int) -> DataFrame:
    """(id, term, contribution, place): the k terms of each row that weigh most in a text member's log-odds, by absolute value.

    A contribution is the term's weight times its inverse document frequency over the length of the row's
    vector. Of fragments of one hash the first by name stands for all; terms come as they stand in the text, and
    each row's are weighed where it is read, so none but the k are written or moved. A task holds an entry for each
    of the member's vocabulary, or of its hashed space.
    """
    x = rows.select(id, F.explode(_heaviest(model, k)).alias("x"))
    return x.select(id, "x.term", F.round("x.contribution", 5).alias("contribution"), "x.place")


def terms(detector: D.Detector, spark: SparkSession, *members: str, k: int = TERMS_SHOWN) -> DataFrame:
    """(message_id, member, place, term, contribution, words): the terms of held messages; words are those that hold a fragment.

    Held messages are read once for all members, and their words are looked for once.
    """
    rows = _held_rows(detector, spark).select("message_id", "text")
    found = rows.select("message_id", "text", *(_heaviest(detector.member(m), k).alias(m) for m in members))
    one = lambda m, words: F.transform(m, lambda t: F.struct(F.lit(m).alias("member"), t["place"].alias("place"), t["term"].alias("term"), F.round(t["contribution"], 5).alias("contribution"), F.array_join(words(t["term"]), ", ").alias("words")))
    whole = lambda m: one(m, lambda t: F.array(t))
    within = lambda m: F.get(F.transform(F.array(_words(F.col("text"))), lambda w: one(m, lambda t: _readable(F.array(t), w))), F.lit(0))
    return found.select("message_id", F.explode(F.concat(*(whole(m) if m == "m_words" else within(m) for m in members))).alias("x")).select("message_id", "x.*")


def held(detector: D.Detector, spark: SparkSession) -> DataFrame:
    return detector.scores(spark).filter(F.col("score") >= detector.review).dropDuplicates(["message_id"])


def _held_rows(detector: D.Detector, spark: SparkSession) -> DataFrame:
    return detector.rows(spark).join(held(detector, spark).select("message_id"), "message_id", "left_semi").dropDuplicates(["message_id"])


def _items(x: DataFrame, ord: Column | int, kind: str, id: Column, title: Column, detail: Column, direction: Column, weight: Column) -> DataFrame:
    ord = F.lit(ord) if isinstance(ord, int) else ord
    return x.select("message_id", ord.cast("int").alias("ord"), F.lit(kind).alias("kind"), id.alias("id"), title.alias("title"), detail.alias("detail"), direction.alias("direction"), weight.cast("double").alias("weight"))


def destination(links: DataFrame) -> DataFrame:
    """Where each message's first link leads, unwrapped."""
    first = links.groupBy("message_id").agg(F.min_by("href", "pos").alias("raw"))
    x = urls.with_parts(urls.settled(urls.with_canonical(first, "raw", "url")), "url", "_c_")
    p = urls.parts("_c_")
    to = F.when(F.coalesce(F.col("_c_registered_domain"), F.lit("")) != "", F.col("_c_registered_domain")).otherwise(p["host"])
    return _items(x, 0, "context", F.lit("destination"), F.concat(F.lit("Primary link resolves to "), to), F.substring("url", 1, 200), F.lit("neutral"), F.lit(0.0))


def fired(rule_rows: DataFrame) -> DataFrame:
    """The heaviest rules of each message, over the table of the features that rules read."""
    order = sorted(RULES, key=lambda r: (-abs(r[1]), r[0]))
    one = lambda r: F.when(F.col(r[2]) >= r[3], F.struct(F.lit(r[0]).alias("rule"), F.lit(r[1]).alias("w"), F.lit(r[2]).alias("feature"), F.col(r[2]).cast("double").alias("value")))
    x = rule_rows.select("message_id", F.posexplode(F.slice(F.array_compact(F.array(*map(one, order))), 1, RULES_SHOWN)).alias("at", "x")).select("message_id", "at", "x.*")
    detail = F.concat("feature", F.lit(" = "), number(F.col("value")))
    return _items(x, F.col("at") + 1, "rule", F.col("rule"), phrase(F.col("feature"), F.col("value")), detail, _side(F.col("w")), F.round(F.abs("w") / 2, 4))


def _side(x: Column) -> Column:
    return F.when(x > 0, "phishing").otherwise("legitimate")


def moved(occluded: DataFrame) -> DataFrame:
    """The features whose reset moves a message's score most."""
    x = occluded.filter(F.col("place") <= FEATURES_SHOWN)
    detail = F.concat(F.lit("score would change by "), F.format_string("%+.3f", -F.col("contribution")), F.lit(" if this were normal"))
    return _items(x, 10 + F.col("place"), "feature", F.col("feature"), phrase(F.col("feature"), F.col("value")), detail, _side(F.col("contribution")), F.round(F.abs("contribution"), 4))


def wording(found: DataFrame, member: str = "m_words") -> DataFrame:
    """The terms that speak for phishing, of at least three characters; their weight is that of all such terms, at most 1."""
    up = F.filter("t", lambda s: s["contribution"] > 0)
    shown = F.array_distinct(F.transform(F.filter(up, lambda s: F.char_length(s["term"]) > 2), lambda s: s["words"]))
    x = found.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", "contribution", "words"))).alias("t")).withColumn("shown", shown).filter(F.size("shown") > 0)
    weight = F.round(F.least(F.aggregate(F.transform(up, lambda s: s["contribution"]), F.lit(0.0), lambda s, v: s + v), F.lit(1.0)), 4)
    return _items(x, 20, "token", F.lit(member), F.lit("Wording most associated with phishing in this message"), F.array_join("shown", ", "), F.lit("phishing"), weight)


def agreement(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Whether the members agree, by the deviation of their scores, and the two that weigh most in the fusion."""
    members = [m for m in weights if m != "intercept"]
    mean = sum(F.col(m) for m in members) / len(members)
    spread = F.sqrt(sum((F.col(m) - mean) ** 2 for m in members) / len(members))
    shares = F.array(*(F.struct((-F.round(F.abs(F.col(m) * weights[m]), 5)).alias("k"), F.lit(i).alias("i"), F.concat(F.lit(f"{m}="), F.format_string("%.2f", F.round(m, 5))).alias("text")) for i, m in enumerate(members)))
    detail = F.array_join(F.transform(F.slice(F.array_sort(shares), 1, 2), lambda s: s["text"]), "; ")
    apart = spread > DISAGREE
    title = F.when(apart, "Detection views disagree - possible evasion attempt").otherwise("Detection views agree")
    return _items(scored, 21, "member", F.lit("ensemble"), title, detail, F.when(apart, "phishing").otherwise("neutral"), F.round(spread, 4))


def no_history(mails: DataFrame) -> DataFrame:
    """Messages that came without their sender's history."""
    x = mails.filter(~F.coalesce("available", F.lit(False))).select("message_id")
    detail = "Assessment used email and URL evidence only; behavioural signals were unavailable, which widens the uncertainty on this verdict."
    return _items(x, 22, "context", F.lit("no_behavioral_context"), F.lit("No sender history was supplied with this message"), F.lit(detail), F.lit("neutral"), F.lit(0.0))


def ranked(items: DataFrame, most: int = 12) -> DataFrame:
    """(message_id, place, kind, id, title, detail, direction, weight): each kind and id once (its heaviest), context first, then by weight; at most ``most`` a message, of which context takes its places first.

    A message has a bounded number of items, so its list is small however many messages there are.
    """
    best = F.struct((-F.col("weight")).alias("k"), *ITEM[1:])
    # Dealt by message once, both groupings stay where they are.
    x = items.repartition("message_id").groupBy("message_id", "kind", "id").agg(F.min(best).alias("x"))
    x = x.groupBy("message_id").agg(F.array_sort(F.collect_list("x")).alias("all"))
    context = F.filter("all", lambda s: s["kind"] == "context")
    keep = F.greatest(F.lit(most) - F.size(context), F.lit(1))
    x = x.select("message_id", F.posexplode(F.concat(context, F.slice(F.filter("all", lambda s: s["kind"] != "context"), F.lit(1), keep))).alias("at", "x"))
    return x.select("message_id", (F.col("at") + 1).alias("place"), *(f"x.{c}" for c in ITEM[2:]))


def cards(detector: D.Detector, mails: DataFrame, links: DataFrame, rule_rows: DataFrame, member: str = "m_words", most: int = 12) -> DataFrame:
    """The evidence of each held message; ``mails``, ``links`` and ``rule_rows`` may hold others too."""
    spark = mails.sparkSession
    scored = held(detector, spark)
    ids = scored.select("message_id")
    only = lambda x: x.join(ids, "message_id", "left_semi")
    parts = [destination(only(links)), fired(only(rule_rows)), moved(D.occluded(detector, spark)), wording(terms(detector, spark, member), member), agreement(scored, detector.weights), no_history(only(mails))]
    return ranked(reduce(DataFrame.unionByName, parts), most)
