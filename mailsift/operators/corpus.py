"""Corpus preparation: duplicates, splits, leakage and confound audits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.sources.sinks import written

from .quantiles import cumulated, quantiles

PERMUTATIONS, BANDS, ROWS, SHINGLE, NEAR = 64, 16, 4, 5, 0.85
#: Shingles that are permuted at a time: their numbers stay in a core's cache.
CHUNK = 512
LEAK_AUC, DRIFT = 0.985, 0.08


def fingerprint(subject="subject", body="body", sender="sender") -> F.col:
    """SHA-1 of a message's subject, body and sender, with NUL between."""
    return F.sha1(F.concat_ws("\u0000", *(F.coalesce(F.col(c), F.lit("")) for c in (subject, body, sender))))


def exact_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Groups of equal texts: their digest, size and smallest id."""
    return docs.groupBy(F.sha1(F.coalesce(F.col(text), F.lit(""))).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(id).alias("first_id")).filter("n > 1")


def label_noise(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Texts that carry both labels."""
    x = docs.join(labels, "doc_id").groupBy(F.sha1("text").alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("low"), F.max(label).alias("high"), F.min("doc_id").alias("first_id"))
    return x.filter("low <> high").select("digest", "n", "first_id")


def minhash(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(id, signature): 64 minima over hashed 5-character shingles of the squeezed lower-case text."""
    r = np.random.default_rng(64)
    a, b = (r.integers(1, 2**61, PERMUTATIONS, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = (np.empty((CHUNK, PERMUTATIONS), np.uint64) for _ in range(2))
        for f in frames:
            out = []
            for t in f.t:
                points = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
                if not len(points):
                    out.append(None)
                    continue
                n, h = max(len(points) - SHINGLE + 1, 1), np.uint64(0)
                for i in range(min(SHINGLE, len(points))):
                    h = (h * np.uint64(1_000_003)) ^ points[i : i + n]
                h = np.unique(h)
                low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(h), CHUNK):
                    some = h[at : at + CHUNK, None]
                    u, v = x[: len(some)], y[: len(some)]
                    np.multiply(some, a, out=u)
                    u += b
                    np.right_shift(u, np.uint64(29), out=v)
                    u ^= v
                    u *= np.uint64(0xBF58476D1CE4E5B9)
                    np.right_shift(u, np.uint64(32), out=v)
                    u ^= v
                    np.minimum(low, u.min(axis=0), out=low)
                out.append(low.view(np.int64))
            yield pd.DataFrame({"id": f.id, "signature": out})

    squeezed = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    return docs.select(F.col(id).cast("long").alias("id"), squeezed.alias("t")).mapInPandas(run, "id long, signature array<long>").filter("signature is not null")


def near_duplicates(docs: DataFrame, text: str = "text", id: str = "doc_id", threshold: float = NEAR) -> DataFrame:
    """(id, first_id, similarity): each copy of a signature with its first row, and all pairs of first rows that are near.

    Rows of one signature are represented by their smallest id. A pair that agrees in ``threshold`` of its places can
    differ in few bands: of 64 places 0.85 leave 9, so at least 7 of 16 bands are equal, and where the bands are dealt
    into five groups some group has two of them. Pairs therefore meet on two bands of one group, which is exact and finds
    far fewer strangers than single bands do; the join itself counts equal bands, so strangers never leave it.
    """
    signed = minhash(docs, text, id)
    name = F.struct(F.xxhash64("signature"), F.hash("signature"))
    signed = written(signed.withColumn("name", name), "signatures")  # read three times, made once
    first = signed.groupBy("name").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    copies = signed.select("id", "name").join(first.filter("n > 1"), "name").filter("id <> first_id").select("id", "first_id", F.lit(1.0).alias("similarity"))
    reps = signed.groupBy("name").agg(F.min_by("signature", "id").alias("signature"), F.min("id").alias("id")).drop("name")
    equal = BANDS - int((1 - threshold) * PERMUTATIONS + 1e-9)
    groups = [list(range(g, BANDS, 5)) for g in range(5)] if equal > 5 else [list(range(BANDS))]
    pairs_of = [(i, j) for g in groups for i in g for j in g if i < j] if equal > 5 else [(i, i) for i in range(BANDS)]
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.hash(i, F.slice("signature", i * ROWS + 1, ROWS)))
    each = reps.select("id", bands.alias("bands"))
    each = each.select("id", "bands", F.explode(F.array(*(F.xxhash64(F.lit(i * BANDS + j), F.col("bands")[i], F.col("bands")[j]) for i, j in pairs_of))).alias("key"))
    alike = F.aggregate(F.zip_with("bands", "other", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    pairs = each.join(each.select("key", F.col("id").alias("first_id"), F.col("bands").alias("other")), "key").filter((F.col("first_id") < F.col("id")) & (alike >= max(1, equal))).select("id", "first_id").distinct()
    x = pairs.join(reps.select("id", "signature"), "id").join(reps.select(F.col("id").alias("first_id"), F.col("signature").alias("other")), "first_id")
    same = F.aggregate(F.zip_with("signature", "other", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return copies.unionByName(x.select("id", "first_id", (same / PERMUTATIONS).alias("similarity")).filter(F.col("similarity") >= threshold))


def grouped_split(rows: DataFrame, group: str, test_share: float = 0.25, seed: str = "split") -> DataFrame:
    """Adds part: whole groups go to test, each group by a hash of its key, so parts never share a group."""
    at = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col(group).cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2.0**32)
    return rows.withColumn("part", F.when(at < test_share, "test").otherwise("train"))


def temporal_split(rows: DataFrame, time: str, group: str, share: float = 0.75) -> DataFrame:
    """Adds part: the first ``share`` by time is train; groups that straddle the cut leave the test part."""
    x = rows.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    cut = quantiles(x, "_t", (share,), discrete=True).select(F.col("q")[0].alias("_cut"))
    x = x.join(F.broadcast(cut), F.lit(True))
    old = x.groupBy(group).agg(F.min((F.col("_t") <= F.col("_cut")).cast("int")).alias("lo"), F.max((F.col("_t") <= F.col("_cut")).cast("int")).alias("hi"))
    x = x.join(old, group)
    part = F.when(F.col("_t") <= F.col("_cut"), "train").when(F.col("hi") == 1, "dropped").otherwise("test")
    return x.withColumn("part", part).drop("_t", "_cut", "lo", "hi")


def leakage_audit(rows: DataFrame, text: str, group: str, label: str) -> DataFrame:
    """One row over (part, text, group, label): shared texts and groups, class balance, and the verdict."""
    x = rows.filter("part in ('train', 'test')").withColumn("_f", F.sha1(F.coalesce(F.col(text), F.lit(""))))
    both = lambda key: x.groupBy(key).agg(F.countDistinct("part").alias("p")).agg(F.count_if(F.col("p") > 1).alias(f"shared_{'texts' if key == '_f' else 'groups'}"))
    sizes = x.agg(F.count_if(F.col("part") == "train").alias("n_train"), F.count_if(F.col("part") == "test").alias("n_test"), F.avg(F.when(F.col("part") == "train", F.col(label).cast("double"))).alias("a"), F.avg(F.when(F.col("part") == "test", F.col(label).cast("double"))).alias("b"))
    out = both("_f").join(both(group), F.lit(True)).join(sizes, F.lit(True)).withColumn("balance_drift", F.round(F.abs(F.col("a") - F.col("b")), 6)).drop("a", "b")
    return out.withColumn("passed", (F.col("shared_texts") == 0) & (F.col("shared_groups") == 0) & (F.col("balance_drift") <= DRIFT))


def feature_auc(rows: DataFrame, features: tuple[str, ...], label: str = "y") -> DataFrame:
    """AUC of each single feature by rank sums with ties averaged; a constant one has 0.5."""
    long = rows.select(F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in features))).alias("x")).select("y", "x.*")
    each = long.groupBy("feature", "v").agg(F.sum(F.col("y").cast("long")).alias("p"), F.sum(1 - F.col("y").cast("long")).alias("n"))
    each = cumulated(each, "v", ("n",), ("feature",)).withColumn("under", F.col("n_upto") - F.col("n") / 2)
    out = each.groupBy("feature").agg(F.sum(F.col("p") * F.col("under")).alias("won"), F.sum("p").alias("n1"), F.sum("n").alias("n0"))
    auc = F.when((F.col("n1") == 0) | (F.col("n0") == 0), 0.5).otherwise(F.col("won") / (F.col("n1") * F.col("n0")))
    return out.select("feature", F.round(auc, 6).alias("auc"), (F.greatest(auc, 1 - auc) >= LEAK_AUC).alias("suspicious"))


def profile(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled rows by source and class."""
    return docs.join(labels, "doc_id").groupBy("source", "toxic").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("n_langs"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


def confounds(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Shares of each language and of long texts in both classes, and the difference of classes."""
    x = docs.join(labels, "doc_id").select("toxic", F.explode(F.array(F.concat(F.lit("lang="), "lang"), F.concat(F.lit("long="), (F.col("n_chars") > 2000).cast("string")))).alias("trait"))
    total = x.groupBy("trait").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    size = docs.join(labels, "doc_id").agg(F.count_if(F.col("toxic") == 1).alias("n1"), F.count_if(F.col("toxic") == 0).alias("n0"))
    gap = F.round(F.abs(F.col("pos") / F.col("n1") - F.col("neg") / F.col("n0")), 6)
    return total.join(F.broadcast(size), F.lit(True)).select("trait", "pos", "neg", gap.alias("gap"))


def dataset_version(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Order-independent version of labelled rows: sums of 48-bit pieces of their digests, so equal rows count each."""
    x = docs.join(labels, "doc_id").select("toxic", F.sha2(F.concat_ws("|", F.coalesce("text", F.lit("")), F.col("toxic").cast("string")), 256).alias("d"))
    piece = lambda at: F.conv(F.substring("d", at, 12), 16, 10).cast("decimal(38,0)")
    x = x.agg(*(F.sum(piece(1 + 12 * i)).alias(f"p{i}") for i in range(5)), F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("n_positive"))
    return x.select(F.substring(F.sha2(F.concat_ws("|", *(f"p{i}" for i in range(5)), "n"), 256), 1, 12).alias("version"), "n", "n_positive")


def tfidf(docs: DataFrame, text: str = "text", id: str = "doc_id", min_df: int = 2, top: int | None = None) -> DataFrame:
    """(id, term, weight): sublinear term frequency, smooth inverse document frequency, unit length.

    top keeps each document's heaviest terms (a report); None keeps all.
    """
    terms = docs.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), 0)).alias("term"))
    tf = terms.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= min_df)
    n = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    x = tf.join(df, "term").join(F.broadcast(n), F.lit(True))
    x = x.withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1))
    norm = x.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    x = x.join(norm, "id").select("id", "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))
    if top is None:
        return x
    order = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return x.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
