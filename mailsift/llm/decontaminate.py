"""Benchmark decontamination: which document words stand in a benchmark passage.

A window is ``width`` consecutive words of an item; an item of fewer words (but not none) is one
window. The job is a containment join at threshold 1, built from DataFrame operations only:

1. every document position yields the shingle that starts there; those that occur in the
   benchmark at all are kept, and counted, which gives each shingle's rarity in the corpus;
2. a window must be contained whole, so one token of it is a sufficient prefix: its rarest
   shingle. Windows meet document positions on that shingle alone;
3. the shingle's place in the window fixes where the window would start (positional bound), and it
   must end inside the document (length bound);
4. the words of that span are compared with the window's words, one by one.

Defined cases: null texts, and texts without words, have no words and no hits; repeated items and
repeated windows count each item once; a null item_id marks words as hit and names no item. Rows
that agree in doc_id and text get the same result. Empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, packed, table

WIDTH = 10
SHINGLE = 3
#: Bytes of the benchmark's shingle tables, of 40 a row, up to which they are sent to all executors.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 40
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Words of a text, with A-Z in lower case (other letters stay as they are)."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _shingle(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(*(F.get(words, i + j) for j in range(k)))


def _starts(words: Column, k: int) -> Column:
    """0, 1, ... of the places where k words begin."""
    n = F.size(words)
    return F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(words, n, items): each distinct window, its length and the sorted ids of its items."""
    own = benchmark.select(F.col("item_id").cast("string").alias("item"), tokens(F.coalesce("text", F.lit(""))).alias("w"))
    size = F.least(F.size("w"), F.lit(width))
    own = own.filter(F.size("w") > 0).select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.slice("w", i + 1, size))).alias("words"))
    return own.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("n", F.size("words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per row of docs: row (all its columns), n_words, the sorted hit positions and the sorted item ids."""
    spark = docs.sparkSession
    wins = cut(windows(benchmark, width).withColumn("wid", F.monotonically_increasing_id()).withColumn("k", F.least("n", F.lit(shingle))), "windows")
    # Windows of fewer than ``shingle`` words need shorter shingles; most benchmarks have none.
    sizes = [r.k for r in wins.select("k").distinct().orderBy("k").collect()] or [shingle]
    parts = cut(
        wins.select("wid", "k", F.explode(F.expr(" || ".join(f"transform(if(k = {k}, sequence(0, n - {k}), array()), i -> struct(cast(i as int) as at, xxhash64({', '.join(f'get(words, i + {j})' for j in range(k))}) as s))" for k in sizes)) if len(sizes) > 1 else F.transform(F.sequence(F.lit(0), F.col("n") - sizes[0]), lambda i: F.struct(i.alias("at"), _shingle(F.col("words"), i, sizes[0]).alias("s")))).alias("p"))
        .select("wid", "k", "p.at", "p.s"),
        "shingles",
    )
    known = parts.select("k", "s").distinct()
    # Both tables that may be sent, this and the windows' prefixes, hold hashes and numbers only, and have no more rows than ``parts``.
    small = parts.count() * ROW_BYTES <= broadcast_bytes
    sent = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    text = packed(docs)
    own = F.coalesce(F.col("row.text"), F.lit(""))
    found = None
    for k in sizes:
        w = text.select("_d", "_h", tokens(own).alias("w"))
        hits = w.select("_d", "_h", F.posexplode(F.transform(_starts(F.col("w"), k), lambda i: _shingle(F.col("w"), i, k))).alias("pos", "s"))
        hits = hits.join(sent(known.filter(F.col("k") == k)), "s")
        found = hits if found is None else found.unionByName(hits)
    found = cut(found, "found")
    rarity = found.groupBy("k", "s").agg(F.count(F.lit(1)).alias("df"))
    ranked = parts.join(rarity, ["k", "s"], "left")
    # A shingle that no document has rules its window out: df is null then, and sorts first.
    prefix = ranked.groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "at", "s", "k")).alias("p")).filter("p.df > 0").select("wid", "p.at", "p.s", "p.k")
    pairs = found.join(sent(prefix), ["k", "s"]).withColumn("start", F.col("pos") - F.col("at")).filter("start >= 0")
    # The words of a window join where it is proposed, so that no table of words is sent.
    pairs = pairs.join(wins.select("wid", "n", "words", "items"), "wid")
    # One window may be proposed for a place once only: the prefix is one shingle at one offset.
    spans = pairs.groupBy("_d", "_h").agg(F.collect_set(F.struct("start", "n", "words", "items")).alias("spans"))

    joined = text.join(spans, ["_d", "_h"], "left").withColumn("_w", tokens(own))
    good = F.filter(F.coalesce("spans", F.array().cast("array<struct<start:int,n:int,words:array<string>,items:array<string>>>")), lambda s: (s["start"] + s["n"] <= F.size("_w")) & (F.slice("_w", s["start"] + 1, s["n"]) == s["words"]))
    joined = joined.withColumn("_good", good)
    return joined.select(
        "row",
        F.size("_w").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_good", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_good", lambda s: s["items"])))).alias("items"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the whole benchmark."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "row.doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
b2 AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b2)),
sizes AS (SELECT DISTINCT n FROM wins),
spot AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT spot.doc_id, spot.i, spot.n, wins.item FROM spot JOIN wins ON spot.n = wins.n AND spot.s = wins.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
