"""Chat formatting: one text per conversation, logged snapshots of longer ones left out.

Logs often hold a conversation many times, each time a few turns longer. A rolling hash names each
prefix of turns; a conversation whose hash names a proper prefix of another one is a snapshot of
it and goes. DataFrame operations only.

The hash of a prefix is the exclusive-or of the SHA-256 digests of (position, role, text) of its turns,
in four parts, with the number of turns, so one running window computes all prefixes of a conversation.
Positions are part of each digest, so neither other turns nor the same ones in another order give it.

Defined cases: turns are ordered by turn, then role, then text (ties and null turns, which come
first, are so put in order); rows repeated whole count as the one turn they are; null role or text
are empty and render so, but a null differs from no other empty; of equal conversations the one
with the smallest conv_id stays; null conv_id is a conversation of its own. Nothing is left out
but snapshots and copies. Rendering a conversation holds its one text, as its output must.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
HASH = ("h1", "h2", "h3", "h4")


def prefixes(conversations: DataFrame) -> DataFrame:
    """Each distinct turn with its place, and the hash of the conversation up to it."""
    turns = conversations.select(
        F.col("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).distinct()
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turns = turns.withColumn("n", F.count(F.lit(1)).over(by))
    turns = turns.withColumn("digest", F.sha2(F.to_json(F.struct("n", "role", "text")), 256))
    part = lambda k: F.expr(f"bit_xor(cast(conv(substring(digest, {16 * k + 1}, 16), 16, -10) as bigint))").over(by)
    return turns.select("conv_id", "n", "role", "text", *(part(k).alias(x) for k, x in enumerate(HASH)))


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of conversations that no other one continues."""
    turns = prefixes(conversations)
    rendered = F.concat(F.lit(START), "role", F.lit("\n"), "text", F.lit(END))
    whole = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"max_by(struct({', '.join(HASH)}), n)").alias("h"),
        F.sort_array(F.collect_list(F.struct("n", rendered.alias("r")))).alias("parts"),
    ).select("conv_id", "n", "h.*", F.array_join(F.col("parts.r"), "\n").alias("rendered"))
    # Copies first: one row each remains, so no key of the join below is hot.
    first = whole.groupBy("n", *HASH).agg(F.min(F.struct(F.col("conv_id").isNotNull(), "conv_id")).alias("m"), F.count(F.lit(1)).alias("n_copies")).select("n", *HASH, F.col("m.conv_id").alias("conv_id"), "n_copies")
    ends = turns.select("conv_id", "n", *HASH).withColumn("later", F.lead("n").over(Window.partitionBy("conv_id").orderBy("n")))
    inner = ends.filter("later is not null").select("n", *HASH).distinct()
    kept = first.join(inner, ["n", *HASH], "left_anti").select("conv_id", "n_copies")
    return whole.join(kept, whole.conv_id.eqNullSafe(kept.conv_id)).select(whole.conv_id, F.col("n").alias("n_turns"), "n_copies", "rendered")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations that no other one continues, rendered."""
    return maximal(table(spark, sf_dir, "conversations"))


OP10_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
p AS (SELECT conv_id, n, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>', chr(10)) OVER (PARTITION BY conv_id ORDER BY n) AS rendered FROM o),
c AS (SELECT conv_id, max(n) AS n_turns, max_by(rendered, n) AS rendered FROM p GROUP BY conv_id),
f AS (SELECT min(conv_id) AS conv_id, n_turns, rendered, count(*) AS n_copies FROM c GROUP BY n_turns, rendered)
SELECT conv_id, n_turns, n_copies, rendered FROM f
WHERE NOT EXISTS (SELECT 1 FROM p JOIN c USING (conv_id) WHERE p.n < c.n_turns AND p.n = f.n_turns AND p.rendered = f.rendered)
"""
