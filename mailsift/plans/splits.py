"""Splits by quota over labelled messages: copies of one text are a group."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.operators import splits
from mailsift.sources.tables import table, view

from .catalogue import query

_ROWS = "m AS (SELECT message_id, 'group:' || sha1(coalesce(body, '')) AS g, toxic FROM fx_messages LEFT JOIN labels ON doc_id = message_id)"


def _rows(spark, d):
    m = view(spark, d, "fx_messages").select("message_id", F.sha1(F.coalesce("body", F.lit(""))).alias("copy_of"))
    return m.join(table(spark, d, "labels").select(F.col("doc_id").alias("message_id"), "toxic"), "message_id", "left")


@query(
    "quota_split",
    f""", {_ROWS}, s AS (SELECT md5('split|' || g) AS k, count(*) AS n, CASE WHEN count(toxic) = 0 THEN -1 ELSE CAST(2 * count(*) FILTER (toxic = 1) >= count(toxic) AS INT) END AS c FROM m GROUP BY g),
    o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY k) AS i, CAST(floor(2 * 0.25 * sum(n) OVER (PARTITION BY c)) AS BIGINT) AS twice FROM s),
    z AS (WITH RECURSIVE t AS (SELECT c, i, k, twice, CASE WHEN n <= twice THEN n ELSE 0 END AS taken, n <= twice AS test FROM o WHERE i = 1
        UNION ALL SELECT o.c, o.i, o.k, o.twice, CASE WHEN 2 * t.taken + o.n <= o.twice THEN t.taken + o.n ELSE t.taken END, 2 * t.taken + o.n <= o.twice FROM t JOIN o ON o.c = t.c AND o.i = t.i + 1) SELECT * FROM t)
    SELECT message_id, toxic, CASE WHEN test THEN 'test' ELSE 'train' END AS part FROM m JOIN z ON z.k = md5('split|' || m.g)""",
    "fx_messages",
)
def _(spark, d):
    return splits.quota_split(_rows(spark, d), "copy_of", "toxic").select("message_id", "toxic", "part")


@query(
    "filled_pools",
    f""", {_ROWS}, s AS (SELECT md5('pools|' || g) AS k, count(*) AS n FROM m GROUP BY g), o AS (SELECT k, sum(n) OVER (ORDER BY k) AS upto, sum(n) OVER (ORDER BY k) - n AS before, sum(n) OVER () // 5 AS target FROM s),
    a AS (SELECT coalesce(max(upto) FILTER (before < target), 0) AS cal FROM o), p AS (SELECT k, CASE WHEN before < target THEN 'cal' WHEN before < cal + target THEN 'stack' ELSE 'fit' END AS pool FROM o, a)
    SELECT message_id, pool FROM m JOIN p ON p.k = md5('pools|' || m.g)""",
    "fx_messages",
)
def _(spark, d):
    rows = _rows(spark, d)
    fifth = rows.count() // 5
    return splits.filled_pools(rows, "copy_of", {"cal": fifth, "stack": fifth}).select("message_id", "pool")
