"""SQL that gives the classes of near copies by comparing all documents that share a shingle."""

OP9_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, g, count(*) AS n FROM s GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.n, b.n)) AS m FROM c a JOIN c b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN t x ON x.doc_id = p.a JOIN t y ON y.doc_id = p.b WHERE m >= 0.8 * (x.t + y.t - m) - 1e-9),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM w),
r AS (SELECT a AS d, b AS k FROM e UNION SELECT r.d, e.b FROM r JOIN e ON r.k = e.a)
SELECT d AS doc_id, min(k) AS class_id, min(k) = d AS is_first FROM r GROUP BY d
"""
