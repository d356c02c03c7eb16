"""Patterns and shapes on texts that Java and RE2 read apart, and fragments by their places."""

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mailsift.operators import models
from mailsift.plans import catalogue

ODD = [
    "Eur\u00e8s et 5 eur\u00e9s, rs\u00e9 rs. 5 rs.5 5usd dollar\u017f \u20ac", "\u00e95 5\u00e9 1,000.50\u00fc 12_3 _7", "than\u212as be\u017ft wi\u017fhes", "a\x0bb. \x0b. c\u00a0d!", "x\u2028click here\rverify\u0085open\nclick\u00e9 \u00e9", "opt\ru opt\nout opt\u2028out",
    "\x0bdear me", "\t dear you", "\u24b6\u24b7\u24b8 \u24b6\u24b7\u24b8", "ABC \x0b \u00c9T\u00c9 ABCd", "", " ", "...", "a.b.c", " . ! x", "one two. three!? four", "\x0bre: x", "Re\x0b: x", "+49\x0b123456789 123-456-78901",
]


def test_shapes_equal_their_sql_on_odd_texts(spark, tmp_path):
    rows = [(i, t, "s", "en") for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("body_shape", "subject_shape"):
        got, want = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalogue.SQL[name]).df()
        got, want = (x.sort_values("message_id").reset_index(drop=True) for x in (got, want))
        assert {c: [(ODD[i], got[c][i], want[c][i]) for i in range(len(ODD)) if got[c][i] != want[c][i]] for c in want} == {c: [] for c in want}


def test_fragments_stand_at_the_places_of_vectors(spark):
    texts, n = ["Verify NOW", "\u00dcber \U0001f600\U0001f600 x", "ab", "", None], 1 << 18
    low = [(t or "").lower() for t in texts]
    vectors = models._vectors(pa.array(texts), pa.array([n] * len(texts))).to_pylist()
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = {r.i: r.f for r in rows.select("i", models.char_fragments(F.col("text"), n).alias("f")).collect()}
    for i, t in enumerate(low):
        want = {t[a : a + k] for k in models.FRAGMENTS for a in range(len(t) - k + 1)}
        assert {f.term for f in found[i]} == want and len(found[i]) == len(want)
        assert sorted({f.at for f in found[i]}) == vectors[i]["indices"] and vectors[i]["size"] == n and set(vectors[i]["values"]) <= {1.0}
    models.with_functions(spark)
    in_sql = rows.selectExpr("i", f"{models.HASHED}(text, {n}) v").collect()
    assert all(np.array_equal(r.v.indices, vectors[r.i]["indices"]) for r in in_sql)
