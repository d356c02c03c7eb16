"""The corpus pipeline: stages keep their columns, and each does what its operator says."""

import brute

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)
        ids = {r.doc_id for r in docs.collect()}
        assert ids <= before, name
        before = ids
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(set(brute.near_classes(texts.items()).values())) == len(texts)
    assert all(len(brute.WORD.findall(t)) for t in texts.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == len(texts)
    assert corpus_pipeline.run(spark, SF).count() == len(texts)


def test_stages_on_odd_rows(spark):
    """Nulls, empty texts, repeated rows, an empty table, and columns with names of the stages' own."""
    text = "Some prose of ten words or more that stands in a document, and then some. " * 3
    rows = [(1, None, "en", 0, "a", 1), (2, "", "en", 0, "b", 2), (3, text, None, 9, "c", 3), (3, text, None, 9, "c", 3), (None, " ".join(f"w{i}" for i in range(40)), "xx", 9, "d", 4), (4, "x" * 5000, "en", 5000, "e", 5), (None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, row string, kept int")
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == df.columns, name
            assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema], name
            assert out.count() <= df.count()
        corpus_pipeline.STAGES[-1][1](spark, df, SF).count()
    assert corpus_pipeline.near_dedup(spark, docs, SF).filter("doc_id = 3").count() == 1
