"""From raw documents to tokens: quality rules, line dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before has kept. All but the
last return the columns they were given; the last returns each document's tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import bpe, decontaminate, linededup, neardup, quality
from mailsift.llm.common import cut, table

#: A word-aware tokenizer ends the pipeline, so no SQL gives its rows.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their language's perplexity bands go."""
    return quality.judge(docs).filter("kept").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines and long lines go, but for the first; so do documents of which no word is left by that."""
    out = linededup.dedup_lines(docs, long=True)
    out = out.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    now = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        now["n_chars"] = F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(now.get(x, F.col("row").getField(x)).alias(x) for x in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies, the document with the smallest id stays."""
    return neardup.first_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.filter(F.size("hits") == 0).select("row.*")


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document that is left."""
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each over the written rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
