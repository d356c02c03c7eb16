"""Streaming scoring: each micro-batch of scored messages is decided and written to decisions, and to cases where held.

A micro-batch writes folders named by its number and overwrites them when it is tried again, so a stream
that is restarted after a failure leaves each message in the tables once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mailsift.operators import decide, drift


def decisions_stream(scored: DataFrame, model: decide.Fusion, decisions: str, cases: str, checkpoint: str, controls: decide.Controls = decide.Controls(), **trigger) -> StreamingQuery:  # noqa: B008
    """Starts the stream over (id, members, context); rows held for review also become open cases."""

    def write(batch: DataFrame, number: int) -> None:
        decided = decide.decide(batch, model, controls)
        path = f"{decisions}/batch={number}"
        decide.verdicts(decided).write.mode("overwrite").parquet(path)
        held = batch.sparkSession.read.parquet(path).filter("band = 'REVIEW'")
        held.select(F.col("id").alias("case_id"), F.col("id").alias("decision_id"), F.lit("open").alias("state"), F.lit(2).alias("priority"), "score").write.mode("overwrite").parquet(f"{cases}/batch={number}")

    return scored.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drift_stream(decisions: DataFrame, reference: DataFrame, reports: str, checkpoint: str, least: int = 30, **trigger) -> StreamingQuery:
    """Starts a stream that writes each micro-batch's PSI of every monitored quantity against a static reference."""

    def write(batch: DataFrame, number: int) -> None:
        live = drift.long(drift.monitored(batch))
        report = drift.psi(reference, live).filter(F.col("n") >= least)
        report.write.mode("overwrite").parquet(f"{reports}/batch={number}")

    return decisions.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read(spark: SparkSession, path: str) -> DataFrame:
    """A table that a stream has written, with the number of the batch of each row."""
    return spark.read.parquet(path)
