"""Audit tables and reports as files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables that end a lineage; a temporary one in local mode only."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (conf.get("spark.master") or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='mailsift-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, computed once and read from there; removed when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_decisions(decisions: DataFrame, path: str) -> None:
    """Decisions without content, by day; evidence is cut to six titles of 200 characters, references to 128."""
    x = decisions
    if "top_evidence" in x.columns:
        x = x.withColumn("top_evidence", F.transform(F.slice("top_evidence", 1, 6), lambda t: F.substring(t, 1, 200)))
    if "client_reference" in x.columns:
        x = x.withColumn("client_reference", F.substring("client_reference", 1, 128))
    x.withColumn("day", F.to_date("created_ts")).write.mode("append").partitionBy("day").parquet(path)


def append_feedback(feedback: DataFrame, decisions: DataFrame, path: str) -> DataFrame:
    """Appends feedback on known decisions and returns what was refused."""
    known = decisions.select("decision_id").distinct()
    feedback.join(known, "decision_id", "left_semi").write.mode("append").parquet(path)
    return feedback.join(known, "decision_id", "left_anti")


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """All decisions, old files without trace_id included; broken member scores are empty."""
    x = spark.read.option("mergeSchema", True).parquet(path)
    x = x.withColumn("trace_id", F.coalesce(F.col("trace_id"), F.lit(""))) if "trace_id" in x.columns else x.withColumn("trace_id", F.lit(""))
    if "member_scores" in x.columns and dict(x.dtypes)["member_scores"] == "string":
        x = x.withColumn("member_scores", F.coalesce(F.from_json("member_scores", "map<string,double>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))))
    return x


def write_queue(triage: DataFrame, path: str) -> None:
    """The work queue as CSV, in order."""
    triage.write.mode("overwrite").csv(path, header=True)


def write_report(metrics: DataFrame, path: str) -> None:
    """A table of metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def flatten_report(report: DataFrame) -> DataFrame:
    """(metric, value): the numeric columns of a one-row report."""
    numeric = [f.name for f in report.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "decimal")]
    return report.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric))).alias("x")).select("x.*")


def incremental(spark: SparkSession, path: str, schema, sink: str, checkpoint: str):
    """New files of a folder appended to a table; progress is durable, so a restart goes on where it stopped."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
