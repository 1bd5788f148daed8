"""Result envelopes of evaluation dimensions and retrieval traces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Envelope:
    """One dimension's stored result: a one-row summary (with its timestamp) and its cases."""

    dimension: str
    summary: DataFrame
    cases: DataFrame


def save_results(dimension: str, summary: DataFrame, cases: DataFrame, root: str) -> str:
    """Write one dimension, replacing its last run.

    Cases stay a JSON table of their own next to the summary: nesting all of them in one document
    would gather the whole table in one task.
    """
    base = f"{root.rstrip('/')}/{dimension}"
    cases.write.mode("overwrite").json(f"{base}/cases")
    head = summary.select(
        F.lit(dimension).alias("dimension"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
        F.struct("*").alias("summary"),
    )
    head.coalesce(1).write.mode("overwrite").json(f"{base}/summary")
    return base


def load_results(spark: SparkSession, dimension: str, root: str, case_schema: str | None = None) -> Envelope | None:
    """A stored dimension, or None when it was never written."""
    base = f"{root.rstrip('/')}/{dimension}"
    reader = spark.read.schema(case_schema) if case_schema else spark.read
    try:
        return Envelope(dimension, spark.read.json(f"{base}/summary"), reader.json(f"{base}/cases"))
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            return None
        raise


def export_trace(trace: DataFrame, path: str) -> None:
    """All stages of all queries as JSON, a folder per query block so that one query reads little."""
    trace.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(64))).write.mode("overwrite").partitionBy("block").json(path)
