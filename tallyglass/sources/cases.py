"""Labelled evaluation cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyglass.operators.keys import require_unique

EVAL_SCHEMA = (
    "id string, text string, category string, expected_route string, expected_measure string, "
    "expected_glossary array<string>, expected_status string, expected_sources array<string>, "
    "expects_hedge boolean, expects_revision boolean, expects_recovery boolean, note string"
)
ADVERSARIAL_SCHEMA = "id string, sql string, fails string, reason_fragments array<string>, note string"
# Allowed categories and layers.
CATEGORIES = ("sql_positive", "rag_positive", "hybrid_positive", "sql_oos", "rag_oos")
LAYERS = ("is_read_only", "schema_valid", "joins_safe", "row_limit_enforced")


def load_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Typed cases from JSON lines; fails on a duplicated id or an unknown category."""
    df = spark.read.schema(EVAL_SCHEMA).option("mode", "FAILFAST").json(path)
    return _only(require_unique(df.na.fill({"expects_hedge": False}), ["id"], "eval cases"), "category", CATEGORIES)


def load_adversarial_set(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(ADVERSARIAL_SCHEMA).option("mode", "FAILFAST").json(path)
    return _only(require_unique(df, ["id"], "adversarial cases"), "fails", LAYERS)


def _only(df: DataFrame, col: str, allowed: tuple[str, ...]) -> DataFrame:
    bad = df.where(~df[col].isin(*allowed) | df[col].isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"unknown {col}: {bad[0][col]!r}")
    return df
