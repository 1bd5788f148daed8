"""Markdown corpus reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Folder of a document -> its type.
DOC_TYPES = {"data_dictionary": "data_dictionary", "policy": "policy", "categories": "category_def"}


def read_corpus(spark: SparkSession, root: str, doc_types: dict[str, str] = DOC_TYPES, pattern: str = "*.md") -> DataFrame:
    """``source`` (file name), ``doc_type`` (from its folder), ``content`` (the whole file)."""
    paths = [f"{root.rstrip('/')}/{folder}/{pattern}" for folder in doc_types]
    files = spark.read.text(paths, wholetext=True).withColumn("_path", F.input_file_name())
    parts = F.split("_path", "/")
    lookup = F.create_map(*[F.lit(x) for pair in doc_types.items() for x in pair])
    return files.select(
        F.url_decode(F.element_at(parts, -1)).alias("source"),
        F.element_at(lookup, F.element_at(parts, -2)).alias("doc_type"),
        F.col("value").alias("content"),
    )
