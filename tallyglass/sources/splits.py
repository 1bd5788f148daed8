"""Input layout."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, key: str) -> DataFrame:
    """A file-backed table over all cores when it has fewer input partitions than there are cores.

    Such a table is small: at most a partition's bytes for each core. Any other is returned as it is, since
    moving it would be a shuffle for nothing.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df
