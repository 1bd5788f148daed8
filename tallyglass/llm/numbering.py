"""Gapless numbers inside groups, without bringing a group together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.llm.store import written


def numbered(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """``df`` with a column ``name`` that counts the rows of each ``group`` from 0 in ``order``.

    Rows are dealt by ranges of (group, order), so a large group lies in several partitions. A partition numbers its
    sorted rows as it is written; the rows of a group in earlier partitions are added from a table with one row per
    group and partition. Rows that are equal in ``order`` get their numbers in any order.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    sorted_rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    dealt = written(sorted_rows.withColumn("_mid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_mid", 33)
    pieces = dealt.groupBy(F.col(group).alias("_group"), part.alias("_part")).agg(
        F.min("_mid").alias("_low"), F.count("*").alias("_rows")
    )
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    pieces = written(pieces.select("_group", "_part", (F.col("_before") - F.col("_low")).alias("_shift")), "pieces")
    same = (F.col("_group").eqNullSafe(F.col(group))) & (F.col("_part") == part)
    return dealt.join(pieces, same).withColumn(name, F.col("_mid") + F.col("_shift")).drop("_group", "_part", "_mid", "_shift")


def running_sums(df: DataFrame, by: str, sums: list[str]) -> DataFrame:
    """``df`` with each column of ``sums`` replaced by its sum over all rows up to this one in the order of ``by``.

    ``by`` has no repeated values. Rows are dealt by ranges; what earlier ranges hold comes from a row for each range.
    """
    dealt = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("_mid", F.monotonically_increasing_id()), "running")
    dealt = dealt.withColumn("_part", F.shiftright("_mid", 33))
    ranges = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_{c}") for c in sums))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = ranges.select("_part", *(F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums))
    own = Window.partitionBy("_part").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = dealt.join(ranges, "_part")
    return met.withColumns({c: F.sum(c).over(own) + F.col(f"_{c}") for c in sums}).drop("_part", "_mid", *(f"_{c}" for c in sums))
