"""Fan-out audit and the grain-safe join."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.functions.joins import split_hot_join
from tallyglass.functions.money import cents


def fanout_audit(base: DataFrame, other: DataFrame, on: list[str], measure: str) -> DataFrame:
    """True total of ``measure`` against its total after joining ``other`` on ``on``.

    Both sides are reduced to one row per key first and the joined total is the product of a sum and
    a count, so the multiplied rows are never made.
    """
    left = base.groupBy(*on).agg(F.sum(cents(measure)).alias("_cents"))
    right = other.groupBy(*on).agg(F.count("*").alias("_mult"))
    return (
        left.join(right, on, "left")
        .agg(
            F.sum("_cents").alias("_true"),
            F.sum(F.col("_cents") * F.coalesce("_mult", F.lit(0))).alias("_joined"),
            F.coalesce(F.max("_mult"), F.lit(0)).alias("max_multiplicity"),
        )
        .select(
            (F.col("_true") / 100).alias("true_total"),
            (F.col("_joined") / 100).alias("joined_total"),
            F.try_divide(F.col("_joined").cast("double"), F.col("_true").cast("double")).alias("inflation"),
            "max_multiplicity",
        )
    )


def pre_aggregate_then_join(
    base: DataFrame, many: DataFrame, on: list[str], amount: str, out: str
) -> DataFrame:
    """``base`` with the total of ``many.amount`` per key: many is one row per key before the join.

    ``base`` may repeat a key at any rate: rows of a hot key are dealt to many tasks.
    """
    totals = many.groupBy(*on).agg((F.sum(cents(amount)) / 100).alias(out))
    return split_hot_join(base, totals, on)
