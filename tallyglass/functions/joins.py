"""Joins that broadcast only after a check of the small side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows a side may have to be sent to every executor. With rows of a few dozen bytes this stays in
# the low megabytes; wider rows must pass a smaller bound.
BROADCAST_ROWS = 50_000
SALTS = 32
# A key with more than one in so many rows is hot; there are fewer hot keys than this.
HOT_PARTS = 1_000


def fits(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``max_rows`` rows; each task stops after that many plus one."""
    return df.limit(max_rows + 1).count() <= max_rows


def salted_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], salts: int = SALTS
) -> DataFrame:
    """Inner equi-join that shares the rows of one key among ``salts`` tasks.

    Rows of the large side go to a bucket by their ``spread`` columns and the small side is repeated
    once per bucket.
    """
    salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_big.join(salted_small, [*on, "_salt"]).drop("_salt")


def bounded_join(
    big: DataFrame, small: DataFrame, on: list[str], spread: list[str], max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Inner equi-join of a large side with one that is usually small.

    A small side of checked size is broadcast, so the large side does not move; beyond the bound the
    join is salted.
    """
    return big.join(F.broadcast(small), on) if fits(small, max_rows) else salted_join(big, small, on, spread)


def split_hot_join(big: DataFrame, small: DataFrame, on: list[str], parts: int = HOT_PARTS) -> DataFrame:
    """Inner equi-join of ``big`` with one row per key, where a key may hold any share of ``big``.

    A key with more than a ``parts``-th of all rows is hot. There are fewer than ``parts`` such keys whatever the
    data, so their list is broadcast. Rows of a hot key are dealt by a hash of their other columns to as many
    shares as it holds ``parts``-ths, and only its row of ``small`` is repeated; others join as they are.
    """
    counts = big.groupBy(*on).agg(F.count("*").alias("_n"))
    total = big.agg(F.count("*")).scalar()
    hot = counts.where(F.col("_n") > total / parts).select(*on, F.ceil(F.col("_n") * parts / total).cast("int").alias("_shares"))
    share = F.pmod(F.xxhash64(*big.columns), F.coalesce("_shares", F.lit(1))).cast("int")
    dealt = big.join(F.broadcast(hot), on, "left").withColumn("_salt", share).drop("_shares")
    copies = F.sequence(F.lit(0), F.coalesce("_shares", F.lit(1)) - 1)
    copied = small.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(copies)).drop("_shares")
    return dealt.join(copied, [*on, "_salt"]).drop("_salt")
