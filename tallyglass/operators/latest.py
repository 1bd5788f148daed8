"""Top rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key in ``order``, with their position.

    Catalyst puts a group limit under the shuffle for ``row_number() <= k`` (``k`` up to
    ``spark.sql.optimizer.windowGroupLimitThreshold``): each map task ships at most ``k`` rows per
    key, which keeps a hot key small.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_per_key_in_shares(
    df: DataFrame, keys: list[str], order: list[Column], k: int, spread: str, rank: str = "rank", shares: int = 16
) -> DataFrame:
    """As :func:`top_per_key`, in two steps: first among a share of a key's rows, dealt by a hash of ``spread``.

    For rows that come as the best ``k`` of every task: no task then ranks rows of all tasks for a key.
    """
    dealt = df.withColumn("_share", F.pmod(F.xxhash64(spread), F.lit(shares)))
    return top_per_key(top_per_key(dealt, [*keys, "_share"], order, k, "_nth").drop("_nth", "_share"), keys, order, k, rank)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tiebreak: list[str] = ()) -> DataFrame:
    """One row per key: newest ``ts`` first, null stamps last, then ``tiebreak`` ascending."""
    order = [F.col(ts).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tiebreak]]
    return top_per_key(df, keys, order, 1, "_rn").drop("_rn")
