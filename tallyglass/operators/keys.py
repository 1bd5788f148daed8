"""Key checks that stand in for enforced constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def _all_set(cols: list[str]):
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def check_pk(df: DataFrame, cols: list[str], table: str = "") -> DataFrame:
    """One row: rows, rows with a null key, duplicated keys, rows under duplicated keys, verdict.

    Rows are counted per key with a map-side combine, so a key that holds a third of the table
    arrives at its reducer as one count per map task.
    """
    per_key = df.groupBy(*cols).agg(F.count("*").alias("_n"))
    whole = _all_set(cols)
    dup = whole & (F.col("_n") > 1)
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.when(~whole, F.col("_n"))), F.lit(0)).alias("n_null"),
        F.count_if(dup).alias("n_dup_keys"),
        F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0)).alias("n_dup_rows"),
    ).withColumn("ok", (F.col("n_null") == 0) & (F.col("n_dup_keys") == 0))


def duplicate_keys(df: DataFrame, cols: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*cols).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, cols: list[str], what: str = "dataset") -> DataFrame:
    """``df`` itself; raises ValueError naming one duplicated key if there is any."""
    bad = duplicate_keys(df, cols).limit(1).collect()
    if bad:
        key = ", ".join(repr(bad[0][c]) for c in cols)
        raise ValueError(f"duplicate key in {what}: {key}")
    return df


def fk_orphans(child: DataFrame, cols: list[str], parent: DataFrame, parent_cols: list[str]) -> DataFrame:
    """Distinct child keys without a parent, with the number of child rows. A null key passes.

    Both sides are reduced to one row per key before the anti join, so neither a hot key nor the width
    of a table reaches it.
    """
    keys = child.where(_all_set(cols)).groupBy(*cols).agg(F.count("*").alias("n_rows"))
    ref = parent.select(*[F.col(p).alias(c) for c, p in zip(cols, parent_cols)]).distinct()
    return keys.join(ref, cols, "left_anti")


def check_fk(
    child: DataFrame, cols: list[str], parent: DataFrame, parent_cols: list[str], name: str = ""
) -> DataFrame:
    """One row: orphan keys, orphan rows, verdict."""
    return (
        fk_orphans(child, cols, parent, parent_cols)
        .agg(
            F.lit(name).alias("constraint_name"),
            F.count("*").alias("n_orphan_keys"),
            F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_orphan_rows"),
        )
        .withColumn("ok", F.col("n_orphan_keys") == 0)
    )
