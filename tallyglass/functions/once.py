"""Values that are computed once, however often they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas share no subexpressions, but a lambda's argument is one."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns that a later filter reads instead of repeating their expressions.

    A filter on a plain column is pushed below it, where each mention of a column becomes its whole expression; it is
    not pushed below a generator that makes the column. The outer form adds no filter of its own.
    """
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
