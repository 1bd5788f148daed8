"""Exact money arithmetic that stays on primitive longs inside code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def cents(amount: Column | str) -> Column:
    """Amount as whole cents (BIGINT), half up.

    Adding longs gives the same total in any order of partial sums, so totals do not change with the
    partitioning, and is far cheaper than summing DECIMAL. Under ANSI mode an overflow raises.
    """
    col = F.col(amount) if isinstance(amount, str) else amount
    return F.floor(col * 100 + 0.5)


def money_sum(amount: Column | str) -> Column:
    """Aggregate: exact total of a two-decimal DOUBLE amount, as DOUBLE."""
    return F.sum(cents(amount)) / F.lit(100)


def from_cents(total: Column | str) -> Column:
    col = F.col(total) if isinstance(total, str) else total
    return col / F.lit(100)
