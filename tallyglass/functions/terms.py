"""Governed business terms as reusable aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyglass.functions.money import money_sum

# Order states that count as returned.
RETURNED_STATUSES = ("canceled", "unavailable")


def revenue(price: Column | str = "price") -> Column:
    """Total product value at item grain."""
    return money_sum(price)


def aov(price: Column | str = "price", order_id: str = "order_id") -> Column:
    """Average order value: revenue over distinct orders, null when there is no order."""
    return F.try_divide(money_sum(price), F.count_distinct(F.col(order_id)))


def seller_rating(score: str = "review_score") -> Column:
    """Mean review score."""
    return F.avg(F.col(score))


def return_rate(
    order_id: str = "order_id", status: str = "order_status", returned=RETURNED_STATUSES
) -> Column:
    """Share of distinct orders in a returned state, null when there is no order."""
    hit = F.when(F.col(status).isin(*returned), F.col(order_id))
    return F.try_divide(F.count_distinct(hit).cast("double"), F.count_distinct(F.col(order_id)))
