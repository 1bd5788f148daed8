"""Vector expressions over ARRAY columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec_to_text(vec: Column | str) -> Column:
    """``[a,b,...]`` text form of a vector."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(vec), lambda x: x.cast("string")), ","), F.lit("]"))


def text_to_vec(text: Column | str) -> Column:
    return F.from_json(_col(text), "array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine similarity; null when a vector has no length.

    For single pairs (re-scoring, audits). Searches use the blocked kernel in ``operators.knn``.
    """
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))
