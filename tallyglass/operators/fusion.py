"""Reciprocal-rank fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.text import keyword_tokens
from tallyglass.operators.latest import top_per_key

RRF_C = 60
POOL = 50


def rrf(vector: DataFrame, keyword: DataFrame, c: int = RRF_C, k: int = POOL) -> DataFrame:
    """Union of both ranked lists, scored ``1/(c+rank)`` per list, best ``k`` per query.

    ``vector``: query_id, chunk_id, distance, rank. ``keyword``: query_id, chunk_id, score, rank.
    Both lists are stacked and folded per (query, chunk), one shuffle instead of the two of a full
    join; a chunk in both keeps both of its stage scores. Equal scores keep the order vector rank,
    then keyword rank.
    """
    null_d, null_i = F.lit(None).cast("double"), F.lit(None).cast("int")
    v = vector.select(
        "query_id", "chunk_id", F.col("rank").alias("vector_rank"), null_i.alias("bm25_rank"),
        F.col("distance").alias("vector_distance"), null_d.alias("bm25_score"),
    )
    w = keyword.select(
        "query_id", "chunk_id", null_i.alias("vector_rank"), F.col("rank").alias("bm25_rank"),
        null_d.alias("vector_distance"), F.col("score").alias("bm25_score"),
    )
    cols = ["vector_rank", "bm25_rank", "vector_distance", "bm25_score"]
    both = v.unionByName(w).groupBy("query_id", "chunk_id").agg(*[F.max(x).alias(x) for x in cols])

    def share(rank: str) -> Column:
        return F.coalesce(F.lit(1.0) / (F.lit(c) + F.col(rank)), F.lit(0.0))

    scored = both.withColumn("rrf_score", share("vector_rank") + share("bm25_rank"))
    order = [
        F.col("rrf_score").desc(),
        F.col("vector_rank").asc_nulls_last(),
        F.col("bm25_rank").asc_nulls_last(),
    ]
    return top_per_key(scored, ["query_id"], order, k, "rrf_rank")


def overlap_scorer(query: Column, content: Column) -> Column:
    """Share of the distinct query tokens that stand in the passage; the default pair scorer."""
    q = F.array_distinct(keyword_tokens(query))
    c = keyword_tokens(content)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, c)).cast("double"), F.size(q)), F.lit(0.0))


def rerank(
    candidates: DataFrame, scorer: Callable[[Column, Column], Column] = overlap_scorer, k: int = 5
) -> DataFrame:
    """Score every (text, content) pair and keep the best ``k`` per query; ties keep the fused order.

    ``scorer`` maps two columns to a score: an expression, or a ``pandas_udf`` around a model. It
    sees the pool of at most 50 pairs per query, nothing else.
    """
    scored = candidates.withColumn("reranker_score", scorer(F.col("text"), F.col("content")))
    order = [F.col("reranker_score").desc(), F.col("rrf_rank").asc()]
    return top_per_key(scored, ["query_id"], order, k, "final_rank")
