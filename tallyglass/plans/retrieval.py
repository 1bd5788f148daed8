"""Hybrid retrieval for a table of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.joins import BROADCAST_ROWS, fits
from tallyglass.operators.bm25 import Bm25Index, bm25, build_index
from tallyglass.operators.fusion import POOL, overlap_scorer, rerank, rrf
from tallyglass.operators.knn import knn
from tallyglass.session import shared_dir


def fused_candidates(
    queries: DataFrame, corpus: DataFrame, index: Bm25Index | None = None, pool: int = POOL
) -> DataFrame:
    """Vector and keyword lists of ``pool`` rows each, fused to ``pool`` candidates per query.

    Without an ``index`` one is built and written to the shared folder first.
    """
    index = index or build_index(corpus).save(shared_dir(corpus.sparkSession))
    return rrf(knn(queries, corpus, pool), bm25(queries, index, pool), k=pool)


def with_pair(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, pool: int = POOL) -> DataFrame:
    """Candidates with their query text and passage.

    There are at most ``pool`` candidates per query, so a bound on the queries bounds the candidates:
    within it they are broadcast and the corpus is read in place, passages of no candidate are
    dropped by the scan's own task. Beyond it both sides are shuffled by chunk id.
    """
    cols = [c for c in ("chunk_id", "source", "doc_type", "section", "content") if c in corpus.columns]
    passages, texts = corpus.select(*cols), queries.select("query_id", "text")
    if fits(queries, BROADCAST_ROWS // pool):
        return passages.join(F.broadcast(candidates), "chunk_id").join(F.broadcast(texts), "query_id")
    return passages.join(candidates, "chunk_id").join(texts, "query_id")


def retrieve(
    queries: DataFrame,
    corpus: DataFrame,
    top_k: int = 5,
    index: Bm25Index | None = None,
    scorer: Callable[[Column, Column], Column] = overlap_scorer,
    pool: int = POOL,
) -> DataFrame:
    """End to end: 50 by vector, 50 by keyword, fused to 50, reranked to ``top_k`` per query.

    ``queries``: query_id, text, embedding and optionally doc_type. ``corpus``: chunk_id, doc_type,
    content, embedding (null keeps a chunk out of the vector list) and any of source, section.
    """
    fused = fused_candidates(queries, corpus, index, pool)
    return rerank(with_pair(fused, queries, corpus, pool), scorer, top_k)


def trace(
    queries: DataFrame,
    corpus: DataFrame,
    top_k: int = 5,
    index: Bm25Index | None = None,
    scorer: Callable[[Column, Column], Column] = overlap_scorer,
    pool: int = POOL,
) -> DataFrame:
    """Every candidate with rank and score of each stage; final_rank is null below ``top_k``.

    The rerank position is taken over the fused pool, so both top lists are columns of one table.
    """
    fused = fused_candidates(queries, corpus, index, pool)
    ranked = rerank(with_pair(fused, queries, corpus, pool), scorer, pool)
    return ranked.withColumns(
        {
            "final_rank": F.when(F.col("final_rank") <= top_k, F.col("final_rank")),
            "in_rrf_top": F.col("rrf_rank") <= top_k,
            "in_rerank_top": F.col("final_rank") <= top_k,
        }
    )
