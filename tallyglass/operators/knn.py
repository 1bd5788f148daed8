"""Exact and approximate nearest neighbours by cosine distance, for a table of queries.

No pair of a query and a corpus row ever becomes a Spark row. A task reads its part of the corpus in
Arrow batches, multiplies each with a block of queries and keeps ``k`` rows per query; only those
travel to the final top-k.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.operators.latest import top_per_key_in_shares
from tallyglass.operators.tasks import tidy
from tallyglass.operators.topk import BLOCK_CELLS, TopK, ids_of, output_types

# A block of queries is sent to every executor: 4,096 vectors of 384 doubles are 12 MB.
QUERY_BLOCK = 4_096
# About so many rows fit the centres of cells.
TRAIN_ROWS = 200_000
# A tile of 32,768 rows of 384 doubles is 100 MB in the Python worker.
TILE_ROWS = 32_768


@dataclass
class _Block:
    ids: list
    unit: np.ndarray  # queries x dims, unit length; a zero row has no direction
    scopes: list  # metadata filter per query, None = all
    probes: list | None = None  # cells per query


def _matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", m, m))[:, None]
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _block_of(table: pa.Table) -> _Block:
    return _Block(
        table.column("query_id").to_pylist(), _unit(_matrix(table.column("embedding"))), table.column("scope").to_pylist()
    )


def _sides(queries: DataFrame, corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    scope = F.col("doc_type") if "doc_type" in queries.columns else F.lit(None).cast("string")
    q = queries.where("embedding is not null").select("query_id", "embedding", scope.alias("scope"))
    kind = F.col("doc_type") if "doc_type" in corpus.columns else F.lit("")
    c = corpus.where("embedding is not null").select("chunk_id", "embedding", kind.alias("doc_type"))
    return q, c


def _add(best: TopK, block: _Block, ids, kinds, unit: np.ndarray, queries=None) -> None:
    """Distances of a part of the corpus to (some of) the queries, in blocks of bounded size."""
    q_unit = block.unit if queries is None else block.unit[queries]
    if not len(q_unit):
        return
    no_direction = ~q_unit.any(axis=1)
    step = max(1, BLOCK_CELLS // len(q_unit))
    for at in range(0, len(ids), step):
        part = unit[at : at + step]
        dist = 1.0 - part @ q_unit.T
        dist[~part.any(axis=1), :] = np.inf
        dist[:, no_direction] = np.inf
        best.add(ids[at : at + step], kinds[at : at + step], dist, queries=queries)


def _final(hits: DataFrame, k: int) -> DataFrame:
    hits = hits.withColumnRenamed("value", "distance")
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id").asc()]
    return top_per_key_in_shares(hits, ["query_id"], order, k, "chunk_id").select("query_id", "chunk_id", "distance", "rank")


def knn(queries: DataFrame, corpus: DataFrame, k: int = 50, max_queries: int = QUERY_BLOCK, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Exact ``k`` nearest corpus rows per query: ``query_id, chunk_id, distance, rank``.

    ``queries``: query_id, embedding and optionally doc_type (null = search all). ``corpus``:
    chunk_id, embedding and optionally doc_type. Up to ``max_queries`` queries are broadcast and the
    corpus is scanned in place. More queries and the corpus are cut by a hash of their ids into tiles
    of bounded size that meet through an equi-join on the tile pair; either way the result is exact.
    """
    q, c = _sides(queries, corpus)
    schema, ddl = output_types(queries, corpus)

    head = q.limit(max_queries + 1).toArrow()
    if head.num_rows <= max_queries:
        return _final(_scan(q.sparkSession, c, _block_of(head), k, schema, ddl), k)

    return _final(_tiles(q, c, k, schema, ddl, q.count(), c.count(), max_queries, tile_rows), k)


def _tiles(q, c, k, schema, ddl, n_queries, n_rows, max_queries, tile_rows, by=()) -> DataFrame:
    """Top ``k`` per query and tile pair, both sides with the same ``by`` columns.

    Tiles are cut by a hash of the row ids, so a value of ``by`` that holds a third of the corpus is
    spread like any other. Tiles are half full on average, which leaves room for an uneven hash.
    """
    n_q, n_c = max(1, -(-2 * n_queries // max_queries)), max(1, -(-2 * n_rows // tile_rows))

    def cut(df, key, own, n_own, other, n_other):
        every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n_own)).cast("int")).withColumn(other, every)

    keys = [*by, "_q", "_c"]
    left = cut(q, "query_id", "_q", n_q, "_c", n_c).groupBy(*keys)
    right = cut(c, "chunk_id", "_c", n_c, "_q", n_q).groupBy(*keys)

    def meet(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = None
        if queries.num_rows and rows.num_rows:
            block = _block_of(queries)
            best = TopK(block.ids, block.scopes, k)
            _add(best, block, ids_of(rows.column("chunk_id")), _scopes(rows), _unit(_matrix(rows.column("embedding"))))
            out = best.batch(schema)
        return pa.Table.from_batches([out] if out is not None else [], schema=schema)

    return left.cogroup(right).applyInArrow(meet, ddl)


def _scopes(t) -> np.ndarray:
    return np.asarray(t.column("doc_type").to_pylist(), dtype=object)


def _scan(spark, corpus: DataFrame, block: _Block, k: int, schema: pa.Schema, ddl: str) -> DataFrame:
    # Plain values: broadcasts are unpickled by name, without the code of their class.
    shared = spark.sparkContext.broadcast((block.ids, block.unit, block.scopes, block.probes))
    with_cells = block.probes is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(*shared.value)
        if not block.ids:
            return
        best = TopK(block.ids, block.scopes, k)
        by_cell: dict[int, list[int]] = {}
        for i, cells in enumerate(block.probes or []):
            for cell in cells:
                by_cell.setdefault(int(cell), []).append(i)
        for b in batches:
            if not b.num_rows:
                continue
            ids, scopes, unit = ids_of(b.column("chunk_id")), _scopes(b), _unit(_matrix(b.column("embedding")))
            if not with_cells:
                _add(best, block, ids, scopes, unit)
                continue
            cells = b.column("cell").to_numpy(zero_copy_only=False)
            for cell in np.unique(cells):
                rows = cells == cell
                _add(best, block, ids[rows], scopes[rows], unit[rows], by_cell.get(int(cell), []))
        out = best.batch(schema)
        if out is not None:
            yield out

    return corpus.mapInArrow(tidy(run), ddl)


# ---------------------------------------------------------------- approximate


def cell_count(rows: int) -> int:
    """Cells of an index: the square root of the rows, so that a cell and the list of cells are about as long."""
    return max(1, math.isqrt(max(rows - 1, 0)) + 1)


_DIRECTED = "embedding is not null and exists(embedding, x -> x <> 0)"


def fit_cells(corpus: DataFrame, n_cells: int = 16, seed: int = 7, fraction: float = 1.0, max_iter: int = 8) -> np.ndarray:
    """Centres of coarse cells (cosine k-means) of rows with a direction. ``fraction`` only thins the training rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    train = corpus.where(_DIRECTED)
    if fraction < 1.0:
        train = train.sample(fraction, seed)
    train = train.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=n_cells, seed=seed, distanceMeasure="cosine", maxIter=max_iter).fit(train)
    return _unit(np.asarray(model.clusterCenters()))


def assign_cells(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest centre of each row. Store it partitioned by ``cell``: a search then
    reads only the probed folders."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        m = np.vstack(vectors.to_numpy()).astype(np.float64)
        return pd.Series(np.argmax(m @ shared.value.T, axis=1).astype("int32"))

    return corpus.where("embedding is not null").withColumn("cell", nearest("embedding"))


@dataclass
class CellIndex:
    """Rows with their cell, in a folder for each cell, and the centres of the cells."""

    cells: DataFrame
    centres: np.ndarray


def build_cells(corpus: DataFrame, path: str, n_cells: int | None = None, train_rows: int = TRAIN_ROWS, seed: int = 7) -> CellIndex:
    """Write an index of all rows of ``corpus`` that have a vector.

    Centres are fitted on a sample of about ``train_rows`` rows; every row goes to the folder of its nearest centre, one without
    a direction to the first. A cell
    that holds a third of all rows is written by as many tasks as any other share of them.
    """
    spark = corpus.sparkSession
    rows, directed = corpus.where("embedding is not null").agg(F.count("*"), F.count_if(F.expr(_DIRECTED))).first()
    n_cells = max(1, min(n_cells or cell_count(rows), directed))
    if not rows:
        return CellIndex(corpus.limit(0).withColumn("cell", F.lit(0)), np.zeros((0, 1)))
    if directed:
        centres = fit_cells(corpus, n_cells, seed, min(1.0, max(train_rows, 20 * n_cells) / directed))
    else:
        centres = np.zeros((1, len(corpus.where("embedding is not null").first()["embedding"])))
    dealt = assign_cells(corpus, centres).repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(16)))
    dealt.write.mode("overwrite").partitionBy("cell").parquet(path)
    return CellIndex(spark.read.schema(dealt.schema).parquet(path), centres)


def choose_probes(queries: DataFrame, index: CellIndex, k: int = 10, target: float = 0.95, sample: int = 256) -> int:
    """Fewest cells to probe so that ``target`` of the exact neighbours of some queries lie in them.

    ``sample`` queries are taken by a hash of their id and answered by a scan of all rows; their ``sample`` x ``k`` neighbours
    tell how far down a query's list of cells it must go.
    """
    some = queries.where("embedding is not null").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    block = _block_of(_sides(some, index.cells)[0].toArrow())
    if not block.ids or not len(index.centres):
        return 1
    exact = knn(some, index.cells, k).join(index.cells.select("chunk_id", "cell"), "chunk_id").select("query_id", "cell").toArrow()
    order = _nearest(block.unit, index.centres, len(index.centres))
    depth = np.empty_like(order)
    np.put_along_axis(depth, order, np.arange(order.shape[1], dtype=order.dtype)[None, :], axis=1)
    at = {q: i for i, q in enumerate(block.ids)}
    own = np.array([at[q] for q in exact.column("query_id").to_pylist()], np.int64)
    needed = np.sort(depth[own, exact.column("cell").to_numpy()]) + 1
    return int(needed[min(len(needed) - 1, math.ceil(target * len(needed)) - 1)]) if len(needed) else 1


def ann(queries: DataFrame, cells: DataFrame, centres: np.ndarray, k: int = 50, n_probe: int = 4, max_queries: int = QUERY_BLOCK, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Nearest neighbours among the ``n_probe`` cells closest to each query, re-scored exactly.

    Up to ``max_queries`` queries are broadcast and only their cells are read. More of them meet the
    corpus through an equi-join on the cell, cut into tiles of bounded size.
    """
    q, _ = _sides(queries, cells)
    kind = F.col("doc_type") if "doc_type" in cells.columns else F.lit("")
    c = cells.select("chunk_id", "embedding", kind.alias("doc_type"), "cell")
    schema, ddl = output_types(queries, cells)

    head = q.limit(max_queries + 1).toArrow()
    if head.num_rows <= max_queries:
        block = _block_of(head)
        block.probes = list(_nearest(block.unit, centres, n_probe)) if block.ids else []
        wanted = sorted({int(x) for probed in block.probes for x in probed})
        return _final(_scan(q.sparkSession, c.where(F.col("cell").isin(wanted)), block, k, schema, ddl), k)

    shared = q.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("array<int>")
    def probes(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_nearest(_unit(np.vstack(vectors.to_numpy()).astype(np.float64)), shared.value, n_probe)))

    asked = q.withColumn("cell", F.explode_outer(probes("embedding")))
    largest = c.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    return _final(_tiles(asked, c, k, schema, ddl, q.count(), largest, max_queries, tile_rows, ["cell"]), k)


def _nearest(unit: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    return np.argsort(-(unit @ centres.T), axis=1)[:, :n].astype("int32")


# ---------------------------------------------------------------- exact, with bounds

# Queries of a bounded search that are sent out at once: each may need any number of cells.
BOUNDED_BLOCK = 512
# Room for the rounding of distances and of the arc cosine next to 1.
_SLACK, _ANGLE_SLACK = 1e-9, 1e-6


def _angles(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centres.T, -1.0, 1.0))


def cell_radii(index: CellIndex) -> np.ndarray:
    """Largest angle between the centre of a cell and its rows; rows without a direction do not count.

    One number a cell reaches the driver, as the centres did.
    """
    shared = index.cells.sparkSession.sparkContext.broadcast(index.centres)

    @F.pandas_udf("double")
    def angle(vectors: pd.Series, cells: pd.Series) -> pd.Series:
        unit = _unit(np.vstack(vectors.to_numpy()).astype(np.float64))
        out = np.arccos(np.clip(np.einsum("ij,ij->i", unit, shared.value[cells.to_numpy()]), -1.0, 1.0))
        return pd.Series(np.where(unit.any(axis=1), out, 0.0))

    widest = index.cells.groupBy("cell").agg(F.max(angle("embedding", "cell")).alias("angle")).toArrow()
    radii = np.zeros(len(index.centres))
    radii[widest.column("cell").to_numpy()] = widest.column("angle").to_numpy()
    return radii


def cells_to_read(queries: DataFrame, index: CellIndex, radii: np.ndarray, k: int = 50, n_probe: int = 2) -> DataFrame:
    """Queries with ``cells``, those that may hold one of their ``k`` nearest rows.

    The nearest ``n_probe`` cells give an upper bound for the distance of the k-th row. By the triangle inequality on the
    sphere no row of a cell is nearer than the angle to its centre less its radius: cells beyond the bound stay unread.
    A query with fewer than ``k`` rows in its first cells needs all of them.
    """
    q, _ = _sides(queries, index.cells)
    first = ann(queries, index.cells, index.centres, k, n_probe)
    reach = first.groupBy("query_id").agg(F.when(F.count("distance") == k, F.max("distance")).alias("reach"))
    shared = q.sparkSession.sparkContext.broadcast((index.centres, radii))

    @F.pandas_udf("array<int>")
    def needed(vectors: pd.Series, reach: pd.Series) -> pd.Series:
        centres, radii = shared.value
        unit = _unit(np.vstack(vectors.to_numpy()).astype(np.float64))
        bound = np.arccos(np.clip(1.0 - (reach.to_numpy(dtype=np.float64) + _SLACK), -1.0, 1.0)) + _ANGLE_SLACK
        near = _angles(unit, centres) - radii[None, :] <= np.where(np.isnan(bound), np.inf, bound)[:, None]
        return pd.Series([np.flatnonzero(row).astype("int32") for row in near])

    return q.join(reach, "query_id", "left").withColumn("cells", needed("embedding", "reach")).drop("reach")


def knn_in_cells(queries: DataFrame, index: CellIndex, k: int = 50, n_probe: int = 2, max_queries: int = BOUNDED_BLOCK, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The result of :func:`knn` from an index, without reading the cells that cannot matter to any query.

    Up to ``max_queries`` queries are broadcast with their cells, whose folders alone are read. More of them meet the
    corpus in an equi-join on the cell, cut into tiles of bounded size.
    """
    schema, ddl = output_types(queries, index.cells)
    if not len(index.centres):
        return _final(index.cells.sparkSession.createDataFrame([], ddl), k)
    kind = F.col("doc_type") if "doc_type" in index.cells.columns else F.lit("")
    c = index.cells.select("chunk_id", "embedding", kind.alias("doc_type"), "cell")
    asked = cells_to_read(queries, index, cell_radii(index), k, n_probe)
    head = asked.limit(max_queries + 1).toArrow()
    if head.num_rows <= max_queries:
        block = _block_of(head)
        block.probes = [np.asarray(x, np.int32) for x in head.column("cells").to_pylist()]
        wanted = [int(x) for x in np.unique(np.concatenate(block.probes))] if block.ids else []
        return _final(_scan(asked.sparkSession, c.where(F.col("cell").isin(wanted)), block, k, schema, ddl), k)
    largest = c.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
    dealt = asked.withColumn("cell", F.explode("cells")).drop("cells")
    return _final(_tiles(dealt, c, k, schema, ddl, asked.count(), largest, max_queries, tile_rows, ["cell"]), k)


def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours the approximate search found."""
    found = exact.join(approx.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    return found.agg(
        F.count("*").alias("n_exact"),
        F.count("hit").alias("n_found"),
        F.try_divide(F.count("hit").cast("double"), F.count("*")).alias("recall"),
    )


def expect_source(hits: DataFrame, expected: DataFrame, k: int = 3) -> DataFrame:
    """Per check, whether its expected source is among the first ``k`` hits.

    ``hits``: query_id, source, rank. ``expected``: query_id, expected_source.
    """
    best = (
        hits.where(F.col("rank") <= k)
        .join(expected, "query_id")
        .where(F.col("source") == F.col("expected_source"))
        .groupBy("query_id")
        .agg(F.min("rank").alias("first_rank"))
    )
    return expected.join(best, "query_id", "left").withColumn("found", F.col("first_rank").isNotNull())
