"""Whole groups inside a task: large groups are cut into pairs of blocks, small ones are worked on together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BLOCK_ROWS = 512


def with_block(df: DataFrame, spread: Column, size: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``block``, the row's own, and ``blocks``, how many its group of ``size`` rows has."""
    n = F.ceil(F.col(size) / F.lit(block_rows)).cast("int")
    return df.withColumn("blocks", n).withColumn("block", F.pmod(F.xxhash64(spread), F.col("blocks")).cast("int"))


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the same values in ``by`` one after another in one task."""
    return df.repartition(*by).sortWithinPartitions(*by)


def paired(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``with_block``, or one row for many of them, for every pair of blocks that their block takes part in, block by block."""
    other = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = other.withColumn("block_i", F.least("block", "_other")).withColumn("block_j", F.greatest("block", "_other"))
    # The diagonal pair would repeat inside each other pair: blocks meet themselves only where i = j.
    by = [*keys, "block_i", "block_j"]
    return met.drop("blocks", "_other").repartition(*by).sortWithinPartitions(*by, "block")


def in_block_pairs(df: DataFrame, keys: list[str], spread: Column, size: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of each group, repeated for every pair of blocks that their block takes part in, group by group.

    A group of ``size`` rows has ``ceil(size / block_rows)`` blocks; any two of its rows meet in one task, and no
    task holds more than about two blocks of it. Adds ``block`` (the row's own), ``block_i`` and ``block_j``.
    """
    return paired(with_block(df, spread, size, block_rows), keys)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from sorted batches, with the places where their groups begin and the last one ends.

    A table is given out once it has ``limit`` rows; memory is bounded by that, a batch and the largest group.
    """
    held: list[pa.Table] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        count += batch.num_rows
        if count < limit:
            continue
        table = pa.concat_tables(held).combine_chunks()
        at = _begins(table, keys)
        if len(at) > 1:
            yield table.slice(0, at[-1]), at
            table = table.slice(at[-1])
        held, count = [table], table.num_rows
    if count:
        table = pa.concat_tables(held).combine_chunks()
        yield table, np.r_[_begins(table, keys), table.num_rows]


def _begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        column = table[k].to_numpy(zero_copy_only=False)
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def settle(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least number reachable from each of ``n`` nodes over the links ``a`` - ``b``."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all() and (label[a] == label[b]).all():
            break
    return label
