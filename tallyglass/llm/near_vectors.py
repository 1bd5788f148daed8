"""Near-duplicate vectors: sign hashes by random hyperplanes in several tables, exact cosines, components.

Equal vectors are one class. Classes with equal signs in a table meet in that table's bucket; a pair counts in the
first table that holds it. Cosines are computed in blocks inside the task, which gives out sums per vector and a
forest of the links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.components import components
from tallyglass.llm.groups import in_block_pairs, settle, whole_groups
from tallyglass.llm.store import written
from tallyglass.llm.worker import tidy

TABLES = 30  # a pair at the threshold of 0.95 meets in one of them with probability 0.998
BITS = 16  # of a table's sign hash
SEED = 20


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    return values, column.offsets.to_numpy()


def _units(column: pa.Array) -> list[np.ndarray]:
    """Vectors scaled to length one, one array for each row."""
    values, at = _matrix(column)
    out = []
    for i, j in zip(at[:-1], at[1:]):
        v = values[i:j]
        v = v / np.abs(v).max()
        out.append(v / np.sqrt(v @ v))
    return out


def _signs(tables: int, bits: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("embedding")
            values, at = _matrix(column)
            size = np.diff(at)
            sig = np.zeros((batch.num_rows, tables), np.int64)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                if d not in planes:
                    planes[d] = np.random.RandomState(seed + int(d)).standard_normal((int(d), tables * bits))
                x = values[at[rows][:, None] + np.arange(d)]
                sign = ((x / np.abs(x).max(1, keepdims=True)) @ planes[d] > 0).reshape(len(rows), tables, bits)
                sig[rows] = (sign << np.arange(bits)).sum(2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class_id"), pa.array(size, pa.int32()),
                    pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), tables).cast(pa.list_(pa.int64())),
                ],
                ["class_id", "dims", "signs"],
            )

    return run


def _linked(threshold: float):
    keys = ["table", "sign", "dims", "block_i", "block_j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, keys, 8192):
            ids, copies = table["class_id"].to_numpy(), table["copies"].to_numpy()
            number, block = table["table"].to_numpy(), table["block"].to_numpy()
            cross = table["block_i"].to_numpy() != table["block_j"].to_numpy()
            signs = np.array(table["signs"].combine_chunks().values.to_numpy()).reshape(len(ids), -1)
            units = _units(table["embedding"].combine_chunks())
            us, vs, ns, links = [], [], [], []
            for lo, hi in zip(at[:-1], at[1:]):
                if hi - lo < 2:
                    continue
                x = np.stack(units[lo:hi])
                near = np.triu(x @ x.T >= threshold - 1e-9, 1)
                if cross[lo]:
                    near &= block[lo:hi, None] != block[None, lo:hi]
                a, b = np.nonzero(near)
                if not len(a):
                    continue
                a, b = a + lo, b + lo
                before = signs[:, : number[lo]]
                first = ~(before[a] == before[b]).any(1)
                a, b = a[first], b[first]
                exact = np.array([_cosine(units[i], units[j]) >= threshold for i, j in zip(a, b)], bool)
                a, b = a[exact], b[exact]
                label = settle(hi - lo, a - lo, b - lo)
                own = np.unique(np.r_[a, b])
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, a - lo, copies[b])
                np.add.at(total, b - lo, copies[a])
                us.append(ids[own])
                vs.append(ids[lo + label[own - lo]])
                links.append(total[own - lo])
            if us:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (us, vs, links)], ["u", "v", "links"]
                )

    return run


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b)


def near_vectors(
    vectors: DataFrame, threshold: float = 0.95, tables: int = TABLES, bits: int = BITS, seed: int = SEED
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of each row, linked at a cosine of ``threshold`` in double precision.

    Links are those of the pairs that agree in one of ``tables`` sign hashes of ``bits`` bits. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the least ``vec_id`` reachable, ``kept`` marks that row itself.
    A vector that is null, empty or zero, or has null or non-finite components, is linked with nothing, nor are
    vectors of unlike length. Rows without ``vec_id`` are passed over; rows that repeat one count as rows each.
    Other columns are ignored.
    """
    own = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")
    ).where("vec_id IS NOT NULL")
    finite = "embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(embedding, x -> x <> 0)"
    sound = F.coalesce(F.expr(finite), F.lit(False))
    classes = own.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"))
    # An id may name several vectors: a class goes by a number of its own, and ids come back at the end.
    classes = written(classes.withColumn("class_id", F.monotonically_increasing_id()), "vectors")
    signs = classes.select("class_id", "embedding").mapInArrow(
        tidy(_signs(tables, bits, seed)), "class_id long, dims int, signs array<long>"
    )
    signs = written(signs, "signs")
    entry = signs.select("class_id", "dims", F.posexplode("signs").alias("table", "sign"))
    keys = ["table", "sign", "dims"]
    full = written(entry.groupBy(keys).agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    placed = entry.join(full, keys)
    packed = classes.drop("least_id").join(signs.select("class_id", "signs"), "class_id")
    met = in_block_pairs(placed.join(packed, "class_id"), keys, F.col("class_id"), "size")
    links = written(met.drop("size").mapInArrow(tidy(_linked(threshold)), "u long, v long, links long"), "pairs")
    part = components(links.select("u", "v"))
    roots = part.select(F.col("component").alias("node"), "component").distinct()
    member = written(part.unionByName(roots).withColumnRenamed("node", "class_id"), "members")
    named_class = member.join(classes.select("class_id", "least_id"), "class_id")
    least = written(named_class.groupBy("component").agg(F.min("least_id").alias("component_id")), "least")
    part = member.join(least, "component").select("class_id", "component_id")
    total = links.groupBy(F.col("u").alias("class_id")).agg(F.sum("links").alias("others"))
    joined = classes.join(total, "class_id", "left").join(part, "class_id", "left")
    joined = written(
        joined.select(
            "embedding",
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "least_id").alias("component_id"),
        ),
        "linked",
    )
    named = own.where(sound).join(joined, "embedding").select("vec_id", "n_links", "component_id")
    alone = own.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return named.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
