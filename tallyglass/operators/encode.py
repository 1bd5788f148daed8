"""Pluggable text encoders."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.functions.vectors import dot
from tallyglass.operators.tasks import tidy
from tallyglass.operators.tokens import counted_tokens, slices

BATCH = 32


class HashEncoder:
    """Signed feature hashing of keyword tokens, damped counts, unit length. Needs no model file."""

    def __init__(self, dims: int = 256):
        self.dims = dims
        self._slots: dict[str, tuple[int, float]] = {}

    def _slot(self, token: str) -> tuple[int, float]:
        if token not in self._slots:
            h = zlib.crc32(token.encode())
            self._slots[token] = (h % self.dims, 1.0 if h >> 31 else -1.0)
        return self._slots[token]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), dtype=np.float64)
        for row, text in zip(out, texts):
            for token, n in Counter(re.findall(r"[a-z0-9_]+", text.lower())).items():
                at, sign = self._slot(token)
                row[at] += sign * (1.0 + math.log(n))
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0).astype(np.float32)


def embed(
    df: DataFrame,
    text: str,
    encoder: Callable[[], Callable[[list[str]], np.ndarray]] = HashEncoder,
    out: str = "embedding",
    batch: int = BATCH,
) -> DataFrame:
    """Adds an ARRAY<FLOAT> column. ``encoder`` makes the model; it runs once per Python worker task,
    then encodes ``batch`` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encoder()
        for series in texts:
            values = series.fillna("").tolist()
            rows: list = []
            for at in range(0, len(values), batch):
                rows.extend(np.asarray(model(values[at : at + batch]), dtype=np.float32))
            yield pd.Series(rows, index=series.index)

    return df.withColumn(out, run(F.col(text)))


# Counts are damped in whole steps of this fineness, so that sums do not depend on their order.
_STEPS = 1 << 20
# Texts whose tokens are counted at once, at most.
SUM_ROWS = 1000


def _placed(names: list[str], dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and sign of each token."""
    digests = [hashlib.md5(x.encode()).digest() for x in names]
    first = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)[:, :3].astype(np.int64)
    return (first[:, 0] * 256 + first[:, 1]) % dims, np.where(first[:, 2] >= 128, 1, -1)


def hash_embed(df: DataFrame, text: str, out: str = "embedding", dims: int = 64) -> DataFrame:
    """Adds an ARRAY<FLOAT> column by signed feature hashing.

    A token's slot and sign come from its MD5; its count is damped to 1 + ln(n); the vector has unit length, or is all
    zeros for a text without tokens. Tasks count the tokens of a batch at a time, and add up in whole steps.
    """
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept, F.lit(None).cast("array<float>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in slices(whole.column(len(kept)), rows=SUM_ROWS):
                batch = whole.slice(first, last - first)
                names, row, code, count, _ = counted_tokens(batch.column(len(kept)))
                slot, sign = _placed(names.to_pylist(), dims)
                steps = sign[code] * np.floor((1 + np.log(count.astype(np.float64))) * _STEPS + 0.5)
                # Whole numbers far below 2**53: doubles add them exactly.
                total = np.bincount(row * dims + slot[code], steps, len(batch) * dims).astype(np.float64).reshape(-1, dims)
                length = np.sqrt((total * total).sum(1, keepdims=True))
                unit = np.divide(total, length, out=np.zeros_like(total), where=length > 0).astype(np.float32)
                vectors = pa.ListArray.from_arrays(np.arange(0, unit.size + 1, dims, dtype=np.int32), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], vectors], [*kept, out])

    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.select(*kept, lowered.alias("_t")).mapInArrow(tidy(run), schema)


def check_dims(df: DataFrame, vec: str, dims: int) -> DataFrame:
    """One row: vectors, vectors of another length, vectors without a direction, verdict."""
    return df.agg(
        F.count("*").alias("n_vectors"),
        F.count_if(F.coalesce(F.size(vec), F.lit(-1)) != dims).alias("n_bad_dims"),
        F.count_if(F.coalesce(dot(vec, vec), F.lit(0.0)) == 0).alias("n_zero"),
    ).withColumn("ok", F.col("n_bad_dims") == 0)
