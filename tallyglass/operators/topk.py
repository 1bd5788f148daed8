"""The best rows per query inside one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type

# Values are compared after rounding, so equal rows tie exactly and the id decides.
DIGITS = 9
# Cells of one dense rows x queries block: 8 MB of doubles, and a few times that while it is ranked.
BLOCK_CELLS = 1_000_000


class TopK:
    """Smallest ``k`` values per query seen so far, ties by id. Memory is bounded by queries x k."""

    def __init__(self, query_ids: list, scopes: list, k: int):
        self.query_ids, self.k = query_ids, k
        names = {s: n for n, s in enumerate(dict.fromkeys(s for s in scopes if s is not None))}
        self.scope_names = names
        self.scopes = np.array([names.get(s, -1) for s in scopes], np.int64)  # -1 = all
        self.worst = np.full(len(query_ids), np.inf)
        self.q = self.d = self.ids = None
        self.limit = max(200_000, 4 * k * len(query_ids))

    def add(self, ids: np.ndarray, kinds: np.ndarray, values: np.ndarray, keep: np.ndarray | None = None, queries=None) -> None:
        """Rows x queries ``values``; ``kinds`` are the rows' document types, ``queries`` the columns."""
        which = np.arange(len(self.query_ids)) if queries is None else np.asarray(queries)
        values = np.round(values, DIGITS)
        # Rows without a value (infinite) stay eligible until k others are known.
        ok = values <= self.worst[which]
        if keep is not None:
            ok &= keep
        if self.scope_names:
            kind = np.array([self.scope_names.get(x, -2) for x in kinds], np.int64)
            wanted = self.scopes[which]
            ok &= (wanted == -1) | (kind[:, None] == wanted)
        if len(ids) > self.k:
            ranked = np.where(ok, values, np.nan)  # nan sorts last
            cut = np.partition(ranked, self.k - 1, axis=0)[self.k - 1]
            ok &= (values <= cut) | np.isnan(cut)
        rows, cols = np.nonzero(ok)
        if len(rows):
            self._merge(which[cols], values[rows, cols], ids[rows])

    def _merge(self, q, d, ids) -> None:
        if self.q is not None:
            q, d, ids = np.concatenate([self.q, q]), np.concatenate([self.d, d]), np.concatenate([self.ids, ids])
        self.q, self.d, self.ids = q, d, ids
        if len(q) > self.limit:
            self._prune()

    def _prune(self) -> None:
        order = np.lexsort((self.ids, self.d, self.q))
        q = self.q[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        full = order[nth == self.k - 1]
        self.worst[self.q[full]] = self.d[full]
        order = order[nth < self.k]
        self.q, self.d, self.ids = self.q[order], self.d[order], self.ids[order]

    def batch(self, schema: pa.Schema) -> pa.RecordBatch | None:
        """(query_id, chunk_id, value), value null where there is none."""
        if self.q is None:
            return None
        self._prune()
        value = pa.array(self.d, mask=np.isinf(self.d))
        qid = pa.array([self.query_ids[i] for i in self.q], type=schema.field(0).type)
        cid = pa.array(self.ids.tolist(), type=schema.field(1).type)
        return pa.RecordBatch.from_arrays([qid, cid, value], schema=schema)


def ids_of(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.to_pylist(), dtype=str) if pa.types.is_string(col.type) else col.to_numpy(zero_copy_only=False)


def output_types(queries, corpus) -> tuple[pa.Schema, str]:
    """Schema of (query_id, chunk_id, value) with the id types of both sides."""
    q, c = (df.schema[name].dataType for df, name in ((queries, "query_id"), (corpus, "chunk_id")))
    schema = pa.schema([("query_id", to_arrow_type(q)), ("chunk_id", to_arrow_type(c)), ("value", pa.float64())])
    return schema, f"query_id {q.simpleString()}, chunk_id {c.simpleString()}, value double"
