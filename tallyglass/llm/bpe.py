"""Byte-level BPE by a segment tree over adjacent pair ranks, for many pieces at once.

The leaves of a piece's tree hold the rank of each pair of neighbours and its place; a node holds the least of its
children, so the root is the leftmost of the lowest-ranked merges. A merge changes three leaves, which are carried up
the tree in logarithmic time, and merges go on until the root holds no rank. Pieces of like length share numpy arrays
and take each step together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.pretokens import PieceEncoder
from tallyglass.llm.worker import per_worker, tidy

_CELLS = 1 << 18  # of the arrays that pieces share


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges and token bytes of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        letters = _byte_letters()
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        byte_of = {c: b for b, c in enumerate(letters)}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(names) + 1
        spelled = [
            bytes(byte_of[c] for c in names[i]) if i in names and all(c in byte_of for c in names[i])
            else names.get(i, "").encode()
            for i in range(self.size)
        ]
        self.token_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.token_len = np.array([len(s) for s in spelled], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        code = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, or -1."""
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], -1)

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian 32-bit numbers."""
        data = [p.encode("utf-8", "surrogatepass") for p in pieces]
        out: list[bytes] = [b""] * len(data)
        by_width: dict[int, list[int]] = {}
        for k, d in enumerate(data):
            by_width.setdefault(max(1, (len(d) - 1).bit_length()), []).append(k)
        for bits, members in by_width.items():
            step = max(1, _CELLS >> bits)
            for first in range(0, len(members), step):
                own = members[first : first + step]
                for k, ids in zip(own, self._merge([data[k] for k in own], 1 << bits)):
                    out[k] = ids
        return out

    def _merge(self, data: list[bytes], width: int) -> list[bytes]:
        rows = len(data)
        lens = np.array([len(d) for d in data])
        inside = np.arange(width)[None, :] < lens[:, None]
        sym = np.zeros((rows, width + 1), np.int64)
        sym[:, :width][inside] = self.byte_id[np.frombuffer(b"".join(data), np.uint8)]
        alive = inside.copy()
        none = np.int64(len(self.merged)) * width
        tree = np.full((rows, 2 * width), none, np.int64)
        rank = self.ranks(sym[:, : width - 1], sym[:, 1:width])
        paired = (rank >= 0) & inside[:, 1:]
        tree[:, width : 2 * width - 1] = np.where(paired, rank * width + np.arange(width - 1), none)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        # Neighbours; place `width` stands for none on the right, and -1 on the left reads it too.
        after = np.tile(np.arange(1, width + 2), (rows, 1))
        after[after >= lens[:, None]] = width
        before = np.tile(np.arange(-1, width), (rows, 1))
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            root = tree[live, 1]
            at = root % width
            gone = after[live, at]
            right = after[live, gone]
            left = before[live, at]
            sym[live, at] = self.merged[root // width]
            alive[live, gone] = False
            after[live, at] = right
            before[live, right] = at
            here = self.ranks(sym[live, at], sym[live, right])
            tree[live, width + gone] = none
            tree[live, width + at] = np.where((right < width) & (here >= 0), here * width + at, none)
            has = np.flatnonzero(left >= 0)
            some, near = live[has], left[has]
            there = self.ranks(sym[some, near], sym[some, at[has]])
            tree[some, width + near] = np.where(there >= 0, there * width + near, none)
            ups = [(live, width + gone), (live, width + at), (some, width + near)]
            for _ in range(width.bit_length() - 1):
                ups = [(r, node >> 1) for r, node in ups]
                for r, node in ups:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            live = live[tree[live, 1] < none]
        ids = sym[:, :width][alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(1)) * 4
        return [ids[i:j] for i, j in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids in a row; unknown ids have none."""
        ids = ids[ids < self.size]
        size = self.token_len[ids]
        at = np.cumsum(size) - size
        return self.token_bytes[np.arange(size.sum()) + np.repeat(self.token_at[ids] - at, size)].tobytes()


def vocabulary(text: str) -> Vocabulary:
    return per_worker(("vocabulary", hash(text), len(text)), lambda: Vocabulary(text), 2)


def _encoder(text: str) -> PieceEncoder:
    own = vocabulary(text)
    return per_worker(("bpe", hash(text), len(text)), lambda: PieceEncoder(own.encode, own.special), 2)


def encode(docs: DataFrame, tokenizer_file: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the BPE ids of a text column, as little-endian 32-bit numbers in a binary column.

    ``tokenizer_file`` is a byte-level BPE file of the tokenizers library; the driver reads it and ships its content,
    whose size is fixed. Gives the ids that library gives without special tokens added: strings of special tokens in
    a text become their ids. A null text counts as empty and has no ids. Column and row order do not matter, other
    columns are kept; a column called ``ids`` is replaced.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in docs.columns if c != ids]
    schema = docs.select(*kept, F.lit(b"").alias(ids)).schema
    names = [*kept, ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = part.column(column).cast(pa.large_string()).fill_null("").to_pylist()
                packed = pa.array([x.tobytes() for x in encoder.ids(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), packed], names)

    return docs.select(*kept).mapInArrow(tidy(run), schema)


def decode(tokens: DataFrame, tokenizer_file: str, column: str = "ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of a binary column of ids; bytes that are no UTF-8 become U+FFFD. Null ids: empty."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = tokens.sparkSession.sparkContext.broadcast(f.read())
    kept = [c for c in tokens.columns if c != text]
    schema = tokens.select(*kept, F.lit("").alias(text)).schema
    names = [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(spec.value)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                packed = part.column(column).fill_null(b"").to_pylist()
                plain = [own.decode(np.frombuffer(p, "<u4")).decode("utf-8", "replace") for p in packed]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(plain, pa.string())], names)

    return tokens.select(*kept).mapInArrow(tidy(run), schema)
