"""Which entries of a text have a key that other documents have too.

Entries (key, document, place) are sorted and packed into columns inside the task that made them and go to the bucket
of their key, one blob for each bucket and flush. What a flush can settle alone is settled there: of a key that
several of its documents share, only one document's entries travel. A key that a third of all documents share thus
sends one entry per flush, not one per document. Buckets hold about ``BUCKET_ENTRIES`` entries at any input size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.worker import tidy

FLUSH_ENTRIES = 1_000_000
BUCKET_ENTRIES = 500_000
_KNOWN = np.uint32(1 << 31)  # flag of a place: the entry only tells that its key is shared

_SHUFFLED = "bucket int, doc_id long, mark long, data binary"


@dataclass
class Entries:
    """Entries of some documents; ``check`` widens the key to 96 bits where equal keys must mean equal content."""

    doc: np.ndarray
    mark: np.ndarray
    key: np.ndarray
    place: np.ndarray
    check: np.ndarray | None = None

    def take(self, at) -> "Entries":
        return Entries(self.doc[at], self.mark[at], self.key[at], self.place[at], None if self.check is None else self.check[at])


def _concat(parts: list[Entries]) -> Entries:
    check = None if parts[0].check is None else np.concatenate([p.check for p in parts])
    return Entries(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("doc", "mark", "key", "place")), check)


def _grouped(e: Entries) -> tuple[Entries, np.ndarray]:
    """Entries sorted by key, and the number of each one's key."""
    e = e.take(np.argsort(e.key, kind="stable") if e.check is None else np.lexsort((e.check, e.key)))
    new = np.ones(len(e.key), bool)
    new[1:] = e.key[1:] != e.key[:-1]
    if e.check is not None:
        new[1:] |= e.check[1:] != e.check[:-1]
    return e, np.cumsum(new) - 1


def _ends(e: Entries, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest document of each entry's key."""
    at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.minimum.reduceat(e.doc, at)[group], np.maximum.reduceat(e.doc, at)[group]


def _rows(e: Entries) -> tuple[Entries, np.ndarray]:
    """Entries sorted by document and place, and where each document begins."""
    e = e.take(np.lexsort((e.place, e.mark, e.doc)))
    new = np.ones(len(e.doc), bool)
    new[1:] = (e.doc[1:] != e.doc[:-1]) | (e.mark[1:] != e.mark[:-1])
    return e, np.flatnonzero(new)


def _planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all lowest bytes first: the exchange's compression takes the zeros of the high ones."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(blob: bytes, kind, n: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n)


def _pack(e: Entries) -> bytes:
    """Entries by document: ids as steps from one to the next, places as byte planes."""
    e, at = _rows(e)
    count = np.diff(np.r_[at, len(e.doc)])
    head = np.array([len(e.key), len(at), e.check is not None], np.uint32)
    step = np.diff(e.doc[at].astype(np.int64), prepend=0)
    parts = [head.tobytes(), _planes(step), e.mark[at].tobytes(), _planes(count.astype(np.uint32)), e.key.tobytes(), _planes(e.place)]
    return b"".join(parts if e.check is None else [*parts, e.check.tobytes()])


def _unpack(blob: bytes) -> Entries:
    n, docs, checked = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    at = 12 + 8 * docs
    step = _numbers(blob, np.int64, docs, 12)
    mark = np.frombuffer(blob, np.int64, docs, at)
    count = _numbers(blob, np.uint32, docs, at := at + 8 * docs)
    key = np.frombuffer(blob, np.uint64, n, at := at + 4 * docs)
    place = _numbers(blob, np.uint32, n, at := at + 8 * n)
    check = np.frombuffer(blob, np.uint32, n, at + 4 * n) if checked else None
    return Entries(np.repeat(np.cumsum(step), count), np.repeat(mark, count), key, place, check)


def _flush(e: Entries, buckets: int, smaller: bool) -> Iterator[pa.RecordBatch]:
    e, group = _grouped(e)
    low, high = _ends(e, group)
    if smaller:
        settled, sent = e.doc > low, e.doc == low
    else:
        settled = low != high
        first = np.r_[True, group[1:] != group[:-1]]
        sent = ~settled | first
        e.place = np.where(settled & first, e.place | _KNOWN, e.place)
    known = e.take(settled)
    known.place = known.place & ~_KNOWN
    out = e.take(sent)
    bucket = (out.key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    cuts = np.r_[np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]), len(order)]
    rows = [(int(bucket[order[i]]), None, None, _pack(out.take(order[i:j]))) for i, j in zip(cuts[:-1], cuts[1:]) if j > i]
    if len(known.doc):
        known, at = _rows(known)
        for i, j in zip(at, np.r_[at[1:], len(known.doc)]):
            doc, mark = int(known.doc[i]), int(known.mark[i])
            rows.append((hash((doc, mark)) % buckets, doc, mark, known.place[i:j].tobytes() + known.key[i:j].tobytes()))
    for i in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("bucket", "doc_id", "mark", "data"), r)) for r in rows[i : i + 2000]],
            pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("data", pa.binary())]),
        )


def _answers(e: Entries, smaller: bool) -> Entries:
    e, group = _grouped(e)
    low, high = _ends(e, group)
    known = (e.place & _KNOWN) != 0
    if smaller:
        return e.take(e.doc > low)
    told = np.zeros(group[-1] + 1, bool)
    told[group[known]] = True
    return e.take(((low != high) | told[group]) & ~known)


def _answer_batch(parts: list[Entries]) -> Iterator[pa.RecordBatch]:
    e = _concat(parts)
    for i in range(0, len(e.doc), 50_000):
        own = slice(i, i + 50_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[own]) for x in (e.doc, e.mark, e.place.astype(np.int32), e.key.view(np.int64))],
            ["doc_id", "mark", "place", "key"],
        )


def shared_entries(
    docs: DataFrame, entries: Callable[[pa.RecordBatch], Iterator[Entries]], expected: float, smaller: bool = False
) -> DataFrame:
    """``doc_id, mark, place, key``: the entries whose key another document has (``smaller``: one of smaller id).

    ``entries`` makes the entries of a batch of ``docs``; ``expected`` is about how many there will be in all and only
    sets the number of buckets. ``mark`` is carried along: with the id it names a row where ids repeat.
    """
    buckets = max(1, int(expected / BUCKET_ENTRIES) + 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        count = 0
        for batch in batches:
            for e in entries(batch):
                held.append(e)
                count += len(e.key)
                if count >= FLUSH_ENTRIES:
                    yield from _flush(_concat(held), buckets, smaller)
                    held, count = [], 0
        if count:
            yield from _flush(_concat(held), buckets, smaller)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Entries] = []
        plain: list[Entries] = []
        now, count = None, 0
        for batch in batches:
            for bucket, doc, mark, data in zip(*(c.to_pylist() for c in batch.columns)):
                if doc is not None:
                    n = len(data) // 12
                    place, key = np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint64, n, 4 * n)
                    plain.append(Entries(np.full(n, doc), np.full(n, mark), key, place))
                    count += n
                    if count >= FLUSH_ENTRIES // 4:
                        yield from _answer_batch(plain)
                        plain, count = [], 0
                    continue
                if bucket != now and held:
                    yield from _answer_batch([_answers(_concat(held), smaller)])
                    held = []
                now = bucket
                held.append(_unpack(data))
        if held:
            yield from _answer_batch([_answers(_concat(held), smaller)])
        if plain:
            yield from _answer_batch(plain)

    packed = docs.mapInArrow(tidy(pack), _SHUFFLED)
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(settle), "doc_id long, mark long, place int, key long")


def text_volume(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column, over all rows."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
