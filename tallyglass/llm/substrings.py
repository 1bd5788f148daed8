"""Removal of word sequences that an earlier document has, by difference-cover anchors.

A match of ``width`` words shifts against another document by some distance d. Anchors are hashes of short windows
at places x with x mod ``period`` in a difference cover: for every d there is a place in any ``period`` consecutive
ones where both documents have an anchor. So a match of ``width`` = ``period`` + anchor length - 1 words always holds
an anchor that both documents hashed, while only |cover| / ``period`` of all places are hashed. Around anchors found
in two documents the match is extended: full windows get a wide hash, and the smallest document that has one keeps it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.shared_keys import Entries, shared_entries, text_volume
from tallyglass.llm.words import blocks, window_hashes
from tallyglass.llm.worker import tidy

_NO_ID = -(1 << 63)  # key of rows without an id, whose windows do not count

# Perfect difference covers: each distance modulo the period is a difference of two members.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9)}


def _anchors(width: int, period: int):
    in_cover = np.zeros(period, bool)
    in_cover[list(COVERS[period])] = True
    length = width - period + 1

    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        doc, mark = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
        for b in blocks(batch.column("text")):
            row = b.row_of_word()
            at = b.window_starts(length)
            place = at - b.word_at[row[at]]
            keep = in_cover[place % period] & (b.n_words >= width)[row[at]]
            at, place = at[keep], place[keep]
            own = row[at] + b.first
            yield Entries(doc[own], mark[own], window_hashes(b.hashes(), at, length), place.astype(np.uint32))

    return entries


def _windows(width: int, period: int):
    def entries(batch: pa.RecordBatch) -> Iterator[Entries]:
        doc, mark = (batch.column(c).to_numpy() for c in ("doc_id", "mark"))
        anchors = batch.column("anchors")
        offsets = anchors.offsets.to_numpy()
        values = anchors.values.to_numpy()
        for b in blocks(batch.column("text")):
            lo, hi = offsets[b.first], offsets[b.stop]
            row = np.repeat(np.arange(b.stop - b.first), np.diff(offsets[b.first : b.stop + 1]))
            seen = np.zeros(len(b.starts) + 1, np.int64)
            seen[b.word_at[row] + values[lo:hi] + 1] = 1
            seen = np.cumsum(seen)
            at = b.window_starts(width)
            at = at[seen[at + period] > seen[at]]
            own = b.row_of_word()[at]
            place = at - b.word_at[own]
            own += b.first
            check = window_hashes(b.hashes(1), at, width, 1).astype(np.uint32)
            yield Entries(doc[own], mark[own], window_hashes(b.hashes(), at, width), place.astype(np.uint32), check)

    return entries


def _cut(width: int):
    out = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
            ("removed", pa.list_(pa.struct([("first", pa.int32()), ("stop", pa.int32())]))), ("kept_text", pa.string()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                rows = batch.slice(first, 500)
                texts = rows.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
                result = [_cut_one(t, p, width) for t, p in zip(texts, rows.column("windows").to_pylist())]
                if result:
                    columns = [rows.column("doc_id"), *(list(c) for c in zip(*result))]
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, out)], schema=out
                    )

    return cut


def _cut_one(text: bytes, windows: list[int] | None, width: int):
    words = text.split()  # bytes split at space and 0x09-0x0D only
    n = len(words)
    if not windows:
        return n, 0, [], b" ".join(words)
    starts = np.unique(windows)
    spans = []
    kept: list[bytes] = []
    done = 0
    for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
        first, stop = int(run[0]), int(run[-1]) + width
        kept += words[done:first]
        spans.append({"first": first, "stop": stop})
        done = stop
    kept += words[done:]
    return n, n - len(kept), spans, b" ".join(kept)


def remove_repeats(docs: DataFrame, width: int = 13, period: int = 7) -> DataFrame:
    """Words of each text that no window of ``width`` words shared with a document of smaller ``doc_id`` covers.

    Returns ``doc_id, n_words, n_removed, removed`` (spans of word numbers), ``kept_text`` (kept words joined by one
    space), one row per row of ``docs``. Words are runs of bytes other than space and 0x09-0x0D. Windows are judged
    on the input. Null and empty texts have no words. Rows without ``doc_id`` keep all words and remove none
    elsewhere; rows that share an id are each judged against smaller ids only. Other columns are ignored.
    """
    # Both joins with the texts use one exchange of them, so neither side may need a filter: the key is never null.
    own = docs.select(
        F.col("doc_id").cast("long").alias("given"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    # The mark tells rows that share an id apart; where no id repeats it has nothing to tell, and costs nothing to move.
    twice = own.where("given IS NOT NULL").groupBy("given").count().where("count > 1")
    own = own.withColumn("mark", F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("text"))
    n_words = text_volume(docs) / 5  # a generous guess that only sizes buckets
    by = ["doc_id", "mark"]
    named = own.where("given IS NOT NULL").select("doc_id", "mark", "text")
    anchored = shared_entries(named, _anchors(width, period), n_words * len(COVERS[period]) / period)
    anchored = anchored.groupBy(by).agg(F.collect_list("place").alias("anchors"))
    around = own.join(anchored.hint("merge"), by)  # with all its columns, as below
    again = shared_entries(around, _windows(width, period), n_words / 4, smaller=True)
    repeated = again.groupBy(by).agg(F.collect_list("place").alias("windows"))
    judged = own.join(repeated.hint("merge"), by, "left").select(F.col("given").alias("doc_id"), "text", "windows")
    return judged.mapInArrow(
        tidy(_cut(width)),
        "doc_id long, n_words long, n_removed long, removed array<struct<first:int,stop:int>>, kept_text string",
    )
