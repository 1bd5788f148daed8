"""Tokens of Arrow batches, found in the bytes of many texts at once.

Keyword tokens are the runs of ``a-z 0-9 _`` in lower-cased texts; window tokens are those of anything but white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 2 << 20

_IN_TOKEN = np.zeros(256, np.bool_)
_NO_SPACE = np.ones(256, np.bool_)
_NO_SPACE[[*b" \t\n\r\f"]] = False
_IN_TOKEN[[*b"abcdefghijklmnopqrstuvwxyz0123456789_"]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and where each begins with the end of the last; a null text has none."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, bounds: np.ndarray | None = None, rows: int = 1 << 30, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows and about ``most`` bytes; they end at one of the sorted ``bounds`` where there is one in reach."""
    if not len(texts):
        return
    at, first = text_bytes(texts)[1], 0
    while first < len(texts):
        last = min(first + rows, max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1))
        if bounds is not None and last < len(texts):
            near = bounds[max(0, np.searchsorted(bounds, last, "right") - 1)] if len(bounds) else 0
            last = int(near) if near > first else last
        yield first, last
        first = last


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; none goes on from one text to the next."""
    edge = np.empty(len(inside) + 1, np.bool_)
    edge[0] = edge[-1] = True
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    held = inside[cuts[:-1]] if len(inside) else np.zeros(len(cuts) - 1, np.bool_)
    return cuts[:-1][held], cuts[1:][held]


def counted_tokens(lowered: pa.Array, without: tuple[str, ...] = ()) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of all texts; then, by text and token: text, number of the token, count. Last, the tokens of each text.

    Tokens ``without`` are passed over.
    """
    data, at = text_bytes(lowered)
    inside = _IN_TOKEN[data]
    start, end = runs(inside, at)
    row = np.repeat(np.arange(len(lowered)), np.diff(np.searchsorted(start, at)))
    ends = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside])).dictionary_encode()
    names, code = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
    if without and len(names):
        kept = ~pc.is_in(names, pa.array(without, pa.string())).to_numpy(zero_copy_only=False)[code]
        row, code = row[kept], code[kept]
    key, count = np.unique(row * max(1, len(names)) + code, return_counts=True)
    return names, *np.divmod(key, max(1, len(names))), count, np.bincount(row, minlength=len(lowered))


def token_spans(texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, pa.Array, pa.Array]:
    """Of each window token: the number of its text, its number there, the token, the places of its first character and of the one behind it."""
    data, at = text_bytes(texts)
    inside = _NO_SPACE[data]
    start, end = runs(inside, at)
    before = np.searchsorted(start, at)
    row = np.repeat(np.arange(len(texts)), np.diff(before))
    ends = np.r_[0, np.cumsum(end - start)].astype(np.int32)
    tokens = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data[inside]))
    # Code points up to each byte; a text begins with its own.
    points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    own = points[at][row]
    numbers = (np.arange(len(start)) - before[row], points[start] - own, points[end] - own)
    no, first, last = (pa.array(x.astype(np.int32)) for x in numbers)
    return row, no, tokens, first, last
