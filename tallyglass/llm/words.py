"""Words of UTF-8 texts as numpy arrays: boundaries, hashes, windows.

A word is a run of bytes other than space and 0x09-0x0D. Texts come in as Arrow arrays and are worked on in
blocks of a few megabytes, so a task needs memory for a block (or for its longest text), not for a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# Odd multipliers of the two independent hash families.
_BYTE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

LONG_BYTES = 256  # runs of more bytes are few; each is hashed by itself
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of unsigned 64-bit numbers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as a number, zeros behind the end (a view)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def run_hashes(data: np.ndarray, starts: np.ndarray, size: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes, from its length and eight bytes at a time, scattered at each step."""
    wide = eights(data)
    out = mix((wide[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(_BYTE[family]))
    at = np.flatnonzero(size > 8)
    done = 8
    while len(at) and done < LONG_BYTES:
        more = wide[starts[at] + done] & _MASK[np.minimum(size[at] - done, 8)]
        out[at] = mix((out[at] + np.uint64(_BYTE[1 - family])) ^ more)
        done += 8
        at = at[size[at] > done]
    for k in at.tolist():
        run = data[starts[k] : starts[k] + size[k]].tobytes()
        out[k] = np.frombuffer(hashlib.blake2b(run, digest_size=8, salt=bytes([family])).digest(), "<u8")[0]
    return out


def equal_runs(
    data: np.ndarray, starts: np.ndarray, size: np.ndarray, other: np.ndarray, at: np.ndarray, room: np.ndarray,
    theirs: np.ndarray | None = None,
) -> np.ndarray:
    """Whether each run of ``data`` has the bytes of the run of ``other`` that begins ``at`` and is ``room`` long.

    ``theirs`` are the ``eights`` of ``other``, where they are at hand.
    """
    same = size == room
    mine = eights(data)
    theirs = eights(other) if theirs is None else theirs
    left = np.flatnonzero(same)
    done = 0
    while len(left):
        differ = (mine[starts[left] + done] ^ theirs[at[left] + done]) & _MASK[np.minimum(size[left] - done, 8)]
        same[left[differ != 0]] = False
        done += 8
        left = left[(differ == 0) & (size[left] > done)]
        if done >= LONG_BYTES:
            break
    for k in left.tolist():
        same[k] = bool((data[starts[k] : starts[k] + size[k]] == other[at[k] : at[k] + size[k]]).all())
    return same


@dataclass
class Block:
    """Consecutive rows of a batch with their words.

    ``first``/``stop`` are row numbers in the batch; row ``r`` has the words ``word_at[r - first]`` to
    ``word_at[r - first + 1]``; word ``w`` has the bytes ``starts[w]`` to ``ends[w]`` of ``data``.
    """

    first: int
    stop: int
    data: np.ndarray
    byte_at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    word_at: np.ndarray

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_at)

    def hashes(self, family: int = 0) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        return run_hashes(self.data, self.starts, self.ends - self.starts, family)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.stop - self.first), self.n_words)

    def window_starts(self, width: int) -> np.ndarray:
        """Words at which a window of ``width`` words of one text begins."""
        room = np.maximum(self.n_words - width + 1, 0)
        return np.arange(room.sum()) + np.repeat(self.word_at[:-1] - (np.cumsum(room) - room), room)


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each place in ``at``."""
    out = np.full(len(at), width, np.uint64)
    for k in range(width):
        out += words[at + k] * np.uint64(pow(_WORD[family], k + 1, 1 << 64))
    return mix(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow column in a row, and where each begins; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES, letters: np.ndarray = ~_SPACE) -> Iterator[Block]:
    """The words of a text column, in blocks of whole texts of about ``limit`` bytes.

    ``letters`` tells of each byte whether it belongs to a word.
    """
    if not len(column):
        return
    data, at = text_bytes(column)
    for first, stop in runs(np.diff(at), limit):
        own = data[at[first] : at[stop]]
        if lower:
            own = _LOWER[own]
        yield _block(first, stop, own, at[first : stop + 1] - at[first], letters)


def runs(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Cut rows into consecutive runs whose sizes add up to about ``limit``; a larger row is a run of its own."""
    total = np.cumsum(sizes)
    first, done = 0, 0
    while first < len(sizes):
        stop = max(first + 1, int(np.searchsorted(total, done + limit, "right")))
        yield first, stop
        done, first = total[stop - 1], stop


def _block(first: int, stop: int, data: np.ndarray, byte_at: np.ndarray, letters: np.ndarray) -> Block:
    letter = letters[data]
    begins, finishes = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1]
    finishes[:-1] &= ~letter[1:]
    cut = byte_at[(byte_at > 0) & (byte_at < len(data))]
    begins[cut] = letter[cut]
    finishes[cut - 1] = letter[cut - 1]
    starts = np.flatnonzero(begins)
    return Block(first, stop, data, byte_at, starts, np.flatnonzero(finishes) + 1, np.searchsorted(starts, byte_at))
