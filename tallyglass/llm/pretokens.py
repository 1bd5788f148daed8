"""Pieces of text that byte-level BPE encodes one by one, found for many texts at once.

The rule cuts at changes between letters, digits, white space and the rest; a single space goes to the piece behind
it; ``'s 't 're 've 'm 'll 'd`` are pieces. Equal pieces are encoded once per task: ``PieceEncoder`` keeps a bounded
table of pieces seen and asks an encoder only for new ones. Short pieces are found by their bytes; longer ones by a hash and
then compared byte by byte, with those of their block as with those of the table, so two pieces of one hash stay two.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd

from tallyglass.llm.words import eights, equal_runs, mix, run_hashes, runs
from tallyglass.llm.worker import per_worker

BLOCK_CHARS = 1 << 19
MEMO_PIECES = 300_000
MEMO_BYTES = 32 << 20
_CELLS = 1 << 22
_HASHED = np.uint64(1 << 63)
_NO_TEXT = np.uint64(1 << 62)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [0], np.uint64)

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
# The code points with the property White_Space.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def _classes() -> np.ndarray:
    every = np.arange(sys.maxunicode + 1, dtype=np.uint32).view("U1")
    letter = np.char.isalpha(every)  # a general category L
    # What has a numeric value and is no letter is of a category N.
    out = np.where(letter, _LETTER, np.where(np.char.isnumeric(every), _NUMBER, _OTHER)).astype(np.uint8)
    out[_WHITE] = _SPACE
    return out


def _of_bytes() -> bytes:
    out = np.full(256, _OTHER, np.uint8)
    out[:128] = _classes()[:128]
    return out.tobytes()


def byte_classes(raw: bytes) -> np.ndarray:
    """The class of the code point that each byte of UTF-8 belongs to."""
    kind = np.frombuffer(bytearray(raw.translate(per_worker(("classes of bytes",), _of_bytes))), np.uint8)
    if raw.isascii():
        return kind
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.uint32)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    point = lead & (np.uint32(0x7F) >> size.astype(np.uint32))
    for k in range(1, 4):
        more = size > k
        point[more] = point[more] << np.uint32(6) | (data[at[more] + k] & 0x3F)
    own = per_worker(("classes",), _classes)[point]
    kind[at] = own
    for k in range(1, 4):
        more = size > k
        kind[at[more] + k] = own[more]
    return kind


def piece_starts(raw: bytes, at: np.ndarray) -> np.ndarray:
    """Bytes at which a piece begins; ``at`` tells where each text begins and the last one ends."""
    n = len(raw)
    data = np.frombuffer(raw, np.uint8)
    kind = byte_classes(raw)
    edge = np.zeros(n + 1, bool)  # a text begins, or all end
    edge[at] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last of several white spaces before something else stands alone or, as a space, goes to what follows.
    white = kind == _SPACE
    last = np.flatnonzero(white[:-1] & ~white[1:] & ~edge[1:n])
    one = data[last]
    wide = last[one >= 0x80]
    for _ in range(3):  # back to its first byte
        wide = wide - ((data[wide] & 0xC0) == 0x80)
    start[last[one < 0x80]] = True
    start[wide] = True
    start[last[one == 0x20] + 1] = False
    quote = np.flatnonzero((data == 0x27) & start)
    for ending in _ENDINGS:
        size = len(ending)
        fits = quote[quote + size < n]
        for k, letter in enumerate(ending, 1):
            fits = fits[(data[fits + k] == ord(letter)) & ~edge[fits + k]]
        start[fits + 1] = False
        behind = fits + size + 1
        start[behind[behind < n]] = True
    return np.flatnonzero(start)


class _Rows:
    """An array that grows at its end, with zeros behind it."""

    def __init__(self, kind: type):
        self.room, self.n = np.zeros(1024, kind), 0

    def __len__(self) -> int:
        return self.n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) + 8 > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.n + len(more) + 8), self.room.dtype)
            room[: self.n] = self.all
            self.room = room
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)


class PieceTable:
    """Pieces with their keys, bytes and ids. It only grows, so a piece keeps its number.

    A cell holds the last piece of the keys that meet in it; each key has two cells.
    """

    def __init__(self):
        self.cell = np.full(_CELLS, -1, np.int32)
        self.key, self.text, self.known = _Rows(np.uint64), _Rows(np.uint8), _Rows(np.uint32)
        self.text_at, self.known_at, self.known_len = _Rows(np.int64), _Rows(np.int64), _Rows(np.int32)
        self.single: dict[int, int] = {}

    def __len__(self) -> int:
        return len(self.key)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of pieces in a row."""
        return gather(self.known.all, self.known_at.all[numbers], self.known_len.all[numbers])

    def number(self, one: int) -> int:
        """The number of a piece that has this id alone and is no text."""
        if one not in self.single:
            self.single[one] = int(self._put(np.array([_NO_TEXT]), np.zeros(0, np.uint8), np.zeros(1, np.int64), [one.to_bytes(4, "little")])[0])
        return self.single[one]

    def places(self, data: np.ndarray, key: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of pieces, -1 for those that are not here."""
        out = np.full(len(key), -1, np.int64)
        left = np.arange(len(key))
        for cells in _cells(key):
            slot = self.cell[cells[left]].astype(np.int64)
            at = np.flatnonzero(slot >= 0)
            at = at[self.key.room[slot[at]] == key[left[at]]]
            long = at[key[left[at]] >= _HASHED]
            mine, theirs = left[long], slot[long]
            same = equal_runs(
                data, begin[mine], size[mine], self.text.all, self.text_at.room[theirs], self.text_at.room[theirs + 1] - self.text_at.room[theirs],
                np.ndarray((len(self.text) + 1,), "<u8", self.text.room, strides=(1,)),
            )
            slot[long[~same]] = -1
            found = np.zeros(len(left), bool)
            found[at] = slot[at] >= 0
            out[left[found]] = slot[found]
            left = left[~found]
        return out

    def add(self, data: np.ndarray, key: np.ndarray, begin: np.ndarray, size: np.ndarray, encoded: list[bytes]) -> np.ndarray:
        """Take pieces in; their numbers."""
        numbers = self._put(key, gather(data, begin, size), size, encoded)
        one, two = _cells(key)
        taken = self.cell[one] >= 0
        self.cell[one[~taken]] = numbers[~taken]
        self.cell[two[taken]] = numbers[taken]
        return numbers

    def _put(self, key: np.ndarray, text: np.ndarray, size: np.ndarray, encoded: list[bytes]) -> np.ndarray:
        first = len(self.key)
        count = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        ends = np.cumsum(size) + len(self.text)
        self.text_at.extend(ends - size)
        self.text_at.room[self.text_at.n] = len(self.text) + len(text)  # the last text ends
        self.known_at.extend(np.cumsum(count) - count + len(self.known))
        self.known_len.extend(count)
        self.key.extend(key)
        self.text.extend(text)
        self.known.extend(np.frombuffer(b"".join(encoded), np.uint32))
        return np.arange(first, len(self.key))


def _cells(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    spread = mix(key)
    return spread & np.uint64(_CELLS - 1), spread >> np.uint64(64 - _CELLS.bit_length() + 1)


def gather(values: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of ``values`` in a row, from where and of what length."""
    to = np.cumsum(count, dtype=np.int64)
    total = int(to[-1]) if len(to) else 0
    place = np.repeat(at - (to - count), count)
    place += np.arange(total)
    return values[place]


class PieceEncoder:
    """Ids of texts from ``encode``, which gives the ids of each of some pieces as little-endian 32-bit numbers."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], special: dict[str, int] | None = None, most: int = MEMO_PIECES):
        self.encode = encode
        self.special = special or {}
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.table = PieceTable()

    @property
    def key(self) -> np.ndarray:
        return self.table.key.all

    def ids(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens in a text become their ids."""
        out = []
        for chain in self.pieces(texts):
            ids = [table.ids(numbers) for table, numbers in chain]
            out.append(ids[0] if len(ids) == 1 else np.concatenate(ids))
        return out

    def pieces(self, texts: Sequence[str]) -> list[list[tuple[PieceTable, np.ndarray]]]:
        """The pieces of each text in a row, by their numbers in a table. A full table gives way to another."""
        parts: list[str] = []
        plan: list[tuple[int, list[int]]] = []  # of each text: its first part, the special ids between its parts
        for text in texts:
            own, between = [text], []
            for token, number in self.special.items():
                if token in text:
                    own, between = self._cut(own, between, token, number)
            plan.append((len(parts), between))
            parts += own
        found: list[tuple[PieceTable, np.ndarray]] = []
        for first, stop in runs(np.array([len(p) for p in parts], np.int64), BLOCK_CHARS):
            found += [(self.table, numbers) for numbers in self._block(parts[first:stop])]
        out = []
        for first, between in plan:
            chain = [found[first]]
            for k, number in enumerate(between, 1):
                chain += [(self.table, np.array([self.table.number(number)])), found[first + k]]
            out.append(chain)
        return out

    @staticmethod
    def _cut(own: list[str], between: list[int], token: str, number: int) -> tuple[list[str], list[int]]:
        parts, marks = [], []
        for k, part in enumerate(own):
            if k:
                marks.append(between[k - 1])
            split = part.split(token)
            parts += split
            marks += [number] * (len(split) - 1)
        return parts, marks

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"".join(raws)
        if not raw:
            return [np.zeros(0, np.int32)] * len(texts)
        edges = np.append(0, np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws))))
        begin = piece_starts(raw, edges)
        data = np.frombuffer(raw, np.uint8)
        size = np.diff(begin, append=len(data))
        key = _keys(data, begin, size)
        own, sample = _alike(data, key, begin, size)
        slot = self.table.places(data, key[sample], begin[sample], size[sample])
        new = np.flatnonzero(slot < 0)
        if len(new) and (len(self.table) + len(new) > self.most or len(self.table.text) > MEMO_BYTES):
            self._clear()
            new = np.arange(len(slot))
        if len(new):
            at = sample[new]
            first, count = begin[at], size[at]
            encoded = self.encode([raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(first.tolist(), (first + count).tolist())])
            slot[new] = self.table.add(data, key[at], first, count, encoded)
        numbers = slot.astype(np.int32)[own]
        cut = np.searchsorted(begin, edges).tolist()
        return [numbers[i:j] for i, j in zip(cut[:-1], cut[1:])]


def _keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each piece a number: its length and bytes if it has less than eight, else a hash from ``_HASHED`` on."""
    width = np.minimum(size, 8)
    out = (eights(data)[begin] & _LOW[width]) | width.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > 7)
    out[long] = run_hashes(data, begin[long], size[long]) | _HASHED
    return out


def _alike(data: np.ndarray, key: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its content, and for each content a piece that has it."""
    own, names = pd.factorize(key)
    sample = _firsts(own, len(names))
    long = np.flatnonzero(key >= _HASHED)
    first = sample[own[long]]
    if not equal_runs(data, begin[long], size[long], data, begin[first], size[first]).all():
        raw = data.tobytes()
        own, names = pd.factorize(np.array([raw[i : i + n] for i, n in zip(begin.tolist(), size.tolist())], object))
        sample = _firsts(own, len(names))
    return own, sample


def _firsts(own: np.ndarray, n: int) -> np.ndarray:
    out = np.empty(n, np.int64)
    out[own[::-1]] = np.arange(len(own) - 1, -1, -1)
    return out
