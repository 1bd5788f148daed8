"""Token-id files compressed by Re-Pair, one grammar per shard, readable from any id on.

A shard holds whole documents in ascending order of their ids. Rounds replace frequent pairs of neighbouring symbols by
new symbols, first inside the pieces of text that are encoded one by one, until no pair is frequent; the rules and the number of ids that each stands for are stored, and the ids that precede every
``INDEX_STEP``-th symbol, so a run of ids is decoded without what lies before it.

Layout of a shard, little-endian: magic, counts (documents, symbols, rules, ids, base, symbol bytes), document ids
(and which are null), ids per document, left and right symbol of each rule, ids per rule, index, symbols.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.pretokens import PieceEncoder, PieceTable, gather
from tallyglass.llm.store import written
from tallyglass.llm.worker import per_worker, reuse_memory, tidy

MAGIC = b"REPAIR01"
SHARD_IDS = 1_000_000
LEAST_COUNT = 12
INDEX_STEP = 1024
SHORT = 32
_GONE = np.uint32(0xFFFFFFFF)
_NO_RANK = (1 << 31) - 1


def compress(ids: np.ndarray, base: int, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and the left and right symbol of each rule; ids are below ``base``, rule k is the symbol base + k.

    Rounds go on until no pair occurs ``least`` times without overlapping itself.
    """
    sym, left, right = _replace(ids, base, least)
    return sym[sym != _GONE], left, right


def compress_pieces(
    ids: np.ndarray, counts: np.ndarray, own: np.ndarray, base: int, least: int = LEAST_COUNT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``compress`` for a row of pieces, of which ``own`` tells the number; piece k has ``counts[k]`` ids, all in a row in ``ids``.

    Pairs inside pieces come first, each piece being looked at once with the number of times that it occurs; the rounds then go
    on over the whole row until no pair is frequent.
    """
    ends = np.cumsum(counts, dtype=np.int64)
    times = np.bincount(own, minlength=len(counts))
    sym, left, right = _replace(ids, base, least, np.repeat(times, counts), ends)
    there = sym != _GONE
    kept = np.append(0, np.cumsum(there))
    begin, stop = kept[ends - counts], kept[ends]
    row = gather(sym[there], begin[own], (stop - begin)[own])
    sym, more_left, more_right = _replace(row, base + len(left), least)
    return sym[sym != _GONE], np.append(left, more_left), np.append(right, more_right)


def _replace(
    ids: np.ndarray, base: int, least: int, times: np.ndarray | None = None, ends: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols in the places of ``ids``, ``_GONE`` where one joined that before it, and the new rules.

    A place counts ``times``; runs of places that stop at ``ends`` are apart. In a round, a frequent pair is
    replaced wherever no neighbouring pair is more frequent, if that leaves it frequent; the first one always is.
    Places are linked, so a round looks only at pairs that may be frequent and at those next to what it replaced.
    Pairs are sorted together with their places, which brings equal ones together.
    """
    n = len(ids)
    none = np.zeros(0, np.uint32)
    sym = np.append(ids.astype(np.uint32), _GONE)  # place n stands for none, before the first place and behind the last
    kind = np.int32 if n < _NO_RANK else np.int64  # half the memory moves
    after = np.append(np.arange(1, n + 1, dtype=kind), kind(n))
    before = np.append(np.arange(-1, n - 1, dtype=kind), kind(n - 1))
    before[0] = n
    if ends is not None:
        after[ends[ends > 0] - 1] = n
        before[ends] = n
    rank_at = np.full(n + 1, _NO_RANK, np.int32)  # of pairs that occur ``least`` times
    marked = np.zeros(-(-(n + 1) // 8) * 8, bool)
    eights = marked.reshape(-1, 8)
    lefts, rights = [none], [none]
    top = base
    bits = max(n, 1).bit_length()
    low = np.uint64((1 << bits) - 1)
    # Pairs of old symbols only get rarer: one that was rare is not counted again, but for those of equal symbols.
    known = (np.bincount(sym[:n], times, minlength=1)[sym[:n]] >= least) if n else np.zeros(0, bool)
    live = np.flatnonzero(known[:-1] & known[1:]).astype(kind)
    if ends is not None:
        live = live[after[live] != n]
    while len(live):
        right = after[live]
        a, b = sym[live], sym[right]
        twin = np.flatnonzero(a == b)
        pair_bits = max(top - 1, 1).bit_length()
        if 2 * pair_bits + bits <= 64:
            names, packed = None, _joined(a.astype(np.uint64), pair_bits, b)
        else:
            packed, names = pd.factorize(_joined(a.astype(np.uint64), 32, b))
            packed = packed.astype(np.uint64)
        packed = _joined(packed, bits, live.view(np.uint32 if kind is np.int32 else np.uint64))
        if len(twin):  # in a run of equal symbols every other pair counts, from its first on
            nth = np.arange(len(twin))
            begin = np.maximum.accumulate(np.where(np.r_[True, live[twin[1:]] != right[twin[:-1]]], nth, 0))
            counted = np.ones(len(live), bool)
            counted[twin[(nth - begin) % 2 == 1]] = False
            packed = packed[counted]
        packed.sort()
        pair = packed >> np.uint64(bits)
        at = (packed & low).astype(kind)
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        size = np.diff(first, append=len(pair))
        count = size if times is None else np.add.reduceat(times[at], first)
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]  # by rank from here on
        rank = np.full(len(size), _NO_RANK, np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        kinds = pair[first[often]]
        mine = np.repeat(rank, size)
        keep = np.flatnonzero(mine != _NO_RANK)
        at = at[keep]
        rank_at[at] = mine[keep]
        at.sort()  # from here on in the order of places, for the sake of the processor's cache
        mine = rank_at[at]
        marked[live[twin]] = True
        marked[at] = True
        best = np.flatnonzero((mine < rank_at[before[at]]) & (mine < rank_at[after[at]]))
        rank_at[at] = _NO_RANK
        at, mine = at[best], mine[best]
        used = np.bincount(mine, None if times is None else times[at], minlength=len(often))
        chosen = np.flatnonzero(used >= least)
        name = np.full(len(often), -1, np.int64)
        name[chosen] = top + np.arange(len(chosen))
        taken = np.flatnonzero(name[mine] >= 0)
        at, mine = at[taken], mine[taken]
        if names is None:
            lefts.append((kinds[chosen] >> np.uint64(pair_bits)).astype(np.uint32))
            rights.append((kinds[chosen] & np.uint64((1 << pair_bits) - 1)).astype(np.uint32))
        else:
            both = names[kinds[chosen].astype(np.int64)]
            lefts.append((both >> np.uint64(32)).astype(np.uint32))
            rights.append((both & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        top += len(chosen)
        gone = after[at]
        follow = after[gone]
        sym[at] = name[mine]
        sym[gone] = _GONE
        after[at] = follow
        before[follow] = at
        marked[at] = True
        marked[before[at]] = True
        marked[gone] = False
        marked[[n, before[n]]] = False
        some = np.flatnonzero(marked.view(np.uint64))  # of eight places
        each = np.flatnonzero(eights[some].ravel())
        live = (some[each >> 3] * 8 + (each & 7)).astype(kind)
        marked[live] = False
        if ends is not None:
            live = live[after[live] != n]
    return sym[:n], np.concatenate(lefts), np.concatenate(rights)


def _lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    out = np.ones(len(left), np.int64)
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        out[k] = (out[a - base] if a >= base else 1) + (out[b - base] if b >= base else 1)
    return out


def _joined(high: np.ndarray, bits: int, low: np.ndarray) -> np.ndarray:
    """``high`` followed by so many bits of ``low``, in the memory of ``high``."""
    high <<= np.uint64(bits)
    high |= low
    return high


def pack_shard(docs: list[int | None], counts: list[int], ids: np.ndarray, base: int, least: int = LEAST_COUNT) -> bytes:
    return _packed(docs, counts, base, *compress(ids, base, least))


def _pack_pieces(
    docs: list[int | None], counts: list[int], held: list[tuple[PieceTable, np.ndarray]], base: int, least: int
) -> bytes:
    """A shard of pieces, given by their numbers in tables."""
    owns, ids, sizes = [], [], []
    begin = done = 0
    while begin < len(held):  # tables follow each other
        table, stop = held[begin][0], begin
        while stop < len(held) and held[stop][0] is table:
            stop += 1
        numbers = np.concatenate([x for _, x in held[begin:stop]])
        place = np.zeros(len(table), np.int32)
        place[numbers] = 1
        used = np.flatnonzero(place)
        place[used] = np.arange(done, done + len(used))
        owns.append(place[numbers])
        ids.append(table.ids(used))
        sizes.append(table.known_len.all[used])
        done += len(used)
        begin = stop
    return _packed(docs, counts, base, *compress_pieces(np.concatenate(ids), np.concatenate(sizes), np.concatenate(owns), base, least))


def _packed(docs: list[int | None], counts: list[int], base: int, sym: np.ndarray, left: np.ndarray, right: np.ndarray) -> bytes:
    lens = _lengths(left, right, base)
    size = np.ones(len(sym), np.int64)
    rule = sym >= base
    size[rule] = lens[sym[rule].astype(np.int64) - base]
    index = (np.cumsum(size) - size)[::INDEX_STEP]
    kind = np.dtype("<u2") if base + len(left) <= 1 << 16 else np.dtype("<u4")
    head = np.array([len(docs), len(sym), len(left), size.sum(), base, kind.itemsize], "<u8")
    parts = [
        head, np.array([d or 0 for d in docs], "<i8"), np.array([d is None for d in docs], "u1"), np.array(counts, "<u8"),
        left.astype(kind), right.astype(kind), lens.astype("<u8"), index.astype("<u8"), sym.astype(kind),
    ]
    return MAGIC + b"".join(p.tobytes() for p in parts)


class Shard:
    """A packed shard; ``ids(start, count)`` decodes a run of ids alone."""

    def __init__(self, payload: bytes):
        if payload[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard")
        at = len(MAGIC)

        def read(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        docs, symbols, rules, self.n_ids, self.base, size = (int(x) for x in read("<u8", 6))
        numbers, missing = read("<i8", docs), read("u1", docs)
        self.doc_ids = [None if m else d for d, m in zip(numbers.tolist(), missing.tolist())]
        self.counts = read("<u8", docs).astype(np.int64)
        kind = f"<u{size}"
        self.left, self.right = read(kind, rules), read(kind, rules)
        self.lens = read("<u8", rules).astype(np.int64)
        self.index = read("<u8", -(-symbols // INDEX_STEP)).astype(np.int64)
        self.symbols = read(kind, symbols)
        self.short = None

    def ids(self, start: int = 0, count: int | None = None) -> np.ndarray:
        stop = self.n_ids if count is None else start + count
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = max(0, int(np.searchsorted(self.index, start, "right")) - 1)
        last = int(np.searchsorted(self.index, stop, "left"))
        sym = self.symbols[first * INDEX_STEP : last * INDEX_STEP].astype(np.int64)
        size = self._sizes(sym)
        at = np.cumsum(size) - size + int(self.index[first])
        flat, flat_at = self._short_rules()
        if start == 0 and stop == self.n_ids:
            # All symbols in a row: each id's place in the table follows from its symbol's. Long symbols come below.
            begin = np.where(sym < self.base, sym, 0)
            rule = np.flatnonzero(sym >= self.base)
            begin[rule] = self.base + flat_at[sym[rule] - self.base]
            table = np.concatenate([np.arange(self.base, dtype=np.uint32), flat])
            place = np.repeat(begin - at, size)
            place += np.arange(stop)
            out = table.take(place, mode="clip")
            long = size > SHORT
            sym, at, size = sym[long], at[long], size[long]
        else:
            out = np.empty(stop - start, np.uint32)
        # Short symbols inside the run are looked up whole; others give way to their two sides, all at once.
        while len(sym):
            inside = (at < stop) & (at + size > start)
            sym, at, size = sym[inside], at[inside], size[inside]
            rule = sym >= self.base
            out[at[~rule] - start] = sym[~rule]
            sym, at, size = sym[rule], at[rule], size[rule]
            short = (size <= SHORT) & (at >= start) & (at + size <= stop)
            count = size[short]
            ramp = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out[np.repeat(at[short] - start, count) + ramp] = flat[np.repeat(flat_at[sym[short] - self.base], count) + ramp]
            sym, at = sym[~short], at[~short]
            left, right = (side[sym - self.base].astype(np.int64) for side in (self.left, self.right))
            before = self._sizes(left)
            sym, at = np.r_[left, right], np.r_[at, at + before]
            size = np.r_[before, self._sizes(right)]
        return out

    def _short_rules(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rules that stand for at most ``SHORT``, in a row, and where each rule's begin."""
        if self.short is None:
            made = [b""] * len(self.left)
            for k, (a, b, n) in enumerate(zip(self.left.tolist(), self.right.tolist(), self.lens.tolist())):
                if n <= SHORT:
                    made[k] = b"".join([made[x - self.base] if x >= self.base else x.to_bytes(4, "little") for x in (a, b)])
            size = np.fromiter(map(len, made), np.int64, len(made)) // 4
            self.short = np.frombuffer(b"".join(made), "<u4"), np.cumsum(size) - size
        return self.short

    def _sizes(self, sym: np.ndarray) -> np.ndarray:
        size = np.ones(len(sym), np.int64)
        rule = sym >= self.base
        size[rule] = self.lens[sym[rule] - self.base]
        return size


def _library(spec: str):
    """Ids of pieces by the tokenizers library."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(spec)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    steps = json.loads(spec)
    rule = steps.get("pre_tokenizer") or {}
    plain = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space", True)
    if plain and steps.get("normalizer") is None:
        encode = _by_model(tokenizer.model)
    else:
        encode = _by_lines(tokenizer)
    return PieceEncoder(encode, special, 800_000), tokenizer.get_vocab_size()


def _by_model(model) -> Callable[[list[str]], list[bytes]]:
    """The library's model alone, given each piece in the letters that stand for its bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letter = np.zeros(256, "<u2")
    letter[plain] = plain
    letter[[b for b in range(256) if b not in plain]] = 256 + np.arange(256 - len(plain))

    def encode(pieces: list[str]) -> list[bytes]:
        raws = [p.encode("utf-8", "surrogatepass") for p in pieces]
        letters = letter[np.frombuffer(b"".join(raws), np.uint8)].tobytes().decode("utf-16-le")
        ids: list[int] = []
        ends = [0]
        at = 0
        for raw in raws:
            stop = at + len(raw)
            ids += [token.id for token in model.tokenize(letters[at:stop])]
            ends.append(4 * len(ids))
            at = stop
        packed = np.array(ids, "<u4").tobytes()
        return [packed[i:j] for i, j in zip(ends, ends[1:])]

    return encode


def _by_lines(tokenizer) -> Callable[[list[str]], list[bytes]]:
    """The whole tokenizer; pieces travel many to a call, apart by line breaks."""

    def plain(pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    line_break = plain(["\n"])[0]

    def encode(pieces: list[str]) -> list[bytes]:
        alone = [k for k, p in enumerate(pieces) if "\n" in p or p.isspace()]
        rest = np.ones(len(pieces), bool)
        rest[alone] = False
        if len(line_break) != 1:
            alone, rest = list(range(len(pieces))), np.zeros(len(pieces), bool)
        rest = np.flatnonzero(rest).tolist()
        out: list[bytes] = [b""] * len(pieces)
        chunks = [rest[i : i + 200] for i in range(0, len(rest), 200)]
        for chunk, ids in zip(chunks, plain(["\n".join([pieces[k] for k in c]) for c in chunks])):
            numbers = np.array(ids, "<u4")
            cuts = np.flatnonzero(numbers == line_break[0])
            if len(cuts) != len(chunk) - 1:
                alone += chunk
                continue
            packed = numbers.tobytes()
            ends = (4 * cuts).tolist()
            for k, i, j in zip(chunk, [0, *(e + 4 for e in ends)], [*ends, len(packed)]):
                out[k] = packed[i:j]
        for k, ids in zip(alone, plain([pieces[k] for k in alone])):
            out[k] = np.array(ids, "<u4").tobytes()
        return out

    return encode


def library_encoder(spec: str) -> tuple[PieceEncoder, int]:
    return per_worker(("library", hash(spec), len(spec)), lambda: _library(spec), 2)


_SHARDS = "part int, seq int, start long, n_docs long, n_ids long, payload binary"


def write_shards(
    docs: DataFrame, tokenizer_file: str, end_id: int = 2, shard_ids: int = SHARD_IDS, least_count: int = LEAST_COUNT
) -> DataFrame:
    """The token ids of all texts as a written table of Re-Pair shards, in ascending order of ``doc_id``.

    Texts are encoded by the tokenizers library without special tokens added, and ``end_id`` is appended to each. A
    null text counts as empty: one id, the end. Rows without ``doc_id`` come first. Rows that share an id stand next
    to each other, in any order, and may lie in several parts. Shards are (part, seq), and
    ``start`` counts the ids of the part before the shard. A shard ends with the document that fills it, so a longer
    document is a longer shard. Pairs that occur ``least_count`` times in a shard are replaced. Other columns are ignored.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("_row"))
    by = ["doc_id", "_row"]  # ranges cut between rows that share an id
    ordered = own.repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reuse_memory()
        encoder, base = library_encoder(spec.value)
        base = max(base, end_id + 1)
        part = TaskContext.get().partitionId()
        seq = start = count = 0
        held: list[tuple[PieceTable, np.ndarray]] = []
        numbers: list[int | None] = []
        sizes: list[int] = []

        def shard() -> pa.RecordBatch:
            payload = _pack_pieces(numbers, sizes, held, base, least_count)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()),
                    pa.array([len(numbers)], pa.int64()), pa.array([count], pa.int64()), pa.array([payload], pa.binary()),
                ],
                ["part", "seq", "start", "n_docs", "n_ids", "payload"],
            )

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                rows = batch.slice(first, 1000)
                texts = rows.column("text").cast(pa.large_string()).fill_null("").to_pylist()
                for number, chain in zip(rows.column("doc_id").to_pylist(), encoder.pieces(texts)):
                    size = 1 + sum(int(table.known_len.all[x].sum()) for table, x in chain)
                    held += chain
                    held.append((chain[-1][0], np.array([chain[-1][0].number(end_id)])))
                    numbers.append(number)
                    sizes.append(size)
                    count += size
                    if count >= shard_ids:
                        yield shard()
                        seq, start, count, held, numbers, sizes = seq + 1, start + count, 0, [], [], []
        if held:
            yield shard()

    return written(ordered.mapInArrow(tidy(run), _SHARDS), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document of written shards; ``start`` counts all ids before it.

    ``ids`` are little-endian 32-bit numbers. The driver holds one number for each part (a partition of the writer).
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before: dict[int, int] = {}
    done = 0
    for row in totals:
        before[row.part] = done
        done += row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "payload"))):
                shard = Shard(payload)
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.counts)
                begins = ends - shard.counts
                own = [ids[i:j].tobytes() for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.doc_ids, pa.int64()), pa.array(begins + (before[part] + start)),
                        pa.array(shard.counts), pa.array(own, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return shards.select("part", "start", "payload").mapInArrow(tidy(run), "doc_id long, start long, n_tokens long, ids binary")
