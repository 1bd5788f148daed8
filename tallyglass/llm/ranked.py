"""Ranked keyword search over all documents for a table of items, with documents that score alike scored once.

A document counts for a set of items only by how often it holds their terms and by its length class m. Its text is
restricted to the vocabulary of the items (found by a hash, then compared byte by byte); documents of equal frequency
vector and m are one class. Classes are brought together by a hash and compared as a whole; each is scored once, and the
best classes give out their members by ascending ``doc_id``.

Items are worked on in blocks of bounded vocabulary, so what is broadcast does not grow with their number. Each block
reads all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tallyglass.llm.store import written
from tallyglass.llm.words import blocks, equal_runs, run_hashes
from tallyglass.llm.worker import tidy

BLOCK_TERMS = 200_000  # about so many (item, term) pairs are sent to the tasks at once
BLOCK_CELLS = 1 << 20  # of the classes x items that a task scores together
MERGE_ROWS = 1 << 16

_TERM = np.zeros(256, bool)
_TERM[0x30:0x3A] = _TERM[0x41:0x5B] = _TERM[0x61:0x7B] = _TERM[0x80:] = True
_FIRST = -(1 << 63)  # stands for a missing doc_id in the order


@dataclass
class Vocabulary:
    """Distinct terms in the order of their hashes."""

    key: np.ndarray
    text: np.ndarray
    at: np.ndarray
    size: np.ndarray

    def numbers(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The number of each run's term, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.key) or not len(starts):
            return out
        key = run_hashes(data, starts, size)
        place = np.searchsorted(self.key, key)
        left = np.arange(len(starts))
        while len(left):  # again only for terms that share a hash
            left = left[place[left] < len(self.key)]
            left = left[self.key[place[left]] == key[left]]
            term = place[left]
            same = equal_runs(data, starts[left], size[left], self.text, self.at[term], self.size[term])
            out[left[same]] = term[same]
            left = left[~same]
            place[left] += 1
        return out


def _vocabulary(terms: list[bytes]) -> tuple[Vocabulary, np.ndarray]:
    """A vocabulary, and the number of each of ``terms``, which are distinct."""
    size = np.array([len(t) for t in terms], np.int64)
    at = np.cumsum(size) - size
    text = np.frombuffer(b"".join(terms), np.uint8)
    key = run_hashes(text, at, size) if len(terms) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    number = np.empty(len(terms), np.int64)
    number[order] = np.arange(len(terms))
    return Vocabulary(key[order], text, at[order], size[order]), number


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, term`` (bytes), each pair once: lower-cased runs of ASCII letters, digits and what is beyond ASCII."""
    schema = items.select("item_id", F.lit(b"").alias("term")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), lower=True, letters=_TERM):
                row = pa.array(b.row_of_word() + b.first)
                raw = b.data.tobytes()
                terms = [raw[i:j] for i, j in zip(b.starts.tolist(), b.ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(row), pa.array(terms, pa.binary())], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(tidy(run), schema).distinct()


_COUNTED = "doc_id long, n long, vector binary, term long, df long"
_COUNTED_NAMES = ["doc_id", "n", "vector", "term", "df"]


def _counted(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Of each document its number of terms and its vector; of each task how many documents hold each term.

    A vector is the ascending numbers of the vocabulary's terms in the text, then their frequencies (32 bits each);
    null where there are none.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.key, vocabulary.text, vocabulary.at, vocabulary.size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(*shared.value)
        width = max(1, len(own.key))
        df = np.zeros(width, np.int64)
        for batch in batches:
            for b in blocks(batch.column("text"), lower=True, letters=_TERM):
                rows = b.stop - b.first
                term = own.numbers(b.data, b.starts, b.ends - b.starts)
                found = term >= 0
                cell, tf = np.unique(b.row_of_word()[found] * width + term[found], return_counts=True)
                row, term = cell // width, cell % width
                df += np.bincount(term, minlength=width)
                cut = np.searchsorted(row, np.arange(rows + 1)).tolist()
                term, tf = term.astype("<u4"), tf.astype("<u4")
                vectors = [term[i:j].tobytes() + tf[i:j].tobytes() if j > i else None for i, j in zip(cut[:-1], cut[1:])]
                none = pa.nulls(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(b.first, rows), pa.array(b.n_words, pa.int64()), pa.array(vectors, pa.binary()), none, none],
                    _COUNTED_NAMES,
                )
        term = np.flatnonzero(df)
        none = pa.nulls(len(term), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(term), pa.binary()), pa.array(term), pa.array(df[term])], _COUNTED_NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), _COUNTED)


def _members(counted: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``class_id, m, vector, doc_id, nth``: the first ``k`` members of each class; the first one carries the vector.

    Rows meet by hash, vector and m, so the classes are of equal content; no task holds more than ``k`` rows of a
    class for each task before it.
    """
    rows = counted.where("vector IS NOT NULL").select(
        "doc_id", "vector", F.expr(f"50L + (50L * n * {n_docs}L) div {n_terms}L").alias("m"), F.monotonically_increasing_id().alias("_row")
    )
    rows = rows.withColumn("_hash", F.xxhash64("vector", "m"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_row").asc()]
    own = Window.partitionBy("_hash", "vector", "m").orderBy(*order)
    ranked = rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k)
    first = F.first("_row").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.select(
        first.alias("class_id"), "m", F.when(F.col("nth") == 1, F.col("vector")).alias("vector"), "doc_id", "nth"
    )


class _Best:
    """The ``k`` best classes of each item so far: highest score, then smallest first document, then class."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.worst = np.zeros(n_items, np.int64)  # a score must be above 0, and reach that of the k-th class
        self.rows: list[np.ndarray] = []
        self.count = 0

    def add(self, scores: np.ndarray, doc: np.ndarray, own: np.ndarray) -> None:
        """Classes x items ``scores``; ``doc`` and ``own`` are the classes' first documents and numbers."""
        good = (scores > 0) & (scores >= self.worst)
        if len(scores) > self.k:
            good &= scores >= np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
        at, item = np.nonzero(good)
        if len(at):
            self.rows.append(np.stack([item, scores[at, item], doc[at], own[at]]))
            self.count += len(at)
            if self.count > 2 * self.k * len(self.worst) + MERGE_ROWS:
                self.merge()

    def merge(self) -> np.ndarray:
        if not self.rows:
            return np.zeros((4, 0), np.int64)
        item, score, doc, own = rows = np.concatenate(self.rows, axis=1)
        order = np.lexsort((own, doc, -score, item))
        rows = rows[:, order]
        nth = np.arange(len(order)) - np.searchsorted(rows[0], rows[0])
        full = nth == self.k - 1
        self.worst[rows[0][full]] = rows[1][full]
        rows = rows[:, nth < self.k]
        self.rows, self.count = [rows], rows.shape[1]
        return rows


def _scored(members: DataFrame, weight: np.ndarray, first: np.ndarray, asked: np.ndarray, n_items: int, k: int) -> DataFrame:
    """``item, class_id, doc_id, score``: the best ``k`` classes of each item in each task.

    Term t is asked for by the items ``asked[first[t]]`` to ``asked[first[t + 1]]``.
    """
    shared = members.sparkSession.sparkContext.broadcast((weight, first, asked))
    schema = pa.schema([("item", pa.int64()), ("class_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, first, asked = shared.value
        best = _Best(n_items, k)
        step = max(1, BLOCK_CELLS // n_items)
        for batch in batches:
            doc = batch.column("doc_id").fill_null(_FIRST).to_numpy()
            own, m = batch.column("class_id").to_numpy(), batch.column("m").to_numpy()
            vectors = batch.column("vector").to_pylist()
            for i in range(0, len(vectors), step):
                part = [np.frombuffer(v, "<u4").astype(np.int64).reshape(2, -1) for v in vectors[i : i + step]]
                scores = np.zeros((len(part), n_items), np.int64)
                row = np.repeat(np.arange(len(part)), [p.shape[1] for p in part])
                term, tf = np.concatenate(part, axis=1)
                share = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[i : i + step][row]))
                for a, z in _pieces(first[term + 1] - first[term]):
                    count = first[term[a:z] + 1] - first[term[a:z]]
                    entry = np.repeat(first[term[a:z]] - np.cumsum(count) + count, count) + np.arange(count.sum())
                    cell = np.repeat(row[a:z], count) * n_items + asked[entry]
                    _add_at(scores.reshape(-1), cell, np.repeat(share[a:z], count))
                best.add(scores, doc[i : i + step], own[i : i + step])
        item, score, doc, own = best.merge()
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(own), pa.array(doc, mask=doc == _FIRST), pa.array(score)], schema=schema
        )

    rows = members.where("nth = 1").select("class_id", "doc_id", "m", "vector")
    return rows.mapInArrow(tidy(run), "item long, class_id long, doc_id long, score long")


def _pieces(sizes: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    total = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        stop = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + limit, "right")))
        yield first, stop
        first = stop


def _add_at(out: np.ndarray, cell: np.ndarray, value: np.ndarray) -> None:
    """Add values to cells. Sums of doubles are exact below 2**53; larger ones are added as integers."""
    if len(value) and int(value.max()) * len(value) < 1 << 53:
        out += np.bincount(cell, value, len(out)).astype(np.int64)
    else:
        np.add.at(out, cell, value)


def _best_rows(rows: DataFrame, keys: list[str], order: list, k: int, name: str = "_nth") -> DataFrame:
    own = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(name, F.row_number().over(own)).where(F.col(name) <= k)


def _ranked_block(pairs: list[tuple], docs: DataFrame, k: int) -> tuple[DataFrame, list] | None:
    """``item, rank, doc_id, score`` for the (item, term) pairs of one block of items, and the items by number."""
    names = list(dict.fromkeys(i for i, _ in pairs))
    item_of = {name: n for n, name in enumerate(names)}
    terms = sorted({t for _, t in pairs})
    vocabulary, number = _vocabulary(terms)
    term_of = dict(zip(terms, number.tolist()))
    item = np.array([item_of[i] for i, _ in pairs], np.int64)
    term = np.array([term_of[t] for _, t in pairs], np.int64)
    by_term = np.argsort(term, kind="stable")
    first = np.searchsorted(term[by_term], np.arange(len(terms) + 1))

    counted = written(_counted(docs, vocabulary), "counted")
    sums = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n_docs"), F.sum("n").alias("n_terms")).first()
    if not sums.n_docs:
        return None
    df = np.zeros(len(terms), np.int64)
    for row in counted.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of the block
        df[row.term] = row.df
    weight = np.floor(1000 * np.log((2.0 * sums.n_docs + 2) / (2.0 * df + 1))).astype(np.int64)

    members = written(_members(counted, sums.n_docs, sums.n_terms, k), "members")
    found = _scored(members, weight, first, item[by_term], len(names), k)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("class_id")]
    # Twice, so that no task ranks rows of all tasks for an item: first among a share of them.
    share = F.pmod(F.xxhash64("class_id"), F.lit(16))
    best = _best_rows(found.withColumn("_share", share), ["item", "_share"], order, k).drop("_nth", "_share")
    best = _best_rows(best, ["item"], order, k).select("item", "class_id", "score")
    each = best.join(members.select("class_id", "doc_id", "nth"), "class_id")
    ranked = _best_rows(each, ["item"], [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("class_id"), F.col("nth")], k, "rank")
    return ranked.select("item", "rank", "doc_id", "score"), names


def rank_documents(items: DataFrame, docs: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` highest-scoring of all ``docs`` for each item, equal ones by ``doc_id``.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased. With N
    documents that have a term, L terms in all, n in a document and df documents that hold a term, its weight is
    floor(1000 ln((2 N + 2) / (2 df + 1))); m is 50 + 50 n N div L; a document scores the sum over the item's distinct
    terms of weight * (10**9 tf div (1000 tf + 20 m)). Documents that score 0 are left out, so an item without terms has
    no rows. Items that share an id are one item with the terms of all. Null texts have no terms. Rows of ``docs`` that
    share an id are documents each; one without an id comes before others of its score. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = items.select("item_id", F.lit(0).alias("rank"), *(F.lit(0).cast("long").alias(c) for c in ("doc_id", "score"))).schema
    pairs = written(item_terms(items), "item-terms")
    n_blocks = -(-pairs.count() // block_terms)
    result = None
    for number in range(n_blocks):
        block = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number)
        table = block.toArrow()
        made = _ranked_block(list(zip(table.column("item_id").to_pylist(), table.column("term").to_pylist())), docs, k) if table.num_rows else None
        if made is None:
            continue
        ranked, names = made
        numbers = spark.createDataFrame(list(enumerate(names)), items.select(F.lit(0).cast("long").alias("item"), "item_id").schema)
        part = ranked.join(F.broadcast(numbers), "item").select("item_id", "rank", "doc_id", "score")
        if n_blocks > 1:
            part = written(part, "ranked")
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], out) if result is None else result
