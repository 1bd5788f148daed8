"""Quality rules: plain counts, and a calibrated logistic regression on hashed word and character n-grams.

Features are relative frequencies, so a text's score is a mean of weights over its n-grams: scoring looks weights up
and adds them, with no feature vector. The model is fitted on a bounded sample of labelled rows inside one task, and
its weights (a fixed number) are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.words import Block, blocks, mix, window_hashes
from tallyglass.llm.worker import tidy

SAMPLE_ROWS = 3000  # most labelled rows that the model is fitted on
BITS = 16  # weights of each of the four kinds of n-grams
EPOCHS = 12
FOLDS = 5  # one of so many folds of the sample calibrates
KEEP_FROM = 0.5  # calibrated probability of good quality

MIN_WORDS = 20
REPEAT_WORDS = 8
MAX_REPEAT_PERCENT = 30

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_KINDS = 4  # character pairs and triples, words and word pairs
_SCALE = 30.0  # of relative frequencies, so that a step of the fit moves a score by about as much


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * (score + self.bias) + self.shift)))


def _sums(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run from ``at[r]`` to ``at[r + 1]``; the order of additions depends on the run alone."""
    if not len(value):
        return np.zeros(len(at) - 1, value.dtype if value.dtype != bool else np.int64)
    out = np.add.reduceat(np.append(value, value.dtype.type(0)), np.minimum(at[:-1], len(value)))
    return np.where(at[1:] > at[:-1], out, 0)


def _grams(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind the feature of each n-gram of a block, and where each text's n-grams begin and the last end."""
    data = b.data.astype(np.uint32)
    top = np.uint32(32 - BITS)
    for k, n in enumerate((2, 3)):
        room = np.maximum(np.diff(b.byte_at) - n + 1, 0)
        at = np.r_[0, np.cumsum(room)]
        value = np.full(max(len(data) - n + 1, 0), k, np.uint32)
        for j in range(n):
            value += data[j : len(data) - n + 1 + j] << np.uint32(8 * j)
        value = ((value * np.uint32(0x9E3779B1)) ^ (value >> np.uint32(7))) * np.uint32(0x85EBCA6B) >> top
        inside = np.ones(len(value), bool)
        cut = (b.byte_at[1:-1, None] - np.arange(1, n)[None, :]).ravel()
        inside[cut[(cut >= 0) & (cut < len(value))]] = False
        yield value[inside].astype(np.int64) + (k << BITS), at
    words = b.hashes()
    for k, n in enumerate((1, 2), 2):
        places = b.window_starts(n)
        at = np.r_[0, np.cumsum(np.maximum(b.n_words - n + 1, 0))]
        value = window_hashes(words, places, n) >> np.uint64(64 - BITS)
        yield value.astype(np.int64) + (k << BITS), at


def _scores(b: Block, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(b.stop - b.first)
    for feature, at in _grams(b):
        out += _SCALE * _sums(weights[feature], at) / np.maximum(np.diff(at), 1)
    return out


def _vectors(b: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and values of each text of a block."""
    kinds = list(_grams(b))
    for r in range(b.stop - b.first):
        names, values = [], []
        for feature, at in kinds:
            own, count = np.unique(feature[at[r] : at[r + 1]], return_counts=True)
            names.append(own)
            values.append(_SCALE * count / max(1, count.sum()))
        yield np.concatenate(names), np.concatenate(values)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray) -> Model:
    """Adagrad over single rows, then Platt scaling on the fold that was left out. ``good`` holds 0 and 1."""
    fold = np.arange(len(rows)) % FOLDS == 0
    if len(set(good[~fold])) < 2 or len(set(good[fold])) < 2:  # nothing to tell apart: all rows are alike
        return Model(np.zeros(_KINDS << BITS, np.float64), 0.0, 0.0, 50.0)
    weights = np.zeros(_KINDS << BITS)
    squares = np.full(_KINDS << BITS, 1e-4)
    bias, bias_square = 0.0, 1e-4
    order = np.random.RandomState(7)
    train = np.flatnonzero(~fold)
    rare = 1 / np.maximum(np.bincount(good[train], minlength=2), 1) * len(train) / 2
    for _ in range(EPOCHS):
        for r in order.permutation(train):
            names, values = rows[r]
            score = float(values @ weights[names]) + bias
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - good[r]) * min(rare[good[r]], 4.0)
            step = error * values + 1e-6 * weights[names]
            squares[names] += step * step
            weights[names] -= 0.1 * step / np.sqrt(squares[names])
            bias_square += error * error
            bias -= 0.1 * error / np.sqrt(bias_square)
    score = np.array([float(rows[r][1] @ weights[rows[r][0]]) + bias for r in np.flatnonzero(fold)])
    slope, shift = _platt(score, good[fold])
    return Model(weights, bias, slope, shift)


def _platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make the logistic of a score a probability, by Newton steps with smoothed targets."""
    n1, n0 = good.sum(), len(good) - good.sum()
    target = np.where(good == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.std(score)), 1e-9)
    x = np.stack([score / scale, np.ones(len(score))], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (p - target) + 1e-6 * at
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(at[0]), 0.0) / scale, float(at[1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of ``labels.quality`` from at most ``sample_rows`` labelled documents, taken by a hash of the id.

    Labels other than 0 and 1, without a document or id are passed over; of several labels of an id the least counts.
    Without both labels in the sample every text passes the model.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
    known = known.where("doc_id IS NOT NULL AND good IN (0, 1)").groupBy("doc_id").agg(F.min("good").alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most ``sample_rows`` pairs of numbers are broadcast; their texts meet in one task.
    sample = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    sample = sample.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        good: list[int] = []
        for batch in batches:
            good += batch.column("good").to_pylist()
            for b in blocks(batch.column("text")):
                rows += _vectors(b)
        model = fit(rows, np.array(good, np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in (model.bias, model.slope, model.shift))],
            ["weights", "bias", "slope", "shift"],
        )

    found = sample.mapInArrow(tidy(run), "weights binary, bias double, slope double, shift double").collect()
    if not found:
        return fit([], np.zeros(0, np.int64))
    return Model(np.frombuffer(found[0].weights), found[0].bias, found[0].slope, found[0].shift)


def _repeat_words(b: Block) -> np.ndarray:
    """Words of each text that lie in a window of eight words found twice or more in the text."""
    places = b.window_starts(REPEAT_WORDS)
    row = b.row_of_word()
    key = mix(window_hashes(b.hashes(), places, REPEAT_WORDS) ^ mix(row[places].astype(np.uint64) + np.uint64(1)))
    own, names = pd.factorize(key)
    often = places[np.bincount(own, minlength=len(names))[own] > 1] if len(places) else places
    change = np.zeros(len(b.starts) + 1, np.int64)
    np.add.at(change, often, 1)
    np.add.at(change, often + REPEAT_WORDS, -1)
    return _sums((np.cumsum(change[:-1]) > 0).astype(np.int64), b.word_at)


def _repeat_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(b: Block) -> dict[str, np.ndarray]:
    n = b.stop - b.first
    lens = b.ends - b.starts
    in_word = np.zeros(len(b.data) + 1, np.int8)
    in_word[b.starts] += 1
    in_word[b.ends] -= 1
    letter = (np.cumsum(in_word[:-1], dtype=np.int8) > 0) & ((b.data & 0xC0) != 0x80) if len(lens) else np.zeros(len(b.data), bool)
    raw = b.data.tobytes()
    at = b.byte_at.tolist()
    return {
        "n_words": b.n_words.astype(np.int64),
        "word_chars": _sums(letter.astype(np.int64), b.byte_at),
        "n_symbols": _sums(_SYMBOL[b.data], b.byte_at),
        "n_dup_lines": np.array([_repeat_lines(raw[at[r] : at[r + 1]]) for r in range(n)], np.int64),
        "n_repeat_words": _repeat_words(b),
    }


def judge(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``probability`` and ``kept`` of each row of ``docs``.

    Words are runs of bytes other than space and 0x09-0x0D. A text fails the base rule with fewer than 20 words, or
    with more than 30 percent of its words in windows of eight that repeat in it; others are kept where the model's
    probability reaches ``keep_from``. Null and empty texts have no words and fail. Ids may be null or repeat; other
    columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spec = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*spec.value)
        for batch in batches:
            for b in blocks(batch.column("text")):
                yield pa.RecordBatch.from_pydict(_judge(batch.column("doc_id").slice(b.first, b.stop - b.first), b, model, keep_from))

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return own.mapInArrow(tidy(run), f"doc_id long, {counts}, base_failed boolean, probability double, kept boolean")


def judged_rows(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    spec = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.slope, model.shift))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*spec.value)
        for batch in batches:
            for b in blocks(batch.column(batch.schema.get_field_index("text"))):
                part = batch.slice(b.first, b.stop - b.first)
                yield part.filter(pa.array(_judge(None, b, model, keep_from)["kept"]))

    return docs.mapInArrow(tidy(run), docs.schema)


def _judge(ids, b: Block, model: Model, keep_from: float) -> dict:
    m = _measure(b)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    p = model.probability(_scores(b, model.weights))
    return {"doc_id": ids, **m, "base_failed": failed, "probability": p, "kept": ~failed & (p >= keep_from)}
