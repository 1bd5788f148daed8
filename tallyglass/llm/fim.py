"""Fill-in-middle forms of texts, by list kernels of pyarrow over whole batches.

A batch is split into list arrays of lines, flattened with the number of the text that each line is from, and each line
gets its ordinal. Cut points give every line a role (prefix, middle, suffix); lines are filtered by role, the lists are
built again from the counts, and each text's pieces are joined between the marks. Cut points and form follow from a
hash of the document's id, so a row has the same form in any run and partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.llm.words import runs
from tallyglass.llm.worker import tidy

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK_BYTES = 8 << 20
_DRAWS = ("_h1", "_h2", "_h3", "_h4")
_MADE = ("n", "form", "prefix_chars", "middle_chars", "output")


def draws(seed: int, key: str = "doc_id") -> list[Column]:
    """Four numbers below 2**32 from the hash of seed and key; a null key is hashed as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(name) for k, name in enumerate(_DRAWS)]


def _lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All units of some texts, each with its line break, and how many each text has."""
    parts = pc.split_pattern(texts, "\n")
    values = pc.list_flatten(parts)
    parent = pc.list_parent_indices(parts).to_numpy()
    size = pc.list_value_length(parts).to_numpy().astype(np.int64)
    ordinal = np.arange(len(values)) - (np.cumsum(size) - size)[parent]
    last = ordinal == size[parent] - 1
    # The last part of a text has no break behind it, and is no unit if it is empty.
    whole = pc.if_else(pa.array(last), values, pc.binary_join_element_wise(values, pa.scalar("\n", values.type), pa.scalar("", values.type)))
    unit = ~last | pc.not_equal(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    return whole.filter(pa.array(unit)), np.bincount(parent[unit], minlength=len(texts))


def _pieces(lines: pa.Array, count: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each text: its lines below ``low``, below ``high``, and the rest."""
    parent = np.repeat(np.arange(len(count)), count)
    ordinal = np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count)
    role = (ordinal >= low[parent]).astype(np.int8) + (ordinal >= high[parent])
    out = []
    for k, size in enumerate((low, high - low, count - high)):
        lists = pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)]), lines.filter(pa.array(role == k)))
        out.append(pc.binary_join(lists, pa.scalar("", lines.type)))
    return out


def _formed(texts: pa.Array, h: list[np.ndarray], plain_percent: int, spm_percent: int) -> list[pa.Array]:
    kind = texts.type
    lines, n = _lines(texts)
    cut = [h[0] % (n + 1), h[1] % (n + 1)]
    prefix, middle, suffix = _pieces(lines, n, np.minimum(*cut), np.maximum(*cut))
    marked = pc.equal(pc.binary_length(texts), 0)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = pc.or_(marked, pc.match_substring(texts, mark))
    plain = pc.or_(marked, pa.array(h[2] % 100 >= 100 - plain_percent))
    spm = pa.array(h[3] % 100 < spm_percent)
    mark_p, mark_s, mark_m, none = (pa.scalar(x, kind) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    # The middle stands last in both forms; prefix and suffix change places, with their marks.
    head = pc.if_else(spm, mark_s, mark_p), pc.if_else(spm, suffix, prefix)
    tail = pc.if_else(spm, mark_p, mark_s), pc.if_else(spm, prefix, suffix)
    output = pc.binary_join_element_wise(*head, *tail, mark_m, middle, none)
    form = pc.if_else(plain, pa.scalar("plain"), pc.if_else(spm, pa.scalar("spm"), pa.scalar("psm")))
    no_number = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, no_number, pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
    return [pa.array(n, pa.int64()), form, *chars, pc.if_else(plain, texts, output)]


def fill_in_middle(docs: DataFrame, seed: int = 7, plain_percent: int = 0, spm_percent: int = 50) -> DataFrame:
    """``docs`` with ``n`` (lines), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` of each text.

    A line ends behind its break. The prefix ends after the smaller of two drawn numbers of lines, the middle after
    the larger. ``form`` is plain (``output`` is the text) where the text is empty or holds one of the marks, and in
    ``plain_percent`` of the others; else spm (suffix first) in ``spm_percent``, psm in the rest. Draws follow from
    ``seed`` and ``doc_id``, so rows that share an id, or have none, draw alike. A null text counts as empty. All rows
    come out, with all columns; those of the names above are replaced. No rows move.
    """
    kept = [c for c in docs.columns if c not in _MADE]
    carried = [F.col(c) for c in kept]
    made = [F.lit(0).cast("long").alias("n"), F.lit("").alias("form"), *(F.lit(None).cast("long").alias(c) for c in _MADE[2:4]), F.lit("").alias("output")]
    schema = docs.select(*carried, *made).schema
    text_at = len(kept) + len(_DRAWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_at).cast(pa.large_string())
            for first, stop in runs(pc.binary_length(texts).to_numpy().astype(np.int64), BLOCK_BYTES):
                rows = batch.slice(first, stop - first)
                h = [rows.column(len(kept) + k).to_numpy() for k in range(len(_DRAWS))]
                columns = _formed(texts.slice(first, stop - first), h, plain_percent, spm_percent)
                columns[-1] = columns[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], *columns], [*kept, *_MADE])

    return docs.select(*carried, *draws(seed), F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(tidy(run), schema)


def restore(form: Column, output: Column) -> Column:
    """The text that ``output`` was made of. No text of these forms holds a mark, so the first of each kind is the cut."""
    at_p, at_s, at_m = (F.instr(output, mark) for mark in (PREFIX, SUFFIX, MIDDLE))
    size = len(PREFIX)

    def between(start: Column, stop: Column) -> Column:
        return F.substring(output, start + size, stop - start - size)

    middle = F.substring(output, at_m + size, F.length(output))
    psm = F.concat(between(at_p, at_s), middle, between(at_s, at_m))
    spm = F.concat(between(at_p, at_m), middle, between(at_s, at_p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
