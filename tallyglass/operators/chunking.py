"""Corpus chunking: titles, sections, token windows.

Everything is row-local on the document, in built-in expressions; no token is ever exploded or
shuffled. A document leaves as one row per section and one row per chunk. Arrays are exploded in the
outer form and empty rows dropped after: for the inner form the optimizer adds a filter on the array's
size below the explode, which would compute the whole array a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.once import named
from tallyglass.functions.text import strip
from tallyglass.operators.tasks import tidy
from tallyglass.operators.tokens import slices, token_spans

CHUNK_SIZE = 256
OVERLAP = 32
_FOLD = 64

# A token is a run of non-space characters; a piece is a token with the space after it.
_SPACE = r"[ \t\n\r\f]"
_TOKEN = r"[^ \t\n\r\f]"
_PIECE = rf"(?:{_TOKEN}++{_SPACE}*+)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _running(lengths: Column, levels: int = 2) -> Column:
    """[0, l1, l1+l2, ...]

    A fold that appends copies its list at each step, so only runs of ``_FOLD`` are folded; each is then moved by the
    total before it, which is a running sum of fewer numbers. Two levels leave one fold per ``_FOLD`` squared numbers.
    """

    def fold(x):
        return F.aggregate(x, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))

    if not levels:
        return fold(lengths)

    def folded(x):
        run = F.when(F.size(x) > 0, F.sequence(F.lit(0), F.floor((F.size(x) - 1) / F.lit(_FOLD)).cast("int")))
        run = F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(run)
        return F.transform(run, lambda i: fold(F.slice(x, i * _FOLD + 1, _FOLD)))

    def moved(sums, before):
        own = F.transform(
            sums, lambda s, i: F.transform(F.slice(s, F.lit(1), F.size(s) - 1), lambda v: v + F.get(before, i))
        )
        return F.concat(F.flatten(own), F.array(F.element_at(before, -1)))

    def totals(sums):
        return F.transform(sums, lambda s: F.element_at(s, -1))

    return named(
        named(lengths, folded), lambda sums: named(_running(totals(sums), levels - 1), lambda before: moved(sums, before))
    )


def doc_title(content: Column | str) -> Column:
    """Text of the first ``# `` line, else empty."""
    return strip(F.regexp_extract(_col(content), r"(?md)^#(?U:\s+)([^\n]+)$", 1))


def _sections(content: Column) -> Column:
    """Array of (section_no, section, section_text, section_start) of one document."""
    laid_out = named(
        F.split(content, r"(?md)(?=^## [^\n])"),
        lambda pieces: named(
            _running(F.transform(pieces, lambda p: F.length(p))),
            lambda at: F.transform(
                pieces, lambda p, i: F.struct(p.alias("section_text"), F.get(at, i).alias("section_start"))
            ),
        ),
    )

    def is_h2(p):
        return F.rlike(p["section_text"], F.lit(r"^## [^\n]"))

    def has_body(p):
        return strip(F.regexp_replace(p["section_text"], r"(?md)^#[^#][^\n]*\n?", "")) != ""

    return F.transform(
        F.filter(laid_out, lambda p: is_h2(p) | has_body(p)),
        lambda p, i: F.struct(
            i.alias("section_no"),
            strip(F.regexp_extract(p["section_text"], r"^## ([^\n]+)", 1)).alias("section"),
            p["section_text"].alias("section_text"),
            p["section_start"].alias("section_start"),
        ),
    )


def split_sections(df: DataFrame, content: str = "content") -> DataFrame:
    """One row per H2 section: ``section_no``, ``section``, ``section_text``, ``section_start``.

    Text before the first H2 is a section without a name, kept only when it holds more than H1 lines.
    H3 and deeper stay inside their section. Offsets count characters of the document.
    """
    rest = [c for c in df.columns if c != content]
    return df.select(*rest, F.inline_outer(_sections(F.col(content)))).where("section_no is not null")


def section_index(df: DataFrame, content: str = "content") -> DataFrame:
    """Named sections of each document with their start."""
    return split_sections(df, content).where("section <> ''").drop("section_text")


def token_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(_TOKEN + "++"))


def tokenize_offsets(text: Column | str) -> Column:
    """Array of (token, char_start, char_end) of the default tokenizer.

    For inspection of single texts; windows below need no per-token arrays.
    """
    lead = F.length(F.regexp_extract(_col(text), f"^{_SPACE}*", 0))
    pieces = F.regexp_extract_all(_col(text), F.lit(f"({_PIECE})"), F.lit(1))

    def placed(p, start):
        tok = F.regexp_extract(p, f"^{_TOKEN}+", 0)
        return F.struct(tok.alias("token"), start.alias("char_start"), (start + F.length(tok)).alias("char_end"))

    return named(
        F.struct(lead.alias("lead"), pieces.alias("pieces")),
        lambda cut: named(
            _running(F.transform(cut["pieces"], lambda p: F.length(p))),
            lambda at: F.transform(cut["pieces"], lambda p, i: placed(p, cut["lead"] + F.get(at, i))),
        ),
    )


def token_positions(df: DataFrame, text: str) -> DataFrame:
    """One row per token with its character offsets in ``text``.

    Tokens are found in the bytes of many texts at once, so the work is linear for texts of any length and no expression
    is worked out for a single token.
    """
    rest = [c for c in df.columns if c != text]
    numbers = [F.lit(None).cast("int").alias(c) for c in ("char_start", "char_end")]
    schema = df.select(*rest, F.lit(None).cast("int").alias("token_no"), F.lit(None).cast("string").alias("token"), *numbers).schema
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first, last in slices(whole.column(len(rest))):
                batch = whole.slice(first, last - first)
                row, *columns = token_spans(batch.column(len(rest)))
                kept = [c.take(pa.array(row)) for c in batch.columns[: len(rest)]]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names)

    return df.select(*rest, F.col(text).alias("_s")).mapInArrow(tidy(run), schema)


def _strides(text: Column, stride: int) -> Column:
    """Consecutive cuts of ``stride`` tokens each, with the space after them; the last may be short."""
    return F.regexp_extract_all(text, F.lit(f"({_PIECE}{{1,{stride}}}+)"), F.lit(1))


def _cut(text: Column, size: int, overlap: int) -> Column:
    """Struct (lead, strides, n_tok, n_win) of one text, from a single pass over it."""
    stride = size - overlap
    base = F.struct(
        F.length(F.regexp_extract(text, f"^{_SPACE}*", 0)).alias("lead"), _strides(text, stride).alias("strides")
    )
    # transform over one element names the pass once, so the strides are cut once.
    counted = F.transform(
        F.array(base),
        lambda b: F.struct(
            b["lead"].alias("lead"),
            b["strides"].alias("strides"),
            F.when(F.size(b["strides"]) == 0, 0)
            .otherwise((F.size(b["strides"]) - 1) * stride + token_count(F.element_at(b["strides"], -1)))
            .alias("n_tok"),
        ),
    )
    return F.get(
        F.transform(
            counted,
            lambda b: F.struct(
                b["lead"].alias("lead"),
                b["strides"].alias("strides"),
                b["n_tok"].alias("n_tok"),
                F.when(b["n_tok"] == 0, 0)
                .when(b["n_tok"] <= size, 1)
                .otherwise(F.ceil((b["n_tok"] - size) / F.lit(stride)).cast("int") + 1)
                .alias("n_win"),
            ),
        ),
        F.lit(0),
    )


def _windows(cut: Column, size: int, overlap: int) -> Column:
    """Array of (window_no, text_start, text_end, token_count, content) of one cut text."""
    stride = size - overlap
    extra = -(-overlap // stride)
    at = _running(F.transform(cut["strides"], lambda s: F.length(s)))

    def content(i):
        raw = F.array_join(F.slice(cut["strides"], i + 1, F.lit(extra + 1)), "")
        body = F.regexp_extract(raw, f"^{_PIECE}{{1,{size}}}+", 0) if extra else raw
        return F.regexp_replace(body, f"{_SPACE}+$", "")

    # The running starts are computed once per text, then read per window.
    rows = F.transform(
        F.array(at),
        lambda starts: F.transform(
            F.sequence(F.lit(0), cut["n_win"] - 1),
            lambda i: F.struct(
                i.alias("window_no"),
                (cut["lead"] + F.get(starts, i)).alias("text_start"),
                F.least(F.lit(size), cut["n_tok"] - i * stride).alias("token_count"),
                content(i).alias("content"),
            ),
        ),
    )
    return F.when(cut["n_win"] > 0, F.get(rows, F.lit(0)))


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")


def window_chunks(df: DataFrame, text: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """One row per window of ``size`` tokens, each starting ``size - overlap`` after the one before.

    Adds ``window_no``, ``text_start``, ``text_end`` (characters of ``text``), ``token_count`` and
    ``content``. The last window is the first that reaches the end; a text without tokens has none.

    The text is cut once into strides of ``size - overlap`` tokens by one regular expression; a
    window is its stride plus the first ``overlap`` tokens after it. This is linear in the text.
    """
    _check(size, overlap)
    rest = [c for c in df.columns if c != text]
    cut = df.select(*rest, _cut(F.col(text), size, overlap).alias("_cut"))
    return (
        cut.select(*rest, F.inline_outer(_windows(F.col("_cut"), size, overlap)))
        .where("window_no is not null")
        .withColumn("text_end", F.col("text_start") + F.length("content"))
    )


# One text -> (start, end) of each token, as a model's tokenizer reports them.
Tokenizer = Callable[[str], list[tuple[int, int]]]
_WINDOW = "struct<window_no:int,text_start:int,token_count:int,content:string>"


def _windows_by(make: Callable[[], Tokenizer], size: int, overlap: int):
    """Arrow UDF: the texts of a document -> the windows of each, by a pluggable tokenizer."""

    @F.pandas_udf(f"array<array<{_WINDOW}>>")
    def run(docs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()

        def cut(text: str) -> list[dict]:
            spans = list(tokenizer(text))
            starts = range(0, max(len(spans) - overlap, 1), size - overlap) if spans else ()
            rows = []
            for no, first in enumerate(starts):
                part = spans[first : first + size]
                start, end = part[0][0], part[-1][1]
                rows.append({"window_no": no, "text_start": start, "token_count": len(part), "content": text[start:end]})
            return rows

        for series in docs:
            yield pd.Series([[cut(t) for t in (texts if texts is not None else [])] for texts in series], index=series.index)

    return run


def chunk_documents(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    keep: tuple[str, ...] = (),
    tokenizer: Callable[[], Tokenizer] | None = None,
) -> DataFrame:
    """``source, doc_type, content`` -> chunk records; ``source`` identifies the document.

    A document's sections and windows stay on its row until the last step, so the running chunk index
    is a fold over its section list: no shuffle, whatever the size of the corpus or of a document.
    The id is a hash of source and index, the same on every run. ``tokenizer`` makes a model
    tokenizer, once per Python worker task; without one everything stays in built-in expressions.
    """
    _check(size, overlap)
    lead = ["source", "doc_type", *keep]
    titled = docs.select(
        *lead, doc_title("content").alias("doc_title"), _sections(F.col("content")).alias("_s")
    )
    if tokenizer is None:
        cuts = titled.withColumn(
            "_s",
            F.transform(
                "_s",
                lambda s: F.struct(
                    s["section"].alias("section"),
                    s["section_start"].alias("section_start"),
                    _cut(s["section_text"], size, overlap).alias("cut"),
                ),
            ),
        )
        counts = F.transform("_s", lambda s: s["cut"]["n_win"])
        windows = _windows(F.col("_s.cut"), size, overlap)
    else:
        by = _windows_by(tokenizer, size, overlap)
        texts = F.transform("_s", lambda s: s["section_text"])
        cuts = titled.withColumn("_w", by(texts)).withColumn(
            "_s",
            F.zip_with(
                "_s",
                "_w",
                lambda s, w: F.struct(
                    s["section"].alias("section"), s["section_start"].alias("section_start"), w.alias("windows")
                ),
            ),
        )
        counts = F.transform("_s", lambda s: F.size(s["windows"]))
        windows = F.col("_s.windows")
    per_section = cuts.withColumn("_first", _running(counts)).select(
        *lead, "doc_title", "_first", F.posexplode_outer("_s").alias("_no", "_s")
    )
    per_window = per_section.select(
        *lead,
        "doc_title",
        F.col("_s.section").alias("section"),
        F.col("_s.section_start").alias("_from"),
        F.get("_first", F.col("_no")).alias("_first"),
        F.inline_outer(windows),
    ).where("window_no is not null")
    return per_window.withColumn("chunk_index", F.col("_first") + F.col("window_no")).select(
        chunk_key("source", "chunk_index").alias("chunk_id"),
        *lead,
        "doc_title",
        "section",
        "chunk_index",
        (F.col("_from") + F.col("text_start")).alias("char_start"),
        (F.col("_from") + F.col("text_start") + F.length("content")).alias("char_end"),
        "token_count",
        "content",
    )


def chunk_key(source: str, index: str) -> Column:
    """Deterministic chunk id."""
    return F.md5(F.concat_ws("|", F.col(source).cast("string"), F.col(index).cast("string")))


def chunk_stats(chunks: DataFrame, by: str | None = None) -> DataFrame:
    """Chunks and min, max, mean and median tokens, over all or per ``by``.

    Token counts take at most one value per window size, so the exact median's value counts are small.
    """
    grouped = chunks.groupBy(by) if by else chunks
    return grouped.agg(
        F.count("*").alias("n_chunks"),
        F.min("token_count").alias("min_tokens"),
        F.max("token_count").alias("max_tokens"),
        F.avg("token_count").alias("mean_tokens"),
        F.median("token_count").alias("median_tokens"),
    )


def oversized(chunks: DataFrame, size: int = CHUNK_SIZE) -> DataFrame:
    return chunks.where(F.col("token_count") > size)


def sample_chunks(chunks: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """The ``n`` chunks of least md5 of seed and id: the same ones for the same table, however it is partitioned.

    A task passes on its own ``n`` least only, so nothing is sorted as a whole.
    """
    return chunks.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("chunk_id").cast("string"))), "chunk_id").limit(n)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """Distinct documents and chunks per type.

    Chunks are first counted per document, so the second step sees one row per document. The sorted
    file list of a type is :func:`corpus_files`: a list of all sources in one cell would not scale.
    """
    per_doc = chunks.groupBy("doc_type", "source").agg(F.count("*").alias("_n"))
    return per_doc.groupBy("doc_type").agg(F.count("*").alias("n_docs"), F.sum("_n").alias("n_chunks"))


def corpus_files(chunks: DataFrame) -> DataFrame:
    """Distinct sources per type with their chunk counts, sorted."""
    return (
        chunks.groupBy("doc_type", "source").agg(F.count("*").alias("n_chunks")).orderBy("doc_type", "source")
    )


def chunk_overlap(chunks: DataFrame) -> DataFrame:
    """Characters each chunk shares with its neighbours in the same section.

    Every chunk is sent to its own place and to both places next to it, then folded per place. That
    is one shuffle of positions, computes the chunks once, and has no group larger than three rows
    however long a document is. A shared end never reaches into the shared start.
    """
    place = F.struct("section", "char_start", "char_end")
    sent = chunks.select(
        "source",
        F.explode(
            F.array(
                *[
                    F.struct(
                        (F.col("chunk_index") + step).alias("chunk_index"),
                        F.when(F.lit(step == 0), F.col("chunk_id")).alias("chunk_id"),
                        F.when(F.lit(step == 0), place).alias("own"),
                        F.when(F.lit(step == 1), place).alias("before"),
                        F.when(F.lit(step == -1), place).alias("after"),
                    )
                    for step in (0, 1, -1)
                ]
            )
        ).alias("x"),
    ).select("source", "x.*")
    met = sent.groupBy("source", "chunk_index").agg(
        *[F.max(c).alias(c) for c in ("chunk_id", "own", "before", "after")]
    )
    size = F.col("own.char_end") - F.col("own.char_start")

    def shared(side: str, chars) -> Column:
        same = F.col(f"{side}.section") == F.col("own.section")
        return F.when(same, F.least(size, F.greatest(chars, F.lit(0)))).otherwise(0)

    return (
        met.where("chunk_id is not null")
        .withColumn("shared_prefix", shared("before", F.col("before.char_end") - F.col("own.char_start")))
        .withColumn("_tail", shared("after", F.col("own.char_end") - F.col("after.char_start")))
        .select(
            "chunk_id",
            "source",
            "own.section",
            "chunk_index",
            "own.char_start",
            "own.char_end",
            "shared_prefix",
            F.least(F.col("_tail"), size - F.col("shared_prefix")).alias("shared_suffix"),
        )
    )
