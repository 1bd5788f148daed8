"""Row-local text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Words dropped before keyword scoring.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "between", "by", "did", "do",
    "does", "for", "from", "how", "in", "is", "it", "its", "mean", "means",
    "of", "on", "or", "that", "the", "this", "to", "what", "with",
)

PREVIEW_CHARS = 180


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def raw_tokens(text: Column | str) -> Column:
    """Lower-cased runs of ``a-z 0-9 _``; underscores hold identifiers together."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit("([a-z0-9_]+)"), F.lit(1))


def remove_stopwords(tokens: Column | str, stopwords=STOPWORDS) -> Column:
    # isin is one hash probe per token; the literal set is built once per task.
    return F.filter(_col(tokens), lambda t: ~t.isin(*stopwords))


def keyword_tokens(text: Column | str) -> Column:
    """Tokens used by keyword scoring: raw tokens without stopwords, repeats kept."""
    return remove_stopwords(raw_tokens(text))


def strip(text: Column | str) -> Column:
    """Cut white space of any kind from both ends."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column | str) -> Column:
    return strip(F.regexp_replace(_col(text), r"(?U)\s+", " "))


def preview(text: Column | str, width: int = PREVIEW_CHARS) -> Column:
    """White space collapsed, cut at ``width`` characters, dots appended when something was cut."""
    flat = collapse_space(text)
    return F.concat(F.substring(flat, 1, width), F.when(F.length(flat) > width, "...").otherwise(""))


def display_label(name: Column | str) -> Column:
    """``bed_bath_table`` -> ``Bed Bath Table``."""
    return F.initcap(F.translate(_col(name), "_", " "))
