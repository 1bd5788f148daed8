"""Removal of repeated lines by overlapping windows of three lines, in built-in functions only.

Each text lists the hashes of its windows of three consecutive lines. The first window of a hash in the order of
(``doc_id``, place) stays; lines that any later one covers go. Covered places are merged by cutting the text between
the starts of windows, in one pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.llm.store import written

# `transform` over one element binds a value once; the optimizer would write a projected one out at each use.
_LINES = r"transform(split(text, '\n', -1), x -> named_struct('a', xxhash64(x), 'b', xxhash64(17L, x), 'w', length(btrim(x, ' \t\n\u000b\f\r')) > 0))"
_WINDOWS = f"""
transform(array({_LINES}), ls -> if(size(ls) < 3, array(), filter(
    transform(sequence(0, size(ls) - 3), i -> named_struct(
        'place', i,
        'key_a', xxhash64(ls[i].a, ls[i + 1].a, ls[i + 2].a),
        'key_b', xxhash64(ls[i + 2].b, ls[i + 1].b, ls[i].b),
        'worded', ls[i].w OR ls[i + 1].w OR ls[i + 2].w)),
    w -> w.worded)))[0]
"""
# What lies between the windows: from the end of one to the start of the next.
_KEPT = r"""
transform(array(split(text, '\n', -1)), ls -> flatten(transform(sequence(0, size(starts)), k ->
    slice(ls, if(k = 0, 0, starts[k - 1] + 3) + 1,
          greatest(if(k = size(starts), size(ls), starts[k]) - if(k = 0, 0, starts[k - 1] + 3), 0)))))[0]
"""


def remove_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its repeated lines, and ``n_lines`` and ``n_removed`` (long).

    Lines end at a line feed. A window is three consecutive lines of a text, at least one of them with a character
    other than space and 0x09-0x0D; of equal windows the one of the least (``doc_id``, place) stays. Kept lines are
    joined by line feeds; a text that loses all becomes empty. A null text stays null and has no lines. Rows without
    ``doc_id`` come before all ids. Rows with equal id and text are one text: none of them is later than another.
    All columns are kept; columns called ``n_lines`` or ``n_removed`` are replaced.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce("row.text", F.lit(""))
    own = row.select("row", F.col("row.doc_id").cast("long").alias("id"), F.xxhash64(text).alias("mark"))
    windows = own.select("id", "mark", text.alias("text")).selectExpr("id", "mark", f"inline({_WINDOWS})").drop("worded")
    keys = ["key_a", "key_b"]
    first = windows.groupBy(keys).agg(F.min(F.struct("id", "mark", "place")).alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select(*keys, "first"), "windows")
    later = windows.join(first, keys).where(F.struct("id", "mark", "place") > F.col("first"))
    # A text's own windows meet here: as many as it has lines at most.
    starts = later.groupBy(F.col("id").alias("_id"), F.col("mark").alias("_mark")).agg(
        F.array_sort(F.collect_set("place")).alias("starts")
    )
    starts = written(starts, "starts")
    # A sorted merge at every size: the list of starts grows with the texts.
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    joined = own.join(starts.hint("merge"), same, "left").select("row", text.alias("text"), "starts")
    kept = joined.selectExpr("row", "text", "starts", f"if(starts IS NULL, NULL, {_KEPT}) AS kept")
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    new_text = F.when(F.col("starts").isNull(), F.col("row.text")).otherwise(F.array_join("kept", "\n"))
    removed = F.when(F.col("starts").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)) - F.size("kept")).cast("long")
    others = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return kept.select(
        *(new_text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in others),
        n_lines.alias("n_lines"), removed.alias("n_removed"),
    )
