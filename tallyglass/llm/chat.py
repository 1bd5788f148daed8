"""Preference pairs from conversations: the shared opening once as prompt, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# How a turn is rendered, and what closes it.
OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def conversations(turns: DataFrame) -> DataFrame:
    """``conv_id`` and its turns (role and text) in the order of ``turn``, then role and text.

    Rows without ``conv_id`` belong to no conversation. A null turn comes first; null roles and texts are empty.
    """
    own = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    # array_sort puts null fields first inside a struct.
    grouped = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return grouped.selectExpr("conv_id", "transform(t, x -> named_struct('role', x.role, 'text', x.text)) AS turns")


def _render(turns: str) -> str:
    return f"array_join(transform({turns}, x -> concat('{OPEN}', x.role, '{MIDDLE}', x.text, '{CLOSE}')), '')"


def _mask(turns: str) -> Column:
    """Spans of the rendered turns that are trained on: text and close of turns of the trained role."""
    head, tail = len(OPEN) + len(MIDDLE), len(CLOSE)
    return F.expr(
        f"""aggregate({turns}, named_struct('at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<first: INT, stop: INT>>)),
        (st, x) -> named_struct(
            'at', st.at + {head + tail} + length(x.role) + length(x.text),
            'spans', if(x.role = '{TRAINED_ROLE}', concat(st.spans, array(named_struct(
                'first', st.at + {head} + length(x.role),
                'stop', st.at + {head + tail} + length(x.role) + length(x.text)))), st.spans)),
        st -> st.spans)"""
    )


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """Prompt, completions and loss masks of ``pair_id, chosen, rejected`` (arrays of role and text).

    The longest common prefix of turns is rendered once as ``prompt``; what follows on each side is its completion.
    Masks are spans of characters of the completion that are trained on: text and closing mark of assistant turns.
    ``usable`` tells whether both sides have such a span and differ. A null side has no turns. All pairs come out.
    """
    empty = "CAST(array() AS ARRAY<STRUCT<role: STRING, text: STRING>>)"
    both = pairs.selectExpr(
        "pair_id", f"coalesce(chosen, {empty}) AS c", f"coalesce(rejected, {empty}) AS r"
    ).selectExpr("pair_id", "c", "r", "least(size(c), size(r)) AS n")
    both = both.selectExpr(
        "pair_id", "c", "r", "n",
        "array_position(zip_with(slice(c, 1, n), slice(r, 1, n), (a, b) -> a.role <=> b.role AND a.text <=> b.text), false) AS miss",
    )
    both = both.selectExpr("pair_id", "c", "r", "CAST(if(miss = 0, n, miss - 1) AS INT) AS n_prompt_turns")
    cut = both.selectExpr(
        "pair_id", "n_prompt_turns", "slice(c, 1, n_prompt_turns) AS p",
        "slice(c, n_prompt_turns + 1, size(c)) AS c", "slice(r, n_prompt_turns + 1, size(r)) AS r",
    )
    out = cut.select(
        "pair_id", "n_prompt_turns",
        F.size("c").alias("n_chosen_turns"), F.size("r").alias("n_rejected_turns"),
        F.expr(_render("p")).alias("prompt"),
        F.expr(_render("c")).alias("chosen"), F.expr(_render("r")).alias("rejected"),
        _mask("c").alias("chosen_mask"), _mask("r").alias("rejected_mask"),
    )
    return out.withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))
