"""Evidence per question: SQL rows and retrieved passages merged, rendered and checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.catalog import MAX_ROWS

TOP_PASSAGES = 5


def sql_evidence(
    results: DataFrame, rows: DataFrame, key: str = "question_id", max_rows: int = MAX_ROWS
) -> DataFrame:
    """One row per question with its delivered result lines in order.

    ``results``: key, measure, status, failure_reason, header. ``rows``: key, row_no, line. ``max_rows``
    is the row limit of the governed request: it bounds each question's lines before they are gathered.
    """
    lines = (
        rows.where(F.col("row_no") <= max_rows)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("_l"))
        .select(key, F.transform("_l", lambda x: x["line"]).alias("lines"))
    )
    return results.join(lines, key, "left").withColumn(
        "lines", F.coalesce("lines", F.array().cast("array<string>"))
    )


def passage_evidence(hits: DataFrame, key: str = "question_id", top: int = TOP_PASSAGES) -> DataFrame:
    """One row per question with its first ``top`` passages in rank order."""
    return (
        hits.where(F.col("rank") <= top)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "source", "section", "content"))).alias("passages"))
    )


def merge_evidence(sql_rows: DataFrame, passages: DataFrame, key: str = "question_id") -> DataFrame:
    """Full outer join of both kinds; errors of both sides are kept, SQL first."""
    empty = F.array().cast("array<string>")
    left = sql_rows.withColumnRenamed("errors", "_sql_errors")
    right = passages.withColumnRenamed("errors", "_rag_errors")
    return left.join(right, key, "full").withColumn(
        "errors", F.concat(F.coalesce("_sql_errors", empty), F.coalesce("_rag_errors", empty))
    ).drop("_sql_errors", "_rag_errors")


def collect_sources(evidence: DataFrame) -> DataFrame:
    """Adds ``sources_used`` (measure first, then sources in rank order), ``has_sql``, ``has_rag``."""
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    srcs = F.coalesce(F.transform("passages", lambda p: p["source"]), F.array().cast("array<string>"))
    srcs = F.filter(srcs, lambda s: F.coalesce(s, F.lit("")) != "")
    lead = F.when(ok, F.array("measure")).otherwise(F.array().cast("array<string>"))
    return evidence.withColumns(
        {
            "sources_used": F.array_distinct(F.concat(lead, srcs)),
            "has_sql": ok & (F.coalesce(F.size("lines"), F.lit(0)) > 0),
            "has_rag": F.coalesce(F.size("passages"), F.lit(0)) > 0,
        }
    )


def render_context(evidence: DataFrame, out: str = "context") -> DataFrame:
    """The text block an external model reads: result lines or the failure, then the passages."""
    nl, gap = F.lit("\n"), F.lit("\n\n")
    ok = F.coalesce(F.col("status") == "success", F.lit(False))
    n = F.coalesce(F.size("lines"), F.lit(0)).cast("string")
    sql_block = (
        F.when(
            F.col("status").isNull(),
            F.lit("SQL result: none (no database query was run for this question)."),
        )
        .when(
            ok,
            F.concat(
                F.lit("SQL result from the "), F.col("measure"), F.lit(" measure ("), n, F.lit(" rows):\n"),
                F.array_join(F.concat(F.array("header"), F.col("lines")), "\n"),
            ),
        )
        .otherwise(
            F.concat(
                F.lit("SQL result: could not be computed (status="), F.col("status"), F.lit("). Reason: "),
                F.coalesce("failure_reason", F.lit("unknown error")),
            )
        )
    )
    blocks = F.transform(
        "passages",
        lambda p, i: F.concat(
            F.lit("\n["), (i + 1).cast("string"), F.lit("] source: "), F.coalesce(p["source"], F.lit("None")),
            F.lit(" | section: "), F.coalesce(p["section"], F.lit("None")), nl, p["content"],
        ),
    )
    rag_block = F.when(
        F.coalesce(F.size("passages"), F.lit(0)) > 0,
        F.concat(F.lit("Document excerpts (most relevant first):\n"), F.array_join(blocks, "\n")),
    ).otherwise(F.lit("Document excerpts: none retrieved."))
    return evidence.withColumn(out, F.concat(sql_block, gap, rag_block))


def numbers_in(text: Column | str) -> Column:
    """Figures in a text, thousands separators removed and trailing zeros of decimals dropped."""
    col = F.col(text) if isinstance(text, str) else text
    raw = F.regexp_extract_all(col, F.lit(r"(\d[\d,]*(?:\.\d+)?)"), F.lit(1))
    plain = F.transform(raw, lambda x: F.regexp_replace(x, ",", ""))
    return F.array_distinct(
        F.transform(
            plain,
            lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x),
        )
    )


def grounding_audit(
    df: DataFrame, answer: str, evidence: str, tokens: str | None = None
) -> DataFrame:
    """Figures, and optionally category tokens, of ``answer`` that its evidence does not hold.

    ``tokens`` is an array column of governed category names; a name counts as used when it stands in
    the answer as a whole word.
    """
    out = df.withColumn(
        "ungrounded_numbers", F.array_except(numbers_in(answer), numbers_in(evidence))
    )
    if tokens is None:
        out = out.withColumn("ungrounded_tokens", F.array().cast("array<string>"))
    else:
        # Splitting on non-word signs makes set membership a whole-word match.
        def words(c):
            return F.split(F.lower(F.col(c)), r"[^a-z0-9_]+")

        used = F.array_intersect(F.transform(tokens, lambda t: F.lower(t)), words(answer))
        out = out.withColumn("ungrounded_tokens", F.array_except(used, words(evidence)))
    return out.withColumn(
        "grounded", (F.size("ungrounded_numbers") == 0) & (F.size("ungrounded_tokens") == 0)
    )
