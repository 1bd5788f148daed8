"""Decision gates over tables of model outputs. Row-local except the second retrieval pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.catalog import MEASURE_THRESHOLD, MEASURES, REVIEW_GATE

NO_MEASURE = "The model could not select a declared measure for this question."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_fences(text: Column | str) -> Column:
    """Text without an enclosing Markdown code fence."""
    t = F.regexp_replace(_col(text), r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(t, r"(?U)^```(?:json)?\s*", "")
    t = F.regexp_replace(t, r"(?U)\s*```$", "")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def parse_selections(df: DataFrame, text: str, measures=tuple(MEASURES)) -> DataFrame:
    """Model output text -> ``selection`` struct, null when it breaks the contract.

    Required: a declared measure, reasoning, and a confidence in [0, 1]. Refs and filters may be left
    out; where given, every value must be a string. Other fields are ignored. The text is read as a
    variant, which keeps the JSON types that a typed parse would silently convert.
    """
    fields = df.withColumn("_v", F.try_parse_json(strip_fences(text)))

    def get(name: str, kind: str) -> Column:
        return F.try_variant_get("_v", f"$.{name}", kind)

    def kind_of(value: Column) -> Column:
        return F.schema_of_variant(value)

    def strings(values: Column) -> Column:
        return F.coalesce(F.forall(values, lambda x: F.coalesce(kind_of(x) == "STRING", F.lit(False))), F.lit(False))

    def absent(name: str) -> Column:
        return get(name, "variant").isNull()

    fields = fields.withColumns(
        {
            "_refs": get("glossary_refs", "array<variant>"),
            "_filters": get("filters", "map<string,variant>"),
            "_confidence": get("confidence", "double"),
        }
    )
    ok = (
        (kind_of(get("measure", "variant")) == "STRING")
        & get("measure", "string").isin(*measures)
        & (kind_of(get("reasoning", "variant")) == "STRING")
        & F.col("_confidence").between(0.0, 1.0)
        & (absent("glossary_refs") | strings(F.col("_refs")))
        & (absent("filters") | strings(F.map_values("_filters")))
    )

    def as_string(x: Column) -> Column:
        return x.cast("string")

    clean = F.struct(
        get("measure", "string").alias("measure"),
        F.coalesce(F.transform("_refs", as_string), F.array().cast("array<string>")).alias("glossary_refs"),
        F.coalesce(
            F.transform_values("_filters", lambda _, x: as_string(x)), F.create_map().cast("map<string,string>")
        ).alias("filters"),
        get("reasoning", "string").alias("reasoning"),
        F.col("_confidence").alias("confidence"),
    )
    return fields.withColumn("selection", F.when(ok, clean)).drop("_v", "_refs", "_filters", "_confidence")


def gate_measure(
    df: DataFrame, measure: str, confidence: str, threshold: float = MEASURE_THRESHOLD
) -> DataFrame:
    """Refuse a selection below ``threshold`` (equal passes): flag, reason text and rejected measure."""
    picked = F.col(measure).isNotNull()
    low = picked & (F.col(confidence) < threshold)
    reason = F.when(~picked, F.lit(NO_MEASURE)).when(
        low,
        F.concat(
            F.lit("Closest measure '"),
            F.col(measure),
            F.lit("' was selected at confidence "),
            F.format_string("%.2f", F.col(confidence)),
            F.lit(
                f", below the {threshold} threshold. The question likely falls outside the governed measures."
            ),
        ),
    )
    return df.withColumns(
        {
            "gated_out": low,
            "accepted_measure": F.when(picked & ~low, F.col(measure)),
            "failure_reason": reason,
            "rejected_measure": F.when(low, F.col(measure)),
        }
    )


def status_ladder(
    accepted: Column | str, resolution_error: Column | str, guard_passed: Column | str, exec_error: Column | str
) -> Column:
    """Final status: the first stage that failed, else success."""
    return (
        F.when(_col(accepted).isNull(), "no_measure_matched")
        .when(_col(resolution_error).isNotNull(), "resolution_failed")
        .when(~F.coalesce(_col(guard_passed), F.lit(False)), "guardrail_violation")
        .when(_col(exec_error).isNotNull(), "execution_failed")
        .otherwise("success")
    )


def review_decision(
    grounded: Column | str,
    confidence: Column | str,
    revision_count: Column | str,
    revised_query: Column | str,
    gate: float = REVIEW_GATE,
) -> Column:
    """``end`` when approved, already revised once, or nothing to retry with; else ``revise``."""
    approved = _col(grounded) & (_col(confidence) >= gate)
    return (
        F.when(approved, "end")
        .when(_col(revision_count) >= 1, "end")
        .when(_col(revised_query).isNull(), "end")
        .otherwise("revise")
    )


def route_of(route: Column | str) -> Column:
    """Missing or empty route falls back to hybrid."""
    return F.coalesce(F.nullif(_col(route), F.lit("")), F.lit("hybrid"))


def apply_route(questions: DataFrame, route: str = "route") -> DataFrame:
    """Adds the effective route and which evidence it draws on."""
    r = route_of(route)
    return questions.withColumns(
        {"effective_route": r, "use_sql": r.isin("sql", "hybrid"), "use_rag": r.isin("rag", "hybrid")}
    )


def two_pass_retrieve(
    questions: DataFrame, hits: DataFrame, retrieve: Callable[[DataFrame], DataFrame], key: str = "query_id"
) -> tuple[DataFrame, DataFrame]:
    """One revised retrieval. Returns the questions with their new revision count and the hits.

    ``questions`` carries ``decision`` (see :func:`review_decision`), ``route``, ``revised_query``
    and ``revision_count``. Rows to revise with a revised query on a non-SQL route are retrieved again
    and their hits replace the old ones; other rows to revise only count up. An empty second
    result still replaces the first.
    """
    revise = F.col("decision") == "revise"
    again = revise & (route_of("route") != "sql") & (F.coalesce(F.length("revised_query"), F.lit(0)) > 0)
    redo = questions.where(again).select(key, F.col("revised_query").alias("text"))
    kept = hits.join(redo.select(key), key, "left_anti")
    merged = kept.unionByName(retrieve(redo).select(*hits.columns))
    counted = questions.withColumn(
        "revision_count", F.col("revision_count") + F.when(revise, 1).otherwise(0)
    )
    return counted, merged


def confidence_band(confidence: Column | str, gate: float = REVIEW_GATE) -> Column:
    c = F.coalesce(_col(confidence), F.lit(0.0))
    return F.when(c >= 0.85, "green").when(c >= gate, "orange").otherwise("red")


def revision_label(count: Column | str) -> Column:
    n = F.coalesce(_col(count), F.lit(0))
    return F.when(n == 1, "Self-corrected once").when(n > 1, F.concat(F.lit("Revised ×"), n.cast("string")))
