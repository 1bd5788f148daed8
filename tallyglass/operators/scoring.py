"""Scoring of observed outputs against labels. Every scorer adds columns to a table of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.catalog import MEASURE_THRESHOLD, REVIEW_GATE
from tallyglass.operators.audit import LAYERS
from tallyglass.operators.gates import gate_measure

# Question categories and the rules their labels follow.
OUT_OF_SCOPE = ("sql_oos", "rag_oos")
SQL_CATEGORIES = ("sql_positive", "hybrid_positive", "sql_oos")
RAG_CATEGORIES = ("rag_positive", "hybrid_positive", "rag_oos")
ROUTES = ("sql", "rag", "hybrid")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def score_route(df: DataFrame, expected: str = "expected_route", actual: str = "actual_route") -> DataFrame:
    return df.withColumn("route_passed", F.col(expected).eqNullSafe(F.col(actual)))


def confusion(df: DataFrame, labels, expected: str = "expected_route", actual: str = "actual_route") -> DataFrame:
    """Expected x actual counts over declared ``labels``; pairs that never occur are 0.

    One conditional count per label, a single aggregation; labels without rows are added from the
    declared list, which is as small as the matrix.
    """
    counts = df.groupBy(F.col(expected).alias("expected")).agg(
        *[F.count_if(F.col(actual) == v).alias(f"actual_{v}") for v in labels]
    )
    spark = df.sparkSession
    kind = df.schema[expected].dataType.simpleString()
    rows = spark.createDataFrame([(v,) for v in labels], f"expected {kind}")
    return rows.join(counts, "expected", "left").na.fill(0, [f"actual_{v}" for v in labels])


def scope_of(category: Column | str) -> Column:
    return F.when(_col(category).isin(*OUT_OF_SCOPE), "out_of_scope").otherwise("in_scope")


def by_scope(scored: DataFrame, passed: str = "route_passed", category: str = "category") -> DataFrame:
    return scored.groupBy(scope_of(category).alias("scope")).agg(
        F.count_if(passed).alias("n_passed"), F.count("*").alias("n_total")
    )


def score_measure(df: DataFrame, expected: str = "expected_measure", actual: str = "selected_measure") -> DataFrame:
    """Equal or both null passes; null against null is a correct refusal."""
    e, a = F.col(expected), F.col(actual)
    detail = (
        F.when(e.isNull() & a.isNull(), "correct refusal (no measure for out-of-scope question)")
        .when(e.isNull(), F.concat(F.lit("hallucinated measure '"), a, F.lit("' for out-of-scope question")))
        .when(a.isNull(), "refused but a measure was expected")
        .when(e != a, "wrong measure")
        .otherwise("")
    )
    return df.withColumns({"measure_passed": e.eqNullSafe(a), "measure_detail": detail})


def glossary_leaves(refs: Column | str) -> Column:
    """Distinct parts after the last dot, sorted."""
    leaves = F.transform(_col(refs), lambda r: F.substring_index(r, ".", -1))
    return F.array_sort(F.array_distinct(F.coalesce(leaves, F.array().cast("array<string>"))))


def _listed(items: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(items, "', '"), F.lit("']"))


def score_glossary(df: DataFrame, expected: str = "expected_glossary", actual: str = "glossary_refs") -> DataFrame:
    """Set equality of leaves, with missing and extra ones named."""
    e, a = glossary_leaves(expected), glossary_leaves(actual)
    missing, extra = F.array_except(e, a), F.array_except(a, e)
    bits = F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("missing "), _listed(missing))),
            F.when(F.size(extra) > 0, F.concat(F.lit("extra "), _listed(extra))),
        )
    )
    return df.withColumns(
        {
            "glossary_missing": missing,
            "glossary_extra": extra,
            "glossary_passed": (F.size(missing) == 0) & (F.size(extra) == 0),
            "glossary_detail": F.array_join(bits, "; "),
        }
    )


def score_status(df: DataFrame, expected: str = "expected_status", actual: str = "actual_status") -> DataFrame:
    return df.withColumn("status_passed", F.col(expected).eqNullSafe(F.col(actual)))


def measure_eval(
    df: DataFrame, measure: str = "raw_measure", confidence: str = "raw_confidence", threshold: float = MEASURE_THRESHOLD
) -> DataFrame:
    """Gate, then score measure, status and glossary of every case.

    A refused pick counts as no measure and no glossary refs. Glossary is scored only where a measure
    was expected (null elsewhere).
    """
    gated = gate_measure(df, measure, confidence, threshold)
    accepted = F.col("accepted_measure").isNotNull()
    ready = gated.withColumns(
        {
            "selected_measure": F.col("accepted_measure"),
            "glossary_refs": F.when(accepted, F.col("glossary_refs")).otherwise(F.array().cast("array<string>")),
            "actual_status": F.when(accepted, "success").otherwise("no_measure_matched"),
            "expected_status": F.coalesce("expected_status", F.lit("success")),
        }
    )
    scored = score_glossary(score_status(score_measure(ready)))
    wanted = F.col("expected_measure").isNotNull()
    return scored.withColumns(
        {
            "glossary_passed": F.when(wanted, F.col("glossary_passed")),
            "glossary_detail": F.when(wanted, F.col("glossary_detail")),
        }
    )


def measure_eval_summary(scored: DataFrame) -> DataFrame:
    """One row with pass counts of the three sub-scores and the refusals made by the gate."""
    return scored.agg(
        F.count_if("measure_passed").alias("measure_passed"),
        F.count_if("status_passed").alias("status_passed"),
        F.count_if("glossary_passed").alias("glossary_passed"),
        F.count("glossary_passed").alias("glossary_total"),
        F.count("*").alias("n_total"),
        F.count_if("gated_out").alias("refusals_via_gate"),
    )


def dedupe_sources(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """First appearance of each source, ranked again without gaps: key, source, rank."""
    from pyspark.sql import Window

    # At most top_k sources per query reach the window.
    first = hits.groupBy(key, "source").agg(F.min("rank").alias("_first"))
    w = Window.partitionBy(key).orderBy("_first", "source")
    return first.select(key, "source", F.row_number().over(w).alias("rank"))


def score_retrieval(hits: DataFrame, expected: DataFrame, key: str = "query_id") -> DataFrame:
    """hit, rank of the first expected source and its reciprocal, for every query with expectations.

    ``hits``: key, source, rank. ``expected``: key, source (any of them counts).
    """
    wanted = expected.select(key, "source").distinct()
    first = hits.join(wanted, [key, "source"]).groupBy(key).agg(F.min("rank").alias("rank"))
    return (
        wanted.select(key)
        .distinct()
        .join(first, key, "left")
        .withColumns(
            {
                "hit": F.col("rank").isNotNull(),
                "reciprocal_rank": F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)),
            }
        )
    )


def retrieval_summary(scored: DataFrame) -> DataFrame:
    """One row: hit rate, mean reciprocal rank and number of queries; zeros when there is none."""
    return scored.agg(
        F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"),
        F.count("*").alias("n"),
    )


def score_hedge(
    df: DataFrame, expects: str = "expects_hedge", confidence: str = "confidence", gate: float = REVIEW_GATE
) -> DataFrame:
    """A hedge is predicted strictly below the gate."""
    predicted = F.col(confidence) < gate
    return df.withColumns({"predicted_hedge": predicted, "hedge_passed": predicted == F.col(expects)})


def hedge_eval(df: DataFrame, gate: float = REVIEW_GATE) -> DataFrame:
    """gate_fired: a revision happened or the final confidence is below the gate; recovered: a
    revision lifted it to the gate."""
    revised = F.col("revision_count") >= 1
    fired = revised | (F.col("confidence") < gate)
    return df.withColumns(
        {
            "gate_fired": fired,
            "hedge_passed": fired == F.col("expects_hedge"),
            "recovered": revised & (F.col("confidence") >= gate),
        }
    )


def hedge_summary(scored: DataFrame) -> DataFrame:
    hedge, ok = F.col("expects_hedge"), F.col("hedge_passed")
    return scored.agg(
        F.count_if(ok).alias("n_passed"),
        F.count("*").alias("n_total"),
        F.count_if(~hedge & ok).alias("resolving_pass"),
        F.count_if(~hedge).alias("resolving_total"),
        F.count_if(hedge & ok).alias("hedge_pass"),
        F.count_if(hedge).alias("hedge_total"),
        F.count_if("recovered").alias("recoveries"),
    )


def score_guardrail(audited: DataFrame, target: str = "target_layer", fragments: str = "reason_fragments") -> DataFrame:
    """A probe passes when it was rejected, by its target layer alone, for the named reasons."""
    blob = F.array_join("violations", " ")
    checks = [
        F.array(F.when(F.col("passed"), "guardrail did not reject")),
        F.array(
            *[
                F.when(
                    (F.col(target) == layer) & F.col(layer), f"target layer {layer} did not fail"
                )
                for layer in LAYERS
            ]
        ),
        F.array(
            *[
                F.when((F.col(target) != layer) & ~F.col(layer), f"non-target layer {layer} also failed (not isolated)")
                for layer in LAYERS
            ]
        ),
        F.transform(
            F.coalesce(F.col(fragments), F.array().cast("array<string>")),
            lambda f: F.when(~F.contains(blob, f), F.concat(F.lit("missing reason fragment '"), f, F.lit("'"))),
        ),
    ]
    failures = F.array_compact(F.concat(*checks))
    return audited.withColumn("_f", failures).withColumns(
        {
            "case_passed": F.size("_f") == 0,
            "expected": F.concat(F.lit("reject@"), F.col(target)),
            "actual": F.when(F.col("passed"), "passed").otherwise("rejected"),
            "detail": F.array_join("_f", "; "),
        }
    ).drop("_f")


def summarize(results: DataFrame, dimension: str = "dimension", passed: str = "passed") -> DataFrame:
    """Pass count, total and accuracy per dimension."""
    return (
        results.groupBy(dimension)
        .agg(F.count_if(passed).alias("n_passed"), F.count("*").alias("n_total"))
        .withColumn("accuracy", accuracy("n_passed", "n_total"))
    )


def accuracy(passed: Column | str, total: Column | str) -> Column:
    return F.coalesce(F.try_divide(_col(passed).cast("double"), _col(total)), F.lit(0.0))


def select_cases(cases: DataFrame, dimension: str, resolving: DataFrame | None = None) -> DataFrame:
    """Cases a dimension is scored on.

    ``hedge`` takes all unanswerable cases and the resolving ones whose ids ``resolving`` lists.
    """
    if dimension == "sql":
        return cases.where(F.col("category").isin(*SQL_CATEGORIES))
    if dimension == "rag":
        return cases.where(F.col("category").isin(*RAG_CATEGORIES))
    if dimension == "retrieval":
        return cases.where(F.size("expected_sources") > 0)
    if dimension == "hedge":
        hedge = cases.where(F.col("category") == "rag_oos")
        return cases.join(resolving.select("case_id").distinct(), "case_id", "left_semi").unionByName(hedge)
    raise ValueError(f"unknown dimension: {dimension!r}")


def check_labels(cases: DataFrame) -> DataFrame:
    """Adds ``label_errors``: rules of its category that a case's labels break."""
    cat = F.col("category")
    sources = F.coalesce(F.size("expected_sources"), F.lit(0))
    rules = [
        F.when((cat == "sql_oos") & F.col("expected_measure").isNotNull(), "sql_oos must not expect a measure"),
        F.when(
            (cat == "sql_oos") & (F.coalesce("expected_status", F.lit("")) != "no_measure_matched"),
            "sql_oos must expect no_measure_matched",
        ),
        F.when((cat == "rag_oos") & ~F.col("expects_hedge"), "rag_oos must expect a hedge"),
        F.when(cat.isin("sql_positive", "hybrid_positive") & F.col("expected_measure").isNull(), "must expect a measure"),
        F.when(cat.isin("rag_positive", "hybrid_positive") & (sources == 0), "must name an expected source"),
    ]
    return cases.withColumn("label_errors", F.array_compact(F.array(*rules)))


def reliability(runs: DataFrame, case: str = "case_id", fired: str = "fired") -> DataFrame:
    """Per case over its repeats: runs, share fired, spread of confidence, and whether it was stable."""
    f = F.col(fired).cast("int")
    return runs.groupBy(case).agg(
        F.count("*").alias("n_runs"),
        F.avg(f.cast("double")).alias("share_fired"),
        F.min("confidence").alias("min_confidence"),
        F.max("confidence").alias("max_confidence"),
        (F.min(f) == F.max(f)).alias("stable"),
    )
