"""The evaluation scorecard as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.functions.once import pinned
from tallyglass.operators import scoring


def pct(passed: Column, total: Column) -> Column:
    """``p/t (x%)``, or n/a for an empty dimension. The share rounds half to even."""
    share = F.bround(F.try_divide(passed.cast("double") * 100, total), 0).cast("bigint").cast("string")
    return F.when(total == 0, "n/a").otherwise(
        F.concat(passed.cast("string"), F.lit("/"), total.cast("string"), F.lit(" ("), share, F.lit("%)"))
    )


def score_line(summary: DataFrame, order: int, name: str, passed: str, total: str, notes: Column | None = None) -> DataFrame:
    """One line of the scorecard from a one-row summary."""
    return summary.select(
        F.lit(order).alias("line"),
        F.lit(name).alias("dimension"),
        pct(F.col(passed), F.col(total)).alias("score"),
        (notes if notes is not None else F.lit("")).alias("notes"),
    )


def scorecard(lines: list[DataFrame]) -> DataFrame:
    """All lines as one table in report order."""
    out = lines[0]
    for other in lines[1:]:
        out = out.unionByName(other)
    return out.orderBy("line")


def governance_lines(
    routed: DataFrame, measured: DataFrame, probes: DataFrame, found: DataFrame, hedged: DataFrame, top_k: int
) -> list[DataFrame]:
    """The seven lines of the governance scorecard from the scored cases of its five dimensions.

    ``routed``: ``score_route``. ``measured``: ``measure_eval``. ``probes``: ``score_guardrail``. ``found``:
    ``score_retrieval`` over the first ``top_k`` hits. ``hedged``: ``hedge_eval``.
    """
    route = routed.agg(F.count_if("route_passed").alias("p"), F.count("*").alias("n"))
    outside = F.col("category").isin(*scoring.OUT_OF_SCOPE)
    oos = routed.agg(pct(F.count_if(outside & F.col("route_passed")), F.count_if(outside))).scalar()
    sql = scoring.measure_eval_summary(measured)
    probe = probes.agg(F.count_if("case_passed").alias("p"), F.count("*").alias("n"))
    hit = found.agg(
        F.count_if("hit").alias("p"), F.count("*").alias("n"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr")
    )
    mrr = F.format_string("MRR %.3f", F.bround(F.round("mrr", 9), 3))
    hedge = scoring.hedge_summary(hedged)
    parts = F.concat(
        F.lit("resolving "), pct(F.col("resolving_pass"), F.col("resolving_total")),
        F.lit(", hedge "), pct(F.col("hedge_pass"), F.col("hedge_total")),
    )
    refused = F.concat(F.col("refusals_via_gate").cast("string"), F.lit(" refused via confidence gate"))
    return [
        score_line(route, 1, "Routing accuracy", "p", "n", F.concat(F.lit("out-of-scope "), oos)),
        score_line(sql, 2, "Measure selection", "measure_passed", "n_total", refused),
        score_line(
            sql, 3, "Trust boundary (refuse/proceed)", "status_passed", "n_total",
            F.lit(f"gate threshold {scoring.MEASURE_THRESHOLD}"),
        ),
        score_line(sql, 4, "Glossary resolution", "glossary_passed", "glossary_total"),
        score_line(probe, 5, "Guardrail efficacy", "p", "n", F.lit("every layer isolated")),
        score_line(hit, 6, f"Retrieval hit@{top_k}", "p", "n", mrr),
        score_line(hedge, 7, "Hedge calibration", "n_passed", "n_total", parts),
    ]


def measure_misses(measured: DataFrame, dimension: str = "measure_selection", key: str = "case_id") -> DataFrame:
    """Cases that fail by measure, by status, or by glossary where that was scored."""
    good = F.col("measure_passed") & F.col("status_passed") & F.coalesce("glossary_passed", F.lit(True))
    none = F.lit("None")
    return misses(
        measured.withColumn("_good", good), "_good", dimension, key,
        F.coalesce("expected_measure", none), F.coalesce("selected_measure", none),
    )


def retrieval_misses(
    found: DataFrame, ranked: DataFrame, expected: DataFrame, dimension: str = "retrieval", key: str = "query_id"
) -> DataFrame:
    """Queries without an expected source: the sources expected, by name, and those retrieved, by rank.

    ``ranked`` holds at most ``top_k`` sources a query; only those of missed queries are gathered.
    """
    lost = found.where("not hit").select(key)
    want = expected.join(lost, key).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("_want"))
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "source")))
    got = ranked.join(lost, key).groupBy(key).agg(F.array_join(by_rank["source"], ",").alias("_got"))
    return misses(
        want.join(got, key, "left").withColumn("_hit", F.lit(False)), "_hit", dimension, key,
        F.col("_want"), F.coalesce("_got", F.lit("")),
    )


def misses(scored: DataFrame, passed: str, dimension: str, key: str, expected: Column, actual: Column) -> DataFrame:
    """Failed cases of one dimension with what was expected and what came.

    The verdict is pinned: its filter would repeat the rules behind it for each of their mentions.
    """
    return pinned(scored, _lost=~F.coalesce(F.col(passed), F.lit(True))).where("_lost").select(
        F.lit(dimension).alias("dimension"),
        F.col(key).cast("string").alias("case_id"),
        expected.cast("string").alias("expected"),
        actual.cast("string").alias("actual"),
    )


def render_markdown(card: DataFrame) -> DataFrame:
    """One text row per scorecard line, ready for ``write.text``."""
    return card.orderBy("line").select(
        F.format_string("| %s | %s | %s |", "dimension", "score", "notes").alias("value")
    )
