"""Shape of a result set and the chart that suits it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

MAX_BARS = 30


def column_kinds(df: DataFrame) -> dict[str, str]:
    """numeric / datetime / categorical from the schema and the column name."""
    kinds = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.NumericType):
            kinds[f.name] = "numeric"
        elif "date" in f.name.lower():
            kinds[f.name] = "datetime"
        else:
            kinds[f.name] = "categorical"
    return kinds


def profile_result(df: DataFrame) -> DataFrame:
    """One row per column: kind, whether it holds any value, distinct values, and the chart.

    A numeric column without a single value is categorical. One numeric with one categorical of
    fewer than 30 values is a bar chart, one numeric with one datetime a line, anything else a
    table. Distinct counts are read for non-numeric columns only.
    """
    kinds = column_kinds(df)
    aggs = []
    for i, (c, kind) in enumerate(kinds.items()):
        aggs.append(F.count(F.col(c)).alias(f"n{i}"))
        if kind != "numeric":
            aggs.append(F.count_distinct(F.col(c)).alias(f"d{i}"))
    one = df.agg(F.count("*").alias("n"), *aggs)
    cols = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column_name"),
                F.when((F.lit(kind) == "numeric") & (F.col(f"n{i}") == 0), _dated(c)).otherwise(F.lit(kind)).alias("kind"),
                (F.lit(None).cast("bigint") if kind == "numeric" else F.col(f"d{i}")).alias("n_distinct"),
            )
            for i, (c, kind) in enumerate(kinds.items())
        ]
    )
    prof = one.select("n", cols.alias("cols"))

    def only(kind):
        return F.filter("cols", lambda x: x["kind"] == kind)

    chart = (
        F.when(F.col("n") == 0, "empty")
        .when(
            (F.size(only("numeric")) == 1)
            & (F.size(only("categorical")) == 1)
            & (F.coalesce(F.get(only("categorical"), F.lit(0))["n_distinct"], F.lit(0)) < MAX_BARS),
            "bar",
        )
        .when((F.size(only("numeric")) == 1) & (F.size(only("datetime")) == 1), "line")
        .otherwise("table")
    )
    return prof.withColumn("chart", chart).select(F.inline("cols"), "chart")


def _dated(name: str):
    return F.lit("datetime" if "date" in name.lower() else "categorical")
