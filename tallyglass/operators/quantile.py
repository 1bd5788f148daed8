"""Exact quantiles without gathering the values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

ACCURACY = 10_000
POINTS = 512


def exact_quantile(df: DataFrame, metric: str, q: float, accuracy: int = ACCURACY, points: int = POINTS) -> Column:
    """Interpolated quantile ``q`` of ``metric`` as a scalar subquery.

    Narrowing goes by rank, never by distance, so the shape of the column does not matter. A sketch gives two values
    that surely enclose the wanted rank, with ``6 / accuracy`` of all rows at most strictly between them. A sketch of
    those cuts them at ``points`` even ranks. Rows are counted between the cuts, copies of the two values on their own,
    which names the one or two stretches that hold the rank; a stretch has at most ``1 / points + 2 / accuracy`` of the
    rows in between, besides copies of its upper cut. Only the distinct values of those stretches are put in order: some
    three millionths of all rows at the defaults; everything else is just a number.
    """
    vals = df.select(F.col(metric).cast("double").alias("v")).where("v is not null")
    slack = 2.0 / accuracy
    lo = F.percentile_approx("v", max(q - slack, 0.0), accuracy) if q > slack else F.min("v")
    hi = F.percentile_approx("v", min(q + slack, 1.0), accuracy) if q < 1 - slack else F.max("v")
    bounds = vals.agg(F.struct(lo.alias("lo"), hi.alias("hi"), F.count("*").alias("n")).alias("b")).scalar()

    low, high, n = (bounds.getField(x) for x in ("lo", "hi", "n"))
    pos = (n - 1) * F.lit(q)
    inside = vals.where((F.col("v") > low) & (F.col("v") < high))
    cuts = inside.agg(F.percentile_approx("v", [i / points for i in range(1, points)], accuracy)).scalar()
    bin_no = (
        F.when(F.col("v") < low, -1)
        .when(F.col("v") == low, 0)
        .when(F.col("v") == high, points + 1)
        .when(F.col("v") > high, points + 2)
        .otherwise(F.array_position(F.sort_array(F.array_append(cuts, F.col("v"))), F.col("v")))
    )
    binned = vals.withColumn("bin", bin_no)

    def reach(key: str) -> Column:
        return F.sum("c").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))

    counts = binned.groupBy("bin").agg(F.count("*").alias("c"), F.max(pos).alias("pos"))
    named = (
        counts.withColumn("upto", reach("bin"))
        .where(F.col("upto") > F.floor("pos"))
        .agg(
            F.struct(
                F.min("bin").alias("first"),
                F.min(F.when(F.col("upto") > F.ceil("pos"), F.col("bin"))).alias("last"),
                F.min_by(F.col("upto") - F.col("c"), "bin").alias("below"),
            ).alias("s")
        )
        .scalar()
    )
    values = (
        binned.where((F.col("bin") >= named.getField("first")) & (F.col("bin") <= named.getField("last")))
        .groupBy("v")
        .agg(F.count("*").alias("c"), F.max(pos).alias("pos"), F.max(named.getField("below")).alias("below"))
    )
    picked = values.withColumn("upto", F.col("below") + reach("v")).agg(
        F.min(F.when(F.col("upto") > F.floor("pos"), F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > F.ceil("pos"), F.col("v"))).alias("z"),
        F.max(F.col("pos") - F.floor("pos")).alias("w"),
    )
    return picked.select(F.col("a") + (F.col("z") - F.col("a")) * F.col("w")).scalar()


def below_median(df: DataFrame, metric: str) -> DataFrame:
    """Rows whose metric is below the median: the median first, then the filter."""
    return df.where(F.col(metric) < exact_quantile(df, metric, 0.5))


def top_quartile(df: DataFrame, metric: str) -> DataFrame:
    """Rows whose metric reaches the upper quartile."""
    return df.where(F.col(metric) >= exact_quantile(df, metric, 0.75))
