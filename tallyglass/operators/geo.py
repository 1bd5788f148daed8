"""Lookup building: modal label and mean coordinates per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyglass.operators.latest import top_per_key


def modal_label(df: DataFrame, key: str, label_cols: list[str]) -> DataFrame:
    """Most frequent combination of ``label_cols`` per key; ties go to the smallest labels."""
    freq = df.groupBy(key, *label_cols).agg(F.count("*").alias("freq"))
    order = [F.col("freq").desc(), *[F.col(c).asc_nulls_last() for c in label_cols]]
    return top_per_key(freq, [key], order, 1, "_rn").drop("_rn")


def centroid(df: DataFrame, key: str, lat: str, lng: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"))


def build_geo_lookup(
    raw: DataFrame,
    key: str = "geolocation_zip_code_prefix",
    lat: str = "geolocation_lat",
    lng: str = "geolocation_lng",
    city: str = "geolocation_city",
    state: str = "geolocation_state",
) -> DataFrame:
    """One row per zip prefix: mean coordinates and the most common (city, state) pair."""
    labels = modal_label(raw, key, [city, state]).select(
        F.col(key).alias("zip_prefix"), F.col(city).alias("city"), F.col(state).alias("state")
    )
    coords = centroid(raw, key, lat, lng).withColumnRenamed(key, "zip_prefix")
    return coords.join(labels, "zip_prefix").select("zip_prefix", "lat", "lng", "city", "state")


def reconcile(raw: DataFrame, lookup: DataFrame, raw_key: str) -> DataFrame:
    """One row: raw rows, distinct raw keys, lookup rows, and whether the lookup is complete."""
    per_key = raw.groupBy(raw_key).agg(F.count("*").alias("_n"))
    counts = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_rows"), F.count(raw_key).alias("distinct_keys")
    )
    n_lookup = lookup.agg(F.count("*").alias("n")).scalar()
    return counts.withColumn("lookup_rows", n_lookup).withColumn(
        "ok", F.col("distinct_keys") == F.col("lookup_rows")
    )


def sample_head(lookup: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` lookup rows by key, coordinates rounded for reading."""
    return (
        lookup.select(
            "zip_prefix", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"), "city", "state"
        )
        .orderBy("zip_prefix")
        .limit(n)
    )
