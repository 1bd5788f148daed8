"""Query recipes documented for the star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyglass.functions.money import cents, from_cents
from tallyglass.functions.text import display_label

Model = dict[str, DataFrame]

# Category -> cluster.
CLUSTERS = {
    "electronics": "tech", "computers_accessories": "tech", "telephony": "tech",
    "furniture_decor": "home", "home_comfort": "home", "housewares": "home",
    "health_beauty": "personal_care", "perfumery": "personal_care", "baby": "personal_care",
    "sports_leisure": "leisure", "toys": "leisure", "watches_gifts": "leisure",
}
EARTH_KM = 6371.0


def repeat_customers(model: Model) -> DataFrame:
    """Orders, distinct humans, and the share of humans with more than one order.

    An order's own customer id is new for every order, so the human comes from the customer row.
    Orders are counted per id first, which costs no shuffle of its own.
    """
    per_id = model["fact_orders"].where("customer_id is not null").groupBy("customer_id").agg(F.count("*").alias("_orders"))
    per_human = (
        per_id.join(model["dim_customers"].select("customer_id", "customer_unique_id"), "customer_id")
        .groupBy("customer_unique_id")
        .agg(F.sum("_orders").alias("_orders"))
    )
    return per_human.agg(
        F.sum("_orders").alias("n_orders"),
        F.count("*").alias("n_customers"),
        F.count_if(F.col("_orders") > 1).alias("n_repeat"),
        F.try_divide(F.count_if(F.col("_orders") > 1).cast("double"), F.count("*")).alias("repeat_rate"),
    )


def revenue_with_untranslated(model: Model) -> DataFrame:
    """Revenue per category; categories without a translation keep their own name."""
    per_product = model["fact_order_items"].groupBy("product_id").agg(F.sum(cents("price")).alias("_cents"))
    return (
        per_product.join(model["dim_products"].select("product_id", "product_category_name"), "product_id")
        .groupBy("product_category_name")
        .agg(F.sum("_cents").alias("_cents"))
        .join(model["dim_category_translation"], "product_category_name", "left")
        .groupBy(F.coalesce("product_category_name_english", "product_category_name").alias("category"))
        .agg(from_cents(F.sum("_cents")).alias("revenue"))
    )


def review_buckets(model: Model) -> DataFrame:
    """Orders per review score, orders without a review as their own bucket.

    Reviews are counted per order and score before the join, so no order brings more rows than there are scores.
    """
    reviews = model["fact_order_reviews"].groupBy("order_id", "review_score").agg(F.count("*").alias("_n"))
    return (
        model["fact_orders"].select("order_id")
        .join(reviews, "order_id", "left")
        .groupBy(F.when(F.col("review_score").isNull(), "unreviewed").otherwise(F.col("review_score").cast("string")).alias("bucket"))
        .agg(F.sum(F.coalesce("_n", F.lit(1))).alias("n_orders"))
    )


def delivery_latency(orders: DataFrame) -> DataFrame:
    """Per state of delivery: orders and mean days from purchase to delivery."""
    start, done, due = (
        F.col(c).cast("timestamp_ntz")
        for c in ("order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date")
    )
    timing = F.when(done.isNull(), "undelivered").when(done <= due, "on_time").otherwise("late")
    days = F.timestamp_diff("SECOND", start, done) / F.lit(86400)
    return orders.groupBy(timing.alias("delivery")).agg(
        F.count("*").alias("n_orders"), F.avg(days).alias("mean_days"), F.max(days).alias("max_days")
    )


def status_shares(orders: DataFrame) -> DataFrame:
    """Orders and share per status; the share is taken over the few aggregated rows."""
    counts = orders.groupBy("order_status").agg(F.count("*").alias("n_orders"))
    total = F.sum("n_orders").over(Window.partitionBy())
    return counts.withColumn("share", F.col("n_orders").cast("double") / total)


def delivered_only(orders: DataFrame, status: str = "delivered") -> DataFrame:
    return orders.where(F.col("order_status") == status)


def unlocated(df: DataFrame, zip_col: str, lookup: DataFrame) -> DataFrame:
    """Rows whose zip prefix has no lookup entry (a null prefix has none)."""
    return df.join(lookup.select(F.col("zip_prefix").alias(zip_col)), zip_col, "left_anti")


def geo_coverage(df: DataFrame, zip_col: str, lookup: DataFrame) -> DataFrame:
    """One row: rows, located rows, share located. Counts per prefix meet the lookup, not the rows."""
    per_zip = df.groupBy(zip_col).agg(F.count("*").alias("_n"))
    known = lookup.select(F.col("zip_prefix").alias(zip_col), F.lit(True).alias("_known")).distinct()
    return per_zip.join(known, zip_col, "left").agg(
        F.sum("_n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).alias("n_located"),
        F.try_divide(
            F.coalesce(F.sum(F.when(F.col("_known"), F.col("_n"))), F.lit(0)).cast("double"), F.sum("_n")
        ).alias("share_located"),
    )


def category_labels(translation: DataFrame) -> DataFrame:
    return translation.select(
        "product_category_name", display_label("product_category_name_english").alias("label")
    )


def payment_mix(payments: DataFrame) -> DataFrame:
    """Per method: payments, value, share of all value, mean instalments."""
    per = payments.groupBy("payment_type").agg(
        F.count("*").alias("n_payments"),
        F.sum(cents("payment_value")).alias("_cents"),
        F.avg("payment_installments").alias("mean_installments"),
    )
    total = F.sum("_cents").over(Window.partitionBy())
    return per.select(
        "payment_type",
        "n_payments",
        from_cents("_cents").alias("value"),
        F.try_divide(F.col("_cents").cast("double"), total).alias("value_share"),
        "mean_installments",
    )


def installment_distribution(payments: DataFrame) -> DataFrame:
    return payments.groupBy("payment_installments").agg(F.count("*").alias("n_payments"))


def order_spend(items: DataFrame) -> DataFrame:
    """One row: orders, items, items per order, product value, freight and total spend per order."""
    per_order = items.groupBy("order_id").agg(
        F.count("*").alias("_items"), F.sum(cents("price")).alias("_p"), F.sum(cents("freight_value")).alias("_f")
    )
    return per_order.agg(
        F.count("*").alias("n_orders"),
        F.sum("_items").alias("n_items"),
        (F.sum("_items").cast("double") / F.count("*")).alias("items_per_order"),
        from_cents(F.sum("_p")).alias("revenue"),
        from_cents(F.sum("_p") + F.sum("_f")).alias("total_spend"),
        F.max("_items").alias("max_items"),
    )


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def shipping_routes(model: Model, lookup: DataFrame) -> DataFrame:
    """Per customer state: items, items from a seller in another state, mean distance.

    Items shrink to counts per (order, seller) before they meet the dimensions, then to counts per pair
    of zip prefixes, so a distance is computed once per pair of places.
    """
    pairs = model["fact_order_items"].groupBy("order_id", "seller_id").agg(F.count("*").alias("_n"))
    lanes = (
        pairs.join(model["fact_orders"].select("order_id", "customer_id"), "order_id")
        .join(model["dim_customers"].select("customer_id", "customer_state", F.col("customer_zip_code_prefix").alias("_cz")), "customer_id")
        .join(model["dim_sellers"].select("seller_id", "seller_state", F.col("seller_zip_code_prefix").alias("_sz")), "seller_id")
        .groupBy("customer_state", "seller_state", "_cz", "_sz")
        .agg(F.sum("_n").alias("_n"))
    )

    def place(zip_col, lat, lng):
        return lookup.select(F.col("zip_prefix").alias(zip_col), F.col("lat").alias(lat), F.col("lng").alias(lng))

    km = haversine_km(F.col("_clat"), F.col("_clng"), F.col("_slat"), F.col("_slng"))
    located = lanes.join(place("_cz", "_clat", "_clng"), "_cz", "left").join(place("_sz", "_slat", "_slng"), "_sz", "left").withColumn("_km", km)
    known = F.when(F.col("_km").isNotNull(), F.col("_n"))
    return located.groupBy("customer_state").agg(
        F.sum("_n").alias("n_items"),
        F.coalesce(F.sum(F.when(F.col("customer_state") != F.col("seller_state"), F.col("_n"))), F.lit(0)).alias("n_cross_state"),
        F.try_divide(F.sum(F.col("_km") * F.col("_n")), F.sum(known)).alias("mean_km"),
    )


def revenue_by_cluster(category_revenue: DataFrame, clusters: dict[str, str] = CLUSTERS) -> DataFrame:
    """Category revenue rolled up to clusters; categories of no cluster are left out of the report."""
    lookup = F.create_map(*[F.lit(x) for pair in clusters.items() for x in pair])
    return (
        category_revenue.withColumn("cluster", F.try_element_at(lookup, F.col("category")))
        .where("cluster is not null")
        .groupBy("cluster")
        .agg(from_cents(F.sum(cents("revenue"))).alias("revenue"), F.count("*").alias("n_categories"))
    )


def seasonality(model: Model) -> DataFrame:
    """Per category and month of purchase: items, revenue, and the month's rank in both."""
    lines = (
        model["fact_order_items"].select("order_id", "product_id", "price")
        .join(
            model["fact_orders"].select("order_id", F.date_trunc("month", "order_purchase_timestamp").alias("_m")),
            "order_id",
        )
        .groupBy("product_id", "_m")
        .agg(F.count("*").alias("_n"), F.sum(cents("price")).alias("_c"))
        .join(model["dim_products"].select("product_id", "product_category_name"), "product_id")
        .join(model["dim_category_translation"], "product_category_name")
        .groupBy(F.col("product_category_name_english").alias("category"), F.date_format("_m", "yyyy-MM").alias("month"))
        .agg(F.sum("_n").alias("n_items"), F.sum("_c").alias("_c"))
    )
    w = Window.partitionBy("category")
    return lines.select(
        "category",
        "month",
        "n_items",
        from_cents("_c").alias("revenue"),
        F.row_number().over(w.orderBy(F.desc("n_items"), "month")).alias("items_rank"),
        F.row_number().over(w.orderBy(F.desc("_c"), "month")).alias("revenue_rank"),
    )
