"""Raw tables to the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyglass.operators.keys import check_fk, check_pk
from tallyglass.operators.latest import latest_per_key

# Schemas of the landed tables, keys and references of the model.
RAW_SCHEMAS = {
    "customers": "customer_id string, customer_unique_id string, customer_zip_code_prefix bigint, "
    "customer_city string, customer_state string",
    "sellers": "seller_id string, seller_zip_code_prefix bigint, seller_city string, seller_state string",
    "products": "product_id string, product_category_name string, product_name_lenght double, "
    "product_description_lenght double, product_photos_qty double, product_weight_g double, "
    "product_length_cm double, product_height_cm double, product_width_cm double",
    "category_translation": "product_category_name string, product_category_name_english string",
    "geolocation": "geolocation_zip_code_prefix bigint, geolocation_lat double, geolocation_lng double, "
    "geolocation_city string, geolocation_state string",
    "orders": "order_id string, customer_id string, order_status string, order_purchase_timestamp string, "
    "order_approved_at string, order_delivered_carrier_date string, "
    "order_delivered_customer_date string, order_estimated_delivery_date string",
    "order_items": "order_id string, order_item_id bigint, product_id string, seller_id string, "
    "shipping_limit_date string, price double, freight_value double",
    "order_payments": "order_id string, payment_sequential bigint, payment_type string, "
    "payment_installments bigint, payment_value double",
    "order_reviews": "review_id string, order_id string, review_score bigint, review_comment_title string, "
    "review_comment_message string, review_creation_date string, review_answer_timestamp string",
}
PRIMARY_KEYS = {
    "dim_customers": ["customer_id"],
    "dim_sellers": ["seller_id"],
    "dim_products": ["product_id"],
    "dim_category_translation": ["product_category_name"],
    "fact_orders": ["order_id"],
    "fact_order_items": ["order_id", "order_item_id"],
    "fact_order_payments": ["order_id", "payment_sequential"],
    "fact_order_reviews": ["review_id"],
}
# (name, child, child columns, parent, parent columns)
FOREIGN_KEYS = [
    ("fk_orders_customer", "fact_orders", ["customer_id"], "dim_customers", ["customer_id"]),
    ("fk_items_order", "fact_order_items", ["order_id"], "fact_orders", ["order_id"]),
    ("fk_items_product", "fact_order_items", ["product_id"], "dim_products", ["product_id"]),
    ("fk_items_seller", "fact_order_items", ["seller_id"], "dim_sellers", ["seller_id"]),
    ("fk_payments_order", "fact_order_payments", ["order_id"], "fact_orders", ["order_id"]),
    ("fk_reviews_order", "fact_order_reviews", ["order_id"], "fact_orders", ["order_id"]),
]
ORDER_TIMES = (
    "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
    "order_delivered_customer_date", "order_estimated_delivery_date",
)
# -------------------------------------------------------- end fixed values

# Rows of the largest fact in a bucket: some hundred MB of Parquet at a few dozen bytes a row.
ROWS_PER_BUCKET = 4_000_000
MAX_BUCKETS = 1 << 16


def build_star(raw: dict[str, DataFrame], typed_times: bool = False) -> dict[str, DataFrame]:
    """Dimensions and facts from the landed tables; reviews keep the latest answer per review.

    Stamps stay text as landed. ``typed_times`` makes order stamps timestamps; a text that is no
    stamp then becomes null instead of failing the load.
    """
    orders = raw["orders"]
    if typed_times:
        orders = orders.withColumns({c: orders[c].try_cast("timestamp_ntz") for c in ORDER_TIMES if c in orders.columns})
    return {
        "dim_customers": raw["customers"],
        "dim_sellers": raw["sellers"],
        "dim_products": raw["products"],
        "dim_category_translation": raw["category_translation"],
        "fact_orders": orders,
        "fact_order_items": raw["order_items"],
        "fact_order_payments": raw["order_payments"],
        "fact_order_reviews": dedupe_reviews(raw["order_reviews"]),
    }


def dedupe_reviews(reviews: DataFrame) -> DataFrame:
    ties = [c for c in ("order_id", "review_score") if c in reviews.columns]
    return latest_per_key(reviews, ["review_id"], "review_answer_timestamp", ties)


def check_star(model: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Verdicts of all primary keys and all references whose tables are present."""
    pks = [check_pk(model[t], cols, t) for t, cols in PRIMARY_KEYS.items() if t in model]
    fks = [check_fk(model[c], cc, model[p], pc, name) for name, c, cc, p, pc in FOREIGN_KEYS if c in model and p in model]
    return _stack(pks), _stack(fks)


def _stack(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def bucket_count(model: dict[str, DataFrame], rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Buckets for the facts by the rows of the largest one, a power of two: 1 to ``MAX_BUCKETS``.

    Reviews are not counted, that would deduplicate them once more.
    """
    facts = [df for name, df in model.items() if _by_order(name, df) and name != "fact_order_reviews"]
    largest = max((df.count() for df in facts), default=0)
    return min(1 << max(-(-largest // rows_per_bucket) - 1, 0).bit_length(), MAX_BUCKETS)


def save_star(model: dict[str, DataFrame], database: str, buckets: int | None = None) -> None:
    """Write the model as tables; everything keyed by order is bucketed and sorted on ``order_id``.

    Joins and aggregations between orders, items, payments and reviews then need no shuffle of the
    facts. ``buckets`` follows from the rows unless it is given. A join of buckets has no shuffle that adaptive
    execution could split, so one order that holds much of a fact stays in one task: fold that fact per order first
    (as the measures do), or read with ``spark.sql.sources.bucketing.enabled=false``, which brings the shuffle back.
    """
    buckets = buckets or bucket_count(model)
    for name, df in model.items():
        writer = df.write.mode("overwrite").format("parquet")
        if _by_order(name, df):
            writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
        writer.saveAsTable(f"{database}.{name}")


def _by_order(name: str, df: DataFrame) -> bool:
    return name.startswith("fact_") and "order_id" in df.columns
