"""The governed measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyglass.catalog import DEFAULT_TOP_N, MAX_ROWS, MIN_REVIEWS, Catalog
from tallyglass.functions.money import cents, from_cents
from tallyglass.functions.terms import RETURNED_STATUSES
from tallyglass.operators.glossary import TimeWindow, filter_region, filter_window, time_window, window_cells
from tallyglass.operators.latest import top_per_key, top_per_key_in_shares

Model = dict[str, DataFrame]
PURCHASED = "order_purchase_timestamp"


def _orders(model: Model, window: TimeWindow | None, *cols: str) -> DataFrame:
    orders = model["fact_orders"]
    if window is not None:
        orders = filter_window(orders, PURCHASED, window)
    return orders.select(*cols)


def _categories(model: Model) -> DataFrame:
    """product_id, category: translated categories only; products without one drop out here."""
    return (
        model["dim_products"]
        .select("product_id", "product_category_name")
        .join(model["dim_category_translation"], "product_category_name")
        .select("product_id", F.col("product_category_name_english").alias("category"))
    )


def top_categories_by_revenue(model: Model, window: TimeWindow | None = None, top_n: int = DEFAULT_TOP_N) -> DataFrame:
    """Categories by revenue, highest first.

    Items meet orders on order_id (no shuffle on bucketed tables), then shrink to one row per
    product before any dimension is joined; a hot product is one partial sum per map task.
    """
    items = model["fact_order_items"].select("order_id", "product_id", "price")
    per_product = (
        items.join(_orders(model, window, "order_id"), "order_id")
        .groupBy("product_id")
        .agg(F.sum(cents("price")).alias("_cents"))
    )
    return (
        per_product.join(_categories(model), "product_id")
        .groupBy("category")
        .agg(from_cents(F.sum("_cents")).alias("revenue"))
        .orderBy(F.desc("revenue"), "category")
        .limit(top_n)
    )


def aov_by_state(model: Model) -> DataFrame:
    """Average order value per customer state, highest first.

    Items are summed per order first. The count of orders is then a plain count over one row per
    order: same key as the join, no distinct, and the customer join moves orders rather than items.
    """
    per_order = (
        model["fact_order_items"].groupBy("order_id").agg(F.sum(cents("price")).alias("_cents"))
    )
    return (
        per_order.join(model["fact_orders"].select("order_id", "customer_id"), "order_id")
        .join(model["dim_customers"].select("customer_id", "customer_state"), "customer_id")
        .groupBy("customer_state")
        .agg((from_cents(F.sum("_cents")) / F.count("*")).alias("aov"))
        .orderBy(F.desc("aov"), "customer_state")
        .limit(MAX_ROWS)
    )


def seller_ratings_by_state(
    model: Model,
    window: TimeWindow | None = None,
    states: list[str] | None = None,
    min_reviews: int = MIN_REVIEWS,
    top_n: int = DEFAULT_TOP_N,
    distinct_reviews: bool = False,
) -> DataFrame:
    """Sellers by mean review score, lowest first, with at least ``min_reviews`` reviews.

    A review counts once per item of the seller in its order, as the governed join does;
    ``distinct_reviews`` counts it once per seller. Reviews and items are reduced to one row per
    order (and seller) first, so the review x item product is arithmetic instead of rows and a hot
    order cannot grow. On tables bucketed by order (``save_star``) none of this moves a fact.
    """
    sellers = model["dim_sellers"].select("seller_id", "seller_state")
    if states is not None:
        sellers = filter_region(sellers, "seller_state", states)
    reviews = (
        model["fact_order_reviews"]
        .where("order_id is not null")
        .groupBy("order_id")
        .agg(
            F.sum("review_score").alias("_score"),
            F.count("review_score").alias("_scored"),
            F.count("review_id").alias("_reviews"),
        )
    )
    items = model["fact_order_items"].groupBy("order_id", "seller_id").agg(F.count("*").alias("_items"))
    weight = F.lit(1) if distinct_reviews else F.col("_items")
    per_seller = (
        reviews.join(_orders(model, window, "order_id"), "order_id")
        .join(items, "order_id")
        .groupBy("seller_id")
        .agg(
            F.sum(F.col("_score") * weight).alias("_score"),
            F.sum(F.col("_scored") * weight).alias("_scored"),
            F.sum(F.col("_reviews") * weight).alias("review_count"),
        )
    )
    return (
        per_seller.where(F.col("review_count") >= min_reviews)
        .join(sellers, "seller_id")
        .select(
            "seller_id",
            "seller_state",
            F.try_divide(F.col("_score").cast("double"), F.col("_scored")).alias("avg_rating"),
            "review_count",
        )
        .orderBy("avg_rating", "seller_id")
        .limit(top_n)
    )


def return_rate_all(model: Model, returned=RETURNED_STATUSES) -> DataFrame:
    """Share of distinct orders in a returned state, per category.

    Lines become one row per (category, order) before they meet the orders: the partial aggregation
    folds a hot order to its few categories, and two plain sums replace two distinct counts. The join
    with the products takes plain shuffled rows, which lets adaptive execution split a hot product.
    """
    hit = F.coalesce(F.col("order_status").isin(*returned), F.lit(False)).cast("int")
    per_order = (
        model["fact_order_items"].select("order_id", "product_id")
        .join(_categories(model), "product_id")
        .select("category", "order_id")
        .distinct()
        .join(model["fact_orders"].select("order_id", hit.alias("_hit")), "order_id")
    )
    return per_order.groupBy("category").agg(_rate())


def _rate():
    return F.try_divide(F.sum("_hit").cast("double"), F.count("*")).alias("return_rate")


def return_rate_by_category(model: Model, category: str, returned=RETURNED_STATUSES) -> DataFrame:
    """One category's rate; an unknown category gives no row.

    The few products of a category cut the lines down first; what remains is one row per order, already
    placed for the join with the orders.
    """
    products = _categories(model).where(F.col("category") == F.lit(category)).select("product_id")
    hit = F.coalesce(F.col("order_status").isin(*returned), F.lit(False)).cast("int")
    orders = (
        model["fact_order_items"].select("order_id", "product_id")
        .join(products, "product_id")
        .select("order_id")
        .distinct()
        .join(model["fact_orders"].select("order_id", hit.alias("_hit")), "order_id")
    )
    return orders.groupBy(F.lit(category).alias("category")).agg(_rate()).limit(MAX_ROWS)


def run_measure(
    model: Model, measure: str, params: dict[str, str], catalog: Catalog, returned=RETURNED_STATUSES
) -> DataFrame:
    """A measure from resolved parameters (see ``resolve_selections``). Values are bound as typed
    arguments; no SQL text is put together."""
    period = params.get("date_filter") or None
    window = time_window(period, catalog.reference_date) if period else None
    top_n = int(params.get("top_n") or DEFAULT_TOP_N)
    if measure == "top_categories_by_revenue":
        return top_categories_by_revenue(model, window, top_n)
    if measure == "aov_by_state":
        return aov_by_state(model)
    if measure == "seller_ratings_by_state":
        region = params.get("state_filter") or None
        return seller_ratings_by_state(model, window, catalog.regions[region] if region else None, top_n=top_n)
    if measure == "return_rate_by_category":
        return return_rate_by_category(model, params["category"], returned)
    raise ValueError(f"unknown measure: {measure!r}")


# ---------------------------------------------------------------- a table of selections

_RESULT = ["measure", "period", "region", "category", "rank", "label", "detail", "value", "n_rows"]


def _result(df: DataFrame, measure: str, **cols) -> DataFrame:
    """Columns of a result table; what a measure does not have is empty (keys) or null (values)."""
    kinds = {"period": "", "region": "", "category": "", "detail": None, "n_rows": None}
    given = {k: cols.get(k, F.lit(v)) for k, v in kinds.items()} | cols | {"measure": F.lit(measure)}
    casts = {"rank": "int", "value": "double", "n_rows": "bigint"}
    return df.select(*(given[c].cast(casts.get(c, "string")).alias(c) for c in _RESULT))


def _cells(model: Model, catalog: Catalog) -> tuple[DataFrame, Column]:
    """Orders with the cell of their purchase, and the windows of a cell."""
    windows = {name: time_window(name, catalog.reference_date) for name in catalog.glossary_keys()["time_periods"]}
    orders = model["fact_orders"]
    cell, names = window_cells(F.col(PURCHASED), orders.schema[PURCHASED].dataType, windows)
    return orders.select("order_id", cell.alias("cell")), names


def _revenue_results(model: Model, catalog: Catalog) -> DataFrame:
    orders, names = _cells(model, catalog)
    per_product = (
        model["fact_order_items"].select("order_id", "product_id", "price")
        .join(orders, "order_id")
        .groupBy("product_id", "cell")
        .agg(F.sum(cents("price")).alias("_cents"))
    )
    per_cell = per_product.join(_categories(model), "product_id").groupBy("category", "cell").agg(F.sum("_cents").alias("_cents"))
    sums = (
        per_cell.select("category", F.explode(names).alias("period"), "_cents")
        .groupBy("category", "period")
        .agg(from_cents(F.sum("_cents")).alias("revenue"))
    )
    # One row per category and period is what there is to rank.
    ranked = top_per_key(sums, ["period"], [F.desc("revenue"), F.asc("category")], 2**31 - 1)
    return _result(ranked, "top_categories_by_revenue", period=F.col("period"), rank=F.col("rank"), label=F.col("category"), value=F.col("revenue"))


def _rating_results(model: Model, catalog: Catalog, k: int, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    orders, names = _cells(model, catalog)
    reviews = (
        model["fact_order_reviews"].where("order_id is not null").groupBy("order_id")
        .agg(F.sum("review_score").alias("_score"), F.count("review_score").alias("_scored"), F.count("review_id").alias("_reviews"))
    )
    items = model["fact_order_items"].groupBy("order_id", "seller_id").agg(F.count("*").alias("_items"))
    sums = ["_score", "_scored", "_reviews"]
    per_cell = (
        reviews.join(orders, "order_id").join(items, "order_id").groupBy("seller_id", "cell")
        .agg(*(F.sum(F.col(c) * F.col("_items")).alias(c) for c in sums))
    )
    per_period = (
        per_cell.select("seller_id", F.explode(names).alias("period"), *sums).groupBy("seller_id", "period")
        .agg(*(F.sum(c).alias(c) for c in sums))
        .where(F.col("_reviews") >= min_reviews)
    )
    held = [F.when(F.col("seller_state").isin(*states), F.lit(name)) for name, states in catalog.regions.items()]
    sellers = model["dim_sellers"].select("seller_id", "seller_state", F.array_compact(F.array(F.lit(""), *held)).alias("regions"))
    rated = per_period.join(sellers, "seller_id").select(
        "seller_id", "seller_state", "period", F.explode("regions").alias("region"), "_reviews",
        F.try_divide(F.col("_score").cast("double"), F.col("_scored")).alias("avg_rating"),
    )
    order = [F.asc("avg_rating"), F.asc("seller_id")]
    ranked = top_per_key_in_shares(rated, ["period", "region"], order, k, "seller_id")
    return _result(
        ranked, "seller_ratings_by_state", period=F.col("period"), region=F.col("region"), rank=F.col("rank"),
        label=F.col("seller_id"), detail=F.col("seller_state"), value=F.col("avg_rating"), n_rows=F.col("_reviews"),
    )


def run_selections(resolved: DataFrame, key: str, model: Model, catalog: Catalog, returned=RETURNED_STATUSES) -> DataFrame:
    """Results of a whole table of resolved selections, whichever measures they name.

    ``resolved`` comes from ``resolve_selections``; ``key`` names a selection. Returns ``key, measure, rank, label, detail,
    value, n_rows``, one row per row of a selection's answer: label is the category, state or seller, detail the state of a
    seller, ``n_rows`` its reviews. A selection with an error of resolution has none, nor has one with a ``top_n``
    below 1.

    Every measure is computed once for all periods and regions of the catalog, and selections meet the results in an
    equi-join on their parameters. Facts are summed per cell between the bounds of the periods, so that periods that overlap cost
    nothing more. There are no more results than categories, states, and the largest ``top_n`` of sellers per period
    and region: the join becomes a broadcast at run time where they are small, and splits hot parameters where they are not.
    """
    params = F.col("parameters_applied")
    has_top = [m for m, ps in catalog.measures.items() if any(p[0] == "top_n" for p in ps)]
    top = F.when(F.col("measure").isin(*has_top), F.coalesce(F.try_element_at(params, F.lit("top_n")).try_cast("bigint"), F.lit(DEFAULT_TOP_N)))

    def given(name: str):
        return F.coalesce(F.try_element_at(params, F.lit(name)), F.lit(""))

    asked = resolved.where(params.isNotNull()).select(
        key, "measure", given("date_filter").alias("period"), given("state_filter").alias("region"),
        given("category").alias("category"), F.coalesce(top, F.lit(MAX_ROWS)).alias("_top"),
    )
    rated = F.col("measure") == "seller_ratings_by_state"
    k = asked.where(rated).agg(F.max("_top")).first()[0] or 0

    by_state = top_per_key(aov_by_state(model).withColumn("_all", F.lit(0)), ["_all"], [F.desc("aov"), F.asc("customer_state")], MAX_ROWS)
    results = _revenue_results(model, catalog)
    results = results.unionByName(_result(by_state, "aov_by_state", rank=F.col("rank"), label=F.col("customer_state"), value=F.col("aov")))
    results = results.unionByName(_rating_results(model, catalog, min(max(k, 0), 2**31 - 1)))
    rates = return_rate_all(model, returned).where("category is not null")
    results = results.unionByName(
        _result(rates, "return_rate_by_category", category=F.col("category"), rank=F.lit(1), label=F.col("category"), value=F.col("return_rate"))
    )
    met = asked.join(results, ["measure", "period", "region", "category"]).where(F.col("rank") <= F.col("_top"))
    return met.select(key, "measure", "rank", "label", "detail", "value", "n_rows")
