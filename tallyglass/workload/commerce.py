"""Governed measures, the relational blocks under them, glossary windows, and recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.catalog import Catalog
from tallyglass.functions import terms
from tallyglass.functions.money import money_sum
from tallyglass.operators import geo, glossary
from tallyglass.plans import measures, recipes
from tallyglass.workload.registry import query
from tallyglass.workload.roles import REFERENCE_DATE, RETURNED, Tables

_QUARTER = glossary.time_window("last_quarter", REFERENCE_DATE)
_YEAR = glossary.time_window("this_year", REFERENCE_DATE)
# The same bounds by SQL date arithmetic.
_REF = "DATE '2001-06-15'"
_BOUNDS = {
    "last_quarter": f"order_purchase_timestamp >= date_trunc('quarter', {_REF}) - INTERVAL 3 MONTH AND order_purchase_timestamp < date_trunc('quarter', {_REF})",
    "last_month": f"order_purchase_timestamp >= date_trunc('month', {_REF}) - INTERVAL 1 MONTH AND order_purchase_timestamp < date_trunc('month', {_REF})",
    "this_year": f"order_purchase_timestamp >= date_trunc('year', {_REF}) AND order_purchase_timestamp <= {_REF}",
}
_JOINED = """items JOIN products USING (product_id) JOIN translation USING (product_category_name)
             JOIN purchases USING (order_id)"""
_LINES = "items products translation purchases"


def _round(df, **digits):
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# ---------------------------------------------------------------- measures


def _m1_sql(where="", n=10):
    return f"""SELECT product_category_name_english AS category,
       sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) / 100 AS revenue
       FROM {_JOINED} {where} GROUP BY 1 ORDER BY revenue DESC, category LIMIT {n}"""


@query("m1_top_categories_by_revenue", _m1_sql(), _LINES)
def _(t):
    return measures.top_categories_by_revenue(t.model)


@query("m1_top_categories_last_quarter", _m1_sql(f"WHERE {_BOUNDS['last_quarter']}", 3), _LINES)
def _(t):
    return measures.top_categories_by_revenue(t.model, _QUARTER, 3)


@query(
    "m2_aov_by_state",
    """SELECT customer_state, round(sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) / 100 / count(DISTINCT order_id), 6) AS aov FROM items
       JOIN purchases USING (order_id) JOIN customers USING (customer_id)
       GROUP BY 1 ORDER BY aov DESC LIMIT 1000""",
    "items purchases customers",
)
def _(t):
    return _round(measures.aov_by_state(t.model), aov=6)


def _m3_sql(where, n, count="count(review_id)", avg="avg(review_score)"):
    return f"""SELECT seller_id, seller_state, round({avg}, 6) AS avg_rating, {count} AS review_count
       FROM reviews JOIN purchases USING (order_id) JOIN items USING (order_id) JOIN sellers USING (seller_id)
       {where} GROUP BY 1, 2 HAVING {count} >= 5 ORDER BY {avg}, seller_id LIMIT {n}"""


_M3_ROLES = "reviews purchases items sellers"


@query("m3_seller_ratings_by_state", _m3_sql("", 10), _M3_ROLES)
def _(t):
    return _round(measures.seller_ratings_by_state(t.model), avg_rating=6)


@query(
    "m3_seller_ratings_window_region",
    _m3_sql(f"WHERE {_BOUNDS['this_year']} AND region = 'EUROPE'", 25),
    _M3_ROLES,
)
def _(t):
    states = t.catalog.regions["europe"]
    return _round(measures.seller_ratings_by_state(t.model, _YEAR, states, top_n=25), avg_rating=6)


@query(
    "m3_seller_ratings_distinct_reviews",
    """SELECT seller_id, seller_state, round(avg(review_score), 6) AS avg_rating, count(*) AS review_count
       FROM (SELECT DISTINCT seller_id, seller_state, review_id, review_score FROM reviews JOIN purchases USING (order_id)
             JOIN items USING (order_id) JOIN sellers USING (seller_id))
       GROUP BY 1, 2 HAVING count(*) >= 5 ORDER BY avg(review_score), seller_id LIMIT 10""",
    _M3_ROLES,
)
def _(t):
    return _round(measures.seller_ratings_by_state(t.model, distinct_reviews=True), avg_rating=6)


_M5 = f"""SELECT product_category_name_english AS category,
   round((count(DISTINCT order_id) FILTER (WHERE order_status IN ('P')))::DOUBLE
         / nullif(count(DISTINCT order_id), 0), 9) AS return_rate FROM {_JOINED}"""


@query("m4_return_rate_by_category", f"{_M5} WHERE product_category_name_english = 'economy' GROUP BY 1 LIMIT 1000", _LINES)
def _(t):
    return _round(measures.return_rate_by_category(t.model, "economy", RETURNED), return_rate=9)


@query("m5_return_rate_all", f"{_M5} GROUP BY 1", _LINES)
def _(t):
    return _round(measures.return_rate_all(t.model, RETURNED), return_rate=9)


@query(
    "m6_business_terms",
    f"""SELECT product_category_name_english AS category, round(sum(price), 2) AS revenue,
        round(sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) / 100 / count(DISTINCT order_id), 6) AS aov, round(avg(order_item_id), 6) AS seller_rating,
        round((count(DISTINCT order_id) FILTER (WHERE order_status = 'P'))::DOUBLE / count(DISTINCT order_id), 9) AS return_rate
        FROM {_JOINED} GROUP BY 1""",
    _LINES,
)
def _(t):
    m = t.model
    joined = (
        m["fact_order_items"].join(m["dim_products"], "product_id")
        .join(m["dim_category_translation"], "product_category_name")
        .join(m["fact_orders"], "order_id")
    )
    out = joined.groupBy(F.col("product_category_name_english").alias("category")).agg(
        terms.revenue().alias("revenue"),
        terms.aov().alias("aov"),
        terms.seller_rating("order_item_id").alias("seller_rating"),
        terms.return_rate(returned=RETURNED).alias("return_rate"),
    )
    return _round(out, revenue=2, aov=6, seller_rating=6, return_rate=9)


# ---------------------------------------------------------------- relational blocks

_EDGES = [
    ("items_products", "items", "products", "product_id"),
    ("products_translation", "products", "translation", "product_category_name"),
    ("items_orders", "items", "purchases", "order_id"),
    ("orders_customers", "purchases", "customers", "customer_id"),
    ("reviews_orders", "reviews", "purchases", "order_id"),
    ("items_sellers", "items", "sellers", "seller_id"),
]


@query(
    "r1_inner_equi_joins",
    " UNION ALL ".join(f"SELECT '{n}' AS edge, count(*) AS n_rows FROM {a} JOIN {b} USING ({k})" for n, a, b, k in _EDGES),
    "items products translation purchases customers reviews sellers",
)
def _(t):
    parts = [
        t.role(a).select(k).join(t.role(b).select(k), k).agg(F.lit(n).alias("edge"), F.count("*").alias("n_rows"))
        for n, a, b, k in _EDGES
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "r2_time_windows",
    f"""SELECT order_id, order_status, 'half_open' AS kind FROM purchases WHERE {_BOUNDS['last_quarter']}
        UNION ALL SELECT order_id, order_status, 'closed' FROM purchases WHERE {_BOUNDS['this_year']}""",
    "purchases",
)
def _(t):
    orders = t.role("purchases")

    def inside(w, kind):
        return glossary.filter_window(orders, "order_purchase_timestamp", w).select("order_id", "order_status", F.lit(kind).alias("kind"))

    return inside(_QUARTER, "half_open").unionByName(inside(_YEAR, "closed"))


@query("r3_in_list", "SELECT order_id, order_status FROM purchases WHERE order_status IN ('P', 'F')", "purchases")
def _(t):
    return t.role("purchases").where(F.col("order_status").isin("P", "F")).select("order_id", "order_status")


@query("r4_bound_string", "SELECT product_id, product_category_name FROM products WHERE product_category_name = 'PROMO'", "products")
def _(t):
    # The value is bound by the parser as a literal; quotes in it stay text.
    return t.spark.sql(
        "SELECT product_id, product_category_name FROM {products} WHERE product_category_name = :name",
        args={"name": "PROMO"},
        products=t.role("products"),
    )


@query(
    "r5_group_by_alias",
    "SELECT strftime(order_purchase_timestamp, '%Y') AS year, count(*) AS n FROM purchases GROUP BY year",
    "purchases",
)
def _(t):
    return t.spark.sql(
        "SELECT date_format(order_purchase_timestamp, 'yyyy') AS year, count(*) AS n FROM {orders} GROUP BY year",
        orders=t.role("purchases"),
    )


@query(
    "r6_sum_avg_count",
    """SELECT seller_id, round(sum(price), 2) AS total, round(avg(order_item_id), 9) AS mean_position,
       count(freight_value) AS n FROM items GROUP BY 1""",
    "items",
)
def _(t):
    out = t.role("items").groupBy("seller_id").agg(
        money_sum("price").alias("total"), F.avg("order_item_id").alias("mean_position"), F.count("freight_value").alias("n")
    )
    return _round(out, total=2, mean_position=9)


@query(
    "r7_count_distinct",
    "SELECT seller_id, count(DISTINCT order_id) AS n_orders FROM items GROUP BY 1",
    "items",
)
def _(t):
    return t.role("items").groupBy("seller_id").agg(F.count_distinct("order_id").alias("n_orders"))


@query(
    "r8_aggregate_filter",
    """SELECT customer_id, count(*) FILTER (WHERE order_status = 'P') AS n_returned,
       round(coalesce(sum(order_total) FILTER (WHERE order_status IN ('F', 'O')), 0), 2) AS kept FROM purchases GROUP BY 1""",
    "purchases",
)
def _(t):
    return t.role("purchases").groupBy("customer_id").agg(
        F.count_if(F.col("order_status") == "P").alias("n_returned"),
        F.round(
            F.coalesce(money_sum(F.when(F.col("order_status").isin("F", "O"), F.col("order_total"))), F.lit(0.0)), 2
        ).alias("kept"),
    )


@query(
    "r9_guarded_division",
    """SELECT user_id, round(count(*) FILTER (WHERE event_type = 'error')::DOUBLE
       / nullif(count(*) FILTER (WHERE event_type = 'click'), 0), 9) AS errors_per_click FROM events GROUP BY 1""",
)
def _(t):
    kinds = t.read("events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "error").alias("_e"), F.count_if(F.col("event_type") == "click").alias("_c")
    )
    return kinds.select("user_id", F.round(F.try_divide(F.col("_e").cast("double"), F.col("_c")), 9).alias("errors_per_click"))


@query("r10_having", "SELECT order_id, count(*) AS n FROM items GROUP BY 1 HAVING count(*) >= 7", "items")
def _(t):
    return t.role("items").groupBy("order_id").agg(F.count("*").alias("n")).where("n >= 7")


@query(
    "r11_top_k",
    "SELECT order_id, order_total FROM purchases ORDER BY order_total DESC, order_id LIMIT 25",
    "purchases",
)
def _(t):
    return t.role("purchases").select("order_id", "order_total").orderBy(F.desc("order_total"), "order_id").limit(25)


@query(
    "r12_chained_tables",
    """WITH per_seller AS (SELECT seller_id, sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) AS c FROM items GROUP BY 1),
       per_state AS (SELECT seller_state, sum(c) / 100 AS revenue, count(*) AS n_sellers
                     FROM per_seller JOIN sellers USING (seller_id) GROUP BY 1)
       SELECT seller_state, revenue, n_sellers FROM per_state WHERE n_sellers > 1""",
    "items sellers",
)
def _(t):
    per_seller = t.role("items").groupBy("seller_id").agg(money_sum("price").alias("revenue"))
    per_state = per_seller.join(t.role("sellers").select("seller_id", "seller_state"), "seller_id").groupBy("seller_state").agg(
        money_sum("revenue").alias("revenue"), F.count("*").alias("n_sellers")
    )
    return per_state.where("n_sellers > 1")


# ---------------------------------------------------------------- glossary over data


@query(
    "g1_relative_periods",
    " UNION ALL ".join(
        f"SELECT '{p}' AS period, count(*) AS n_orders, round(sum(order_total), 2) AS total FROM purchases WHERE {b}"
        for p, b in _BOUNDS.items()
    ),
    "purchases",
)
def _(t):
    out = None
    for p in _BOUNDS:
        w = glossary.time_window(p, REFERENCE_DATE)
        one = glossary.filter_window(t.role("purchases"), "order_purchase_timestamp", w).agg(
            F.lit(p).alias("period"), F.count("*").alias("n_orders"), F.round(money_sum("order_total"), 2).alias("total")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "g2_region_filter",
    "SELECT seller_id, seller_state, 'asia' AS region_name FROM sellers WHERE region = 'ASIA'",
    "sellers",
)
def _(t):
    out = glossary.filter_region(t.role("sellers"), "seller_state", t.catalog.regions["asia"])
    return out.select("seller_id", "seller_state", F.lit("asia").alias("region_name"))


@query(
    "g3_default_top_n",
    r"""SELECT selection_id, coalesce(CASE WHEN regexp_matches(top_n, '^\s*[+-]?\d+(_\d+)*\s*$')
        THEN CAST(replace(trim(top_n), '_', '') AS BIGINT) END, 10) AS n FROM selections""",
    "selections",
)
def _(t):
    n = glossary.coerce_scalar(F.col("top_n"), F.lit("integer")).cast("bigint")
    return t.role("selections").select("selection_id", glossary.default_top_n(n).alias("n"))


_SPEND = "SELECT customer_id, round(sum(order_total), 2) AS spend FROM purchases GROUP BY 1"


def _spend(t):
    return t.role("purchases").groupBy("customer_id").agg(F.round(money_sum("order_total"), 2).alias("spend"))


@query(
    "g4_underperforming",
    f"WITH m AS ({_SPEND}) SELECT * FROM m WHERE spend < (SELECT quantile_cont(spend, 0.5) FROM m)",
    "purchases",
)
def _(t):
    return glossary.underperforming(_spend(t), "spend")


@query(
    "g5_high",
    f"WITH m AS ({_SPEND}) SELECT * FROM m WHERE spend >= (SELECT quantile_cont(spend, 0.75) FROM m)",
    "purchases",
)
def _(t):
    return glossary.high(_spend(t), "spend")


@query(
    "g9_run_measure",
    _m3_sql(f"WHERE {_BOUNDS['this_year']} AND region = 'EUROPE'", 7),
    _M3_ROLES,
)
def _(t: Tables):
    picked = t.spark.createDataFrame(
        [("seller_ratings_by_state", ["time_periods.this_year", "regions.europe"], {"top_n": "7"})],
        "measure string, glossary_refs array<string>, filters map<string,string>",
    )
    row = glossary.resolve_selections(picked, t.catalog).first()
    return _round(measures.run_measure(t.model, row["measure"], row["parameters_applied"], t.catalog), avg_rating=6)


# Selections name the catalog's own regions and categories here.
_KINDS = ["economy", "standard", "small", "medium"]
_KIND_OF = "CASE abs(selection_id) % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_REFS_OF = "replace(replace(refs, 'regions.south', 'regions.europe'), 'regions.north', 'regions.asia')"
_PERIODS = ["", *_BOUNDS]


def _each_period(select, tail):
    """A SELECT over all rows and one for each period."""
    return " UNION ALL ".join(f"SELECT '{p}' AS period, {select} {'WHERE ' + _BOUNDS[p] if p else ''} {tail}" for p in _PERIODS)


_G9 = f"""hits AS (SELECT selection_id, measure, top_n, CASE WHEN category IS NOT NULL THEN {_KIND_OF} END AS category,
     list_filter(split({_REFS_OF}, ','), lambda r: starts_with(r, 'time_periods.')) AS tp,
     list_filter(split({_REFS_OF}, ','), lambda r: starts_with(r, 'regions.')) AS rg,
     top_n IS NULL OR regexp_matches(top_n, '^\\s*[+-]?\\d+(_\\d+)*\\s*$') AS good_n FROM selections),
   sound AS (SELECT *, good_n AND len(tp) <= 1 AND (len(tp) = 0 OR tp[1] IN ('time_periods.last_quarter', 'time_periods.last_month', 'time_periods.this_year')) AS good_t,
     len(rg) <= 1 AND (len(rg) = 0 OR rg[1] IN ('regions.europe', 'regions.asia')) AS good_r FROM hits),
   sel AS (SELECT selection_id, measure, coalesce(split_part(tp[1], '.', 2), '') AS period,
     CASE WHEN measure = 'seller_ratings_by_state' THEN coalesce(split_part(rg[1], '.', 2), '') ELSE '' END AS region,
     '' AS category, coalesce(TRY_CAST(replace(trim(top_n), '_', '') AS BIGINT), 10) AS k FROM sound
     WHERE (measure = 'top_categories_by_revenue' AND good_t) OR (measure = 'seller_ratings_by_state' AND good_t AND good_r)
     UNION ALL SELECT selection_id, measure, '', '', CASE measure WHEN 'aov_by_state' THEN '' ELSE category END, 1000 FROM sound
     WHERE measure = 'aov_by_state' OR (measure = 'return_rate_by_category' AND category IS NOT NULL)),
   m1 AS ({_each_period("product_category_name_english AS label, sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) / 100 AS value FROM " + _JOINED, "GROUP BY 2")}),
   m2 AS (SELECT customer_state AS label, sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) / 100 / count(DISTINCT order_id) AS value
     FROM items JOIN purchases USING (order_id) JOIN customers USING (customer_id) GROUP BY 1),
   m3 AS ({_each_period("seller_id, seller_state, region AS home, avg(review_score) AS value, count(review_id) AS n FROM reviews JOIN purchases USING (order_id) JOIN items USING (order_id) JOIN sellers USING (seller_id)", "GROUP BY 2, 3, 4 HAVING count(review_id) >= 5")}),
   m3r AS (SELECT *, '' AS region FROM m3 UNION ALL SELECT *, lower(home) FROM m3 WHERE home IN ('EUROPE', 'ASIA')),
   m4 AS ({_M5} GROUP BY 1),
   res AS (SELECT 'top_categories_by_revenue' AS measure, period, '' AS region, '' AS category, row_number() OVER (PARTITION BY period ORDER BY value DESC, label) AS rank, label, NULL AS detail, value, NULL AS n_rows FROM m1
     UNION ALL SELECT 'aov_by_state', '', '', '', row_number() OVER (ORDER BY value DESC, label), label, NULL, value, NULL FROM m2
     UNION ALL SELECT 'seller_ratings_by_state', period, region, '', row_number() OVER (PARTITION BY period, region ORDER BY value, seller_id), seller_id::VARCHAR, seller_state, value, n FROM m3r
     UNION ALL SELECT 'return_rate_by_category', '', '', category, 1, category, NULL, return_rate, NULL FROM m4)"""


@query(
    "g9_run_selections",
    f"""WITH {_G9} SELECT selection_id, measure, rank::INT AS rank, label, detail, round(value, 6) AS value, n_rows::BIGINT AS n_rows
        FROM sel JOIN res USING (measure, period, region, category) WHERE rank <= k""",
    f"selections {_M3_ROLES} products translation customers",
)
def _(t: Tables):
    own = t.role("selections").withColumns({"refs": F.expr(_REFS_OF), "category": F.expr(f"CASE WHEN category IS NOT NULL THEN {_KIND_OF} END")})
    picked = own.selectExpr(
        "selection_id", "measure", "filter(split(refs, ','), x -> x <> '') AS glossary_refs",
        "map_filter(map('top_n', top_n, 'category', category), (k, v) -> v IS NOT NULL) AS filters",
    )
    resolved = glossary.resolve_selections(picked, t.catalog)
    return _round(measures.run_selections(resolved, "selection_id", t.model, t.catalog, RETURNED), value=6)


# ---------------------------------------------------------------- recipes


@query(
    "x1_repeat_customers",
    """WITH h AS (SELECT customer_unique_id, count(*) AS n FROM purchases JOIN customers USING (customer_id) GROUP BY 1)
       SELECT sum(n)::BIGINT AS n_orders, count(*) AS n_customers, count(*) FILTER (WHERE n > 1) AS n_repeat,
       round(count(*) FILTER (WHERE n > 1) / count(*), 9) AS repeat_rate FROM h""",
    "purchases customers",
)
def _(t):
    return _round(recipes.repeat_customers(t.model), repeat_rate=9)


@query(
    "x2_untranslated_categories",
    """SELECT coalesce(product_category_name_english, product_category_name) AS category, round(sum(price), 2) AS revenue
       FROM items JOIN products USING (product_id) LEFT JOIN translation USING (product_category_name) GROUP BY 1""",
    "items products translation",
)
def _(t):
    return _round(recipes.revenue_with_untranslated(t.model), revenue=2)


@query(
    "x3_unreviewed_bucket",
    """SELECT coalesce(review_score::VARCHAR, 'unreviewed') AS bucket, count(*) AS n_orders
       FROM purchases LEFT JOIN reviews USING (order_id) GROUP BY 1""",
    "purchases reviews",
)
def _(t):
    return recipes.review_buckets(t.model)


@query(
    "x4_delivery_latency",
    """WITH d AS (SELECT order_id, order_purchase_timestamp AS p, p + INTERVAL 1000 DAY AS due,
                  (SELECT max(shipping_limit_date) FROM items i WHERE i.order_id = o.order_id) AS done FROM purchases o)
       SELECT CASE WHEN done IS NULL THEN 'undelivered' WHEN done <= due THEN 'on_time' ELSE 'late' END AS delivery,
       count(*) AS n_orders, round(coalesce(avg(epoch(done) - epoch(p)) / 86400, 0), 6) AS mean_days,
       round(coalesce(max(epoch(done) - epoch(p)) / 86400, 0), 6) AS max_days FROM d GROUP BY 1""",
    "purchases items",
)
def _(t):
    done = t.role("items").groupBy("order_id").agg(F.max("shipping_limit_date").alias("order_delivered_customer_date"))
    orders = t.role("purchases").join(done, "order_id", "left").withColumn(
        "order_estimated_delivery_date", F.col("order_purchase_timestamp") + F.expr("INTERVAL '1000' DAY")
    )
    out = recipes.delivery_latency(orders)
    return out.withColumns({c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6) for c in ("mean_days", "max_days")})


@query(
    "x5_status_shares",
    """SELECT order_status, count(*) AS n_orders, round(count(*) / (SELECT count(*) FROM purchases), 9) AS share
       FROM purchases GROUP BY 1""",
    "purchases",
)
def _(t):
    return _round(recipes.status_shares(t.role("purchases")), share=9)


@query(
    "x5_delivered_only",
    "SELECT order_id, customer_id FROM purchases WHERE order_status = 'F'",
    "purchases",
)
def _(t):
    return recipes.delivered_only(t.role("purchases"), "F").select("order_id", "customer_id")


@query(
    "x6_geo_coverage",
    """WITH known AS (SELECT DISTINCT geolocation_zip_code_prefix AS z FROM geolocation WHERE geolocation_state = 'debit')
       SELECT count(*) AS n_rows, count(z) AS n_located, round(count(z) / count(*), 9) AS share_located
       FROM sellers LEFT JOIN known ON seller_zip_code_prefix = z""",
    "geolocation sellers",
)
def _(t):
    lookup = geo.build_geo_lookup(t.role("geolocation").where("geolocation_state = 'debit'"))
    return _round(recipes.geo_coverage(t.role("sellers"), "seller_zip_code_prefix", lookup), share_located=9)


@query(
    "x6_unlocated_sellers",
    """SELECT seller_id, seller_state FROM sellers WHERE seller_zip_code_prefix NOT IN
       (SELECT geolocation_zip_code_prefix FROM geolocation WHERE geolocation_city = 'HOUSEHOLD' AND geolocation_lat > 49)""",
    "geolocation sellers",
)
def _(t):
    rich = t.role("geolocation").where("geolocation_city = 'HOUSEHOLD' AND geolocation_lat > 49")
    return recipes.unlocated(t.role("sellers"), "seller_zip_code_prefix", geo.build_geo_lookup(rich)).select("seller_id", "seller_state")


@query(
    "x7_display_label",
    """SELECT p_partkey AS product_category_name, array_to_string(list_transform(split(replace(lower(p_name), ' ', '_'), '_'),
       lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM part""",
)
def _(t):
    names = t.read("part").selectExpr("p_partkey AS product_category_name", "replace(lower(p_name), ' ', '_') AS product_category_name_english")
    return recipes.category_labels(names)


@query(
    "x8_payment_mix",
    """SELECT payment_type, count(*) AS n_payments, round(sum(payment_value), 2) AS value,
       round(sum(payment_value) / (SELECT sum(payment_value) FROM payments), 6) AS value_share,
       round(avg(payment_installments), 9) AS mean_installments FROM payments GROUP BY 1""",
    "payments",
)
def _(t):
    return _round(recipes.payment_mix(t.role("payments")), value=2, value_share=6, mean_installments=9)


@query(
    "x8_installment_distribution",
    "SELECT payment_installments, count(*) AS n_payments FROM payments GROUP BY 1",
    "payments",
)
def _(t):
    return recipes.installment_distribution(t.role("payments"))


@query(
    "x9_order_spend",
    """SELECT count(DISTINCT order_id) AS n_orders, count(*) AS n_items,
       round(count(*) / count(DISTINCT order_id), 9) AS items_per_order, round(sum(price), 2) AS revenue,
       round(sum(price) + sum(freight_value), 2) AS total_spend,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM items GROUP BY order_id)) AS max_items FROM items""",
    "items",
)
def _(t):
    return _round(recipes.order_spend(t.role("items")), items_per_order=9, revenue=2, total_spend=2)


@query(
    "x10_shipping_routes",
    """WITH l AS (SELECT geolocation_zip_code_prefix AS z, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng
                  FROM geolocation GROUP BY 1),
       d AS (SELECT customer_state, seller_state, 12742.0 * asin(sqrt(least(1.0,
               pow(sin(radians(s.lat - c.lat) / 2), 2)
               + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - c.lng) / 2), 2)))) AS km
             FROM items JOIN purchases USING (order_id) JOIN customers USING (customer_id) JOIN sellers USING (seller_id)
             LEFT JOIN l c ON customer_zip_code_prefix = c.z LEFT JOIN l s ON seller_zip_code_prefix = s.z)
       SELECT customer_state, count(*) AS n_items, count(*) FILTER (WHERE customer_state <> seller_state) AS n_cross_state,
       round(avg(km), 4) AS mean_km FROM d GROUP BY 1""",
    "geolocation items purchases customers sellers",
)
def _(t):
    return _round(recipes.shipping_routes(t.model, geo.build_geo_lookup(t.role("geolocation"))), mean_km=4)


@query(
    "x11_revenue_by_cluster",
    """WITH r AS (SELECT lower(product_category_name) AS category, sum(price) AS revenue FROM items JOIN products USING (product_id) GROUP BY 1)
       SELECT CASE WHEN category IN ('economy', 'small') THEN 'entry' WHEN category IN ('standard', 'medium', 'large') THEN 'core' END AS cluster,
       round(sum(revenue), 2) AS revenue, count(*) AS n_categories FROM r WHERE category <> 'promo' GROUP BY 1""",
    "items products",
)
def _(t):
    clusters = {"economy": "entry", "small": "entry", "standard": "core", "medium": "core", "large": "core"}
    return _round(recipes.revenue_by_cluster(recipes.revenue_with_untranslated(t.model), clusters), revenue=2)


@query(
    "x12_seasonality",
    f"""WITH s AS (SELECT product_category_name_english AS category, strftime(order_purchase_timestamp, '%Y-%m') AS month,
          count(*) AS n_items, sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) / 100 AS revenue FROM {_JOINED} GROUP BY 1, 2)
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_items DESC, month) AS items_rank,
        row_number() OVER (PARTITION BY category ORDER BY revenue DESC, month) AS revenue_rank FROM s""",
    _LINES,
)
def _(t):
    return recipes.seasonality(t.model)
