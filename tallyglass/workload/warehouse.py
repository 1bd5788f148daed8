"""Sources, sinks, keys and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyglass.operators import fanout, geo, keys, latest
from tallyglass.plans import star
from tallyglass.session import shared_dir
from tallyglass.sources import landing
from tallyglass.workload.registry import query
from tallyglass.workload.roles import TABLES

_N_COLS = dict(
    region=2, nation=3, customer=5, supplier=4, part=6, orders=6, lineitem=11, events=6, documents=5,
    embeddings=3, pages=3, benchmark=2, labels=3, conversations=4,
)


@query(
    "s1_land_csv",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
              strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
)
def _(t):
    root = shared_dir(t.spark)
    text = t.read("orders").withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    text.write.option("header", True).csv(f"{root}/orders.csv")
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string"
    landed = landing.land_csv(t.spark, root, {"orders": schema})
    landing.save_raw(landed, root)
    return t.spark.read.parquet(f"{root}/raw_orders")


@query(
    "s2_table_counts",
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, {_N_COLS[n]}::BIGINT AS n_cols FROM {n}" for n in TABLES
    ),
)
def _(t):
    return landing.table_counts({n: t.read(n) for n in TABLES})


@query("s3_audit_landing")
def _(t):
    audit = landing.audit_landing(t.spark, t.dir)
    return audit.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", "ok")


@query(
    "s9_duplicate_case_ids",
    "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t):
    return keys.duplicate_keys(t.read("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "w1_build_star",
    """SELECT 'dim_customers' AS table_name, count(*) AS n_rows, 5::BIGINT AS n_cols FROM customers
       UNION ALL SELECT 'dim_sellers', count(*), 4 FROM sellers
       UNION ALL SELECT 'dim_products', count(*), 2 FROM products
       UNION ALL SELECT 'dim_category_translation', count(*), 2 FROM translation
       UNION ALL SELECT 'fact_orders', count(*), 5 FROM purchases
       UNION ALL SELECT 'fact_order_items', count(*), 7 FROM items
       UNION ALL SELECT 'fact_order_payments', count(*), 5 FROM payments
       UNION ALL SELECT 'fact_order_reviews', count(DISTINCT user_id), 4 FROM events""",
    "customers sellers products translation purchases items payments",
)
def _(t):
    return landing.table_counts(star.build_star(_raw(t)))


def _raw(t):
    m = t.model
    return {
        "customers": m["dim_customers"],
        "sellers": m["dim_sellers"],
        "products": m["dim_products"],
        "category_translation": m["dim_category_translation"],
        "orders": m["fact_orders"],
        "order_items": m["fact_order_items"],
        "order_payments": m["fact_order_payments"],
        # One review per user here, so that the raw reviews hold duplicates.
        "order_reviews": t.read("events").selectExpr(
            "user_id AS review_id", "event_id AS order_id", "1 AS review_score", "ts AS review_answer_timestamp"
        ),
    }


@query(
    "w1_star_reviews",
    """SELECT user_id AS review_id, event_id AS order_id, 1 AS review_score, ts AS review_answer_timestamp FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) = 1""",
)
def _(t):
    return star.build_star(_raw(t))["fact_order_reviews"]


@query(
    "w1_star_content",
    " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, count(*) AS n_rows, count(DISTINCT md5(concat_ws('|', {cols}))) AS n_distinct, "
        f"max(md5(concat_ws('|', {cols}))) AS last_digest FROM {role}"
        for table, role, cols in (
            ("dim_customers", "customers", "customer_id, customer_unique_id, customer_zip_code_prefix, customer_city, customer_state"),
            ("dim_sellers", "sellers", "seller_id, seller_zip_code_prefix, seller_state, region"),
            ("dim_products", "products", "product_id, product_category_name"),
            ("dim_category_translation", "translation", "product_category_name, product_category_name_english"),
            ("fact_orders", "purchases", "order_id, customer_id, order_status"),
            ("fact_order_items", "items", "order_id, order_item_id, product_id, seller_id"),
            ("fact_order_payments", "payments", "order_id, payment_sequential, payment_type, payment_installments"),
        )
    ),
    "customers sellers products translation purchases items payments",
)
def _(t):
    columns = {
        "dim_customers": ["customer_id", "customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state"],
        "dim_sellers": ["seller_id", "seller_zip_code_prefix", "seller_state", "region"],
        "dim_products": ["product_id", "product_category_name"],
        "dim_category_translation": ["product_category_name", "product_category_name_english"],
        "fact_orders": ["order_id", "customer_id", "order_status"],
        "fact_order_items": ["order_id", "order_item_id", "product_id", "seller_id"],
        "fact_order_payments": ["order_id", "payment_sequential", "payment_type", "payment_installments"],
    }
    built, out = star.build_star(_raw(t)), None
    for table, cols in columns.items():
        # Folded per digest first, so that the distinct count costs no second shuffle of rows.
        per = built[table].groupBy(F.md5(F.concat_ws("|", *cols)).alias("d")).agg(F.count("*").alias("n"))
        one = per.agg(
            F.lit(table).alias("table_name"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
            F.count("*").alias("n_distinct"), F.max("d").alias("last_digest"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def _pk_sql(table, cols):
    c = ", ".join(cols)
    some_null = " OR ".join(f"{x} IS NULL" for x in cols)
    return f"""SELECT '{table}' AS table_name, sum(n)::BIGINT AS n_rows,
      coalesce(sum(CASE WHEN {some_null} THEN n END), 0)::BIGINT AS n_null,
      count(CASE WHEN NOT ({some_null}) AND n > 1 THEN 1 END) AS n_dup_keys,
      coalesce(sum(CASE WHEN NOT ({some_null}) AND n > 1 THEN n END), 0)::BIGINT AS n_dup_rows,
      coalesce(sum(CASE WHEN {some_null} OR n > 1 THEN n END), 0) = 0 AS ok
      FROM (SELECT {c}, count(*) AS n FROM {table} GROUP BY {c})"""


_PKS = [
    ("lineitem", ["l_orderkey", "l_linenumber"]), ("orders", ["o_orderkey"]), ("customer", ["c_custkey"]),
    ("part", ["p_partkey"]), ("supplier", ["s_suppkey"]), ("events", ["event_id"]), ("events", ["user_id"]),
    ("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"]), ("conversations", ["conv_id"]),
]


@query(
    "w2_check_pk",
    " UNION ALL ".join(f"SELECT '{'+'.join(c)}' AS key_cols, * FROM ({_pk_sql(n, c)})" for n, c in _PKS),
)
def _(t):
    return star._stack(
        [
            keys.check_pk(t.read(n), c, n).select(F.lit("+".join(c)).alias("key_cols"), "*")
            for n, c in _PKS
        ]
    )


_FKS = [
    ("lines_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lines_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ("lines_supplier", "lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey"),
    ("orders_with_lines", "orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("vectors_document", "embeddings", "vec_id", "documents", "doc_id"),
    ("labels_document", "labels", "doc_id", "documents", "doc_id"),
    ("documents_label", "documents", "doc_id", "labels", "doc_id"),
]


@query(
    "w3_check_fk",
    " UNION ALL ".join(
        f"""SELECT '{name}' AS constraint_name, count(DISTINCT c.{cc}) AS n_orphan_keys,
        count(*) AS n_orphan_rows, count(*) = 0 AS ok
        FROM {child} c WHERE c.{cc} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{pc} = c.{cc})"""
        for name, child, cc, parent, pc in _FKS
    ),
)
def _(t):
    return star._stack(
        [keys.check_fk(t.read(c), [cc], t.read(p), [pc], name) for name, c, cc, p, pc in _FKS]
    )


@query(
    "w4_latest_per_key",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d') AS shipped
       FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
             ORDER BY l_shipdate DESC NULLS LAST, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(t):
    lines = t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    one = latest.latest_per_key(lines, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey"])
    return one.withColumn("shipped", F.date_format("l_shipdate", "yyyy-MM-dd")).drop("l_shipdate")


_MODAL = """SELECT geolocation_zip_code_prefix AS zip_prefix, geolocation_city AS city, geolocation_state AS state, freq
  FROM (SELECT *, row_number() OVER (PARTITION BY geolocation_zip_code_prefix
        ORDER BY freq DESC, geolocation_city, geolocation_state) AS rn
        FROM (SELECT geolocation_zip_code_prefix, geolocation_city, geolocation_state, count(*) AS freq
              FROM geolocation GROUP BY ALL)) WHERE rn = 1"""


@query("w5_modal_label", _MODAL, "geolocation")
def _(t):
    out = geo.modal_label(t.role("geolocation"), "geolocation_zip_code_prefix", ["geolocation_city", "geolocation_state"])
    return out.toDF("zip_prefix", "city", "state", "freq")


@query(
    "w6_centroid",
    """SELECT geolocation_zip_code_prefix AS zip_prefix, round(avg(geolocation_lat), 6) AS lat,
       round(avg(geolocation_lng), 6) AS lng FROM geolocation GROUP BY 1""",
    "geolocation",
)
def _(t):
    out = geo.centroid(t.role("geolocation"), "geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng")
    return out.select(
        F.col("geolocation_zip_code_prefix").alias("zip_prefix"), F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng")
    )


_LOOKUP = f"""lookup AS (SELECT zip_prefix, lat, lng, city, state FROM ({_MODAL}) JOIN
  (SELECT geolocation_zip_code_prefix AS zip_prefix, avg(geolocation_lat) AS lat, avg(geolocation_lng) AS lng
   FROM geolocation GROUP BY 1) USING (zip_prefix))"""


@query(
    "w7_geo_lookup",
    f"WITH {_LOOKUP} SELECT zip_prefix, round(lat, 6) AS lat, round(lng, 6) AS lng, city, state FROM lookup",
    "geolocation",
)
def _(t):
    lookup = geo.build_geo_lookup(t.role("geolocation"))
    return lookup.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@query(
    "w8_reconcile",
    f"""WITH {_LOOKUP} SELECT count(*) AS raw_rows, count(DISTINCT geolocation_zip_code_prefix) AS distinct_keys,
        (SELECT count(*) FROM lookup) AS lookup_rows,
        count(DISTINCT geolocation_zip_code_prefix) = (SELECT count(*) FROM lookup) AS ok FROM geolocation""",
    "geolocation",
)
def _(t):
    raw = t.role("geolocation")
    return geo.reconcile(raw, geo.build_geo_lookup(raw), "geolocation_zip_code_prefix")


@query(
    "w8_sample_head",
    f"""WITH {_LOOKUP} SELECT zip_prefix, round(lat, 4) AS lat, round(lng, 4) AS lng, city, state FROM lookup
        ORDER BY zip_prefix LIMIT 5""",
    "geolocation",
)
def _(t):
    return geo.sample_head(geo.build_geo_lookup(t.role("geolocation")))


@query(
    "w9_fanout_audit",
    """SELECT round((SELECT sum(cast(floor(order_total * 100 + 0.5) AS BIGINT)) FROM purchases) / 100, 2) AS true_total,
       round(sum(cast(floor(order_total * 100 + 0.5) AS BIGINT)) / 100, 2) AS joined_total,
       round(sum(order_total) / (SELECT sum(order_total) FROM purchases), 6) AS inflation,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM items JOIN purchases USING (order_id) GROUP BY order_id)) AS max_multiplicity
       FROM purchases JOIN items USING (order_id)""",
    "purchases items",
)
def _(t):
    out = fanout.fanout_audit(t.role("purchases"), t.role("items"), ["order_id"], "order_total")
    return out.withColumns(
        {
            "true_total": F.round("true_total", 2),
            "joined_total": F.round("joined_total", 2),
            "inflation": F.round("inflation", 6),
        }
    )


@query(
    "w10_pre_aggregate_then_join",
    """SELECT order_id, order_total, round(sum(price), 2) AS items_total
       FROM purchases JOIN items USING (order_id) GROUP BY order_id, order_total""",
    "purchases items",
)
def _(t):
    out = fanout.pre_aggregate_then_join(t.role("purchases"), t.role("items"), ["order_id"], "price", "items_total")
    return out.select("order_id", "order_total", F.round("items_total", 2).alias("items_total"))
