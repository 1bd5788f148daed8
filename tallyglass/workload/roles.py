"""The test tables in the roles of the star schema, the corpus and the model outputs.

A role is a projection written once in SQL that both engines read, so an operator and its twin start
from the same rows.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyglass.catalog import Catalog
from tallyglass.sources.splits import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

REFERENCE_DATE = dt.date(2001, 6, 15)
RETURNED = ("P",)

_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# Statements by kind; {n} is the row's own number. Kinds 0-6 break one rule each, 7-9 none, 10 and 11 several.
_STATEMENTS = [
    ("joins_safe", "concat('SELECT SUM(oi.price) AS revenue FROM fact_order_items oi JOIN fact_order_payments pay ON oi.order_id = pay.order_id WHERE oi.order_id = ', {n}, ' LIMIT 1000')"),
    ("is_read_only", "concat('UPDATE fact_orders SET order_status = ''shipped'' WHERE order_id = ', {n}, ' LIMIT 5')"),
    ("schema_valid", "concat('SELECT * FROM ghost_table_', {n}, ' LIMIT 10')"),
    ("row_limit_enforced", "concat('SELECT order_id FROM fact_orders WHERE order_id > ', {n})"),
    ("row_limit_enforced", "concat('SELECT order_id FROM fact_orders LIMIT ', CAST(99999 + o_orderkey AS STRING))"),
    ("is_read_only", "concat('SELECT order_id FROM fact_orders LIMIT 10; DROP TABLE fact_orders -- ', {n})"),
    ("is_read_only", "concat('delete from fact_orders where order_id = ''', {n}, ''' LIMIT 1')"),
    ("joins_safe", "concat('SELECT customer_state, SUM(price) FROM fact_order_items i JOIN fact_orders o ON i.order_id = o.order_id JOIN dim_customers c ON o.customer_id = c.customer_id GROUP BY customer_state LIMIT ', CAST(1 + o_orderkey % 1000 AS STRING))"),
    ("schema_valid", "concat('select seller_id, avg(review_score) from fact_order_reviews r join fact_orders o on r.order_id = o.order_id join fact_order_items i on o.order_id = i.order_id join dim_sellers s on i.seller_id = s.seller_id group by seller_id having count(*) >= 5 limit ', {n})"),
    ("row_limit_enforced", "concat('SELECT product_id FROM dim_products p JOIN dim_category_translation t ON p.product_category_name = t.product_category_name', chr(10), 'LIMIT', chr(10), '  00', CAST(o_orderkey % 1500 AS STRING))"),
    ("is_read_only", "concat('INSERT INTO audit_log SELECT * FROM raw_orders JOIN geo_lookup ON zip = ', {n}, '; TRUNCATE audit_log; insert into x values (1)')"),
    ("joins_safe", "concat('SELECT created_at, EXTRACT(YEAR FROM order_purchase_timestamp) FROM fact_orders LIMIT -', {n})"),
]
_FRAGMENTS = [
    "Forbidden join detected|fact_order_items -> fact_order_payments",
    "Write operation not allowed|UPDATE",
    "Unknown table referenced|ghost_table",
    "No LIMIT clause",
    "exceeds max_rows",
    "Write operation not allowed|DROP",
    "Write operation not allowed|DELETE",
    "Forbidden join detected",
    "Unknown table referenced",
    "exceeds max_rows",
    "Write operation not allowed|INSERT, TRUNCATE",
    "Forbidden join detected",
]


def _case(on: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values[:-1]))
    return f"CASE {on} {arms} ELSE {values[-1]} END"


def _text(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


_N = "CAST(o_orderkey AS STRING)"
_KIND = "o_orderkey % 12"
_MEASURE_NAMES = ["top_categories_by_revenue", "aov_by_state", "seller_ratings_by_state", "return_rate_by_category"]
_CATEGORY = (
    "CASE event_type WHEN 'view' THEN 'sql_positive' WHEN 'click' THEN 'rag_positive' "
    "WHEN 'purchase' THEN 'hybrid_positive' WHEN 'signup' THEN 'sql_oos' ELSE 'rag_oos' END"
)
_ROUTE = "CASE event_type WHEN 'view' THEN 'sql' WHEN 'click' THEN 'rag' WHEN 'purchase' THEN 'hybrid' WHEN 'signup' THEN 'sql' ELSE 'rag' END"
_WANTED = "CASE WHEN event_type IN ('view', 'purchase') THEN " + _case("event_id % 4", [_text(m) for m in _MEASURE_NAMES]) + " END"
_REFS = [
    "", "time_periods.last_quarter", "time_periods.last_quarter,regions.south",
    "time_periods.last_month,time_periods.this_year", "regions.west", "time_periods.dataset_reference_date",
    "regions.south,regions.north", "fuzzy_terms.top,time_periods.next_week",
]

# role -> (table, columns, condition)
ROLES: dict[str, tuple[str, list[str], str | None]] = {
    "items": (
        "lineitem",
        [
            "l_orderkey AS order_id",
            "l_linenumber AS order_item_id",
            "l_partkey AS product_id",
            "l_suppkey AS seller_id",
            "l_extendedprice AS price",
            "floor(l_extendedprice * l_tax * 100 + 0.5) / 100 AS freight_value",
            "l_shipdate AS shipping_limit_date",
        ],
        None,
    ),
    "purchases": (
        "orders",
        [
            "o_orderkey AS order_id",
            "o_custkey AS customer_id",
            "o_orderstatus AS order_status",
            "o_orderdate AS order_purchase_timestamp",
            "o_totalprice AS order_total",
        ],
        None,
    ),
    "products": ("part", ["p_partkey AS product_id", "p_type AS product_category_name"], None),
    "reviews": (
        "events",
        [
            "event_id AS review_id",
            "event_id AS order_id",
            "CAST(least(5, 1 + floor(value / 25)) AS BIGINT) AS review_score",
            "ts AS review_answer_timestamp",
        ],
        None,
    ),
    "payments": (
        "events",
        [
            "user_id AS order_id",
            "event_id AS payment_sequential",
            "event_type AS payment_type",
            f"CAST(1 + {_K} % 12 AS BIGINT) AS payment_installments",
            "value AS payment_value",
        ],
        None,
    ),
    "statements": (
        "orders",
        [
            "o_orderkey AS stmt_id",
            _case(_KIND, [s.replace("{n}", _N) for _, s in _STATEMENTS]) + " AS sql",
            _case(_KIND, [_text(t) for t, _ in _STATEMENTS]) + " AS target_layer",
            _case(_KIND, [_text(f) for f in _FRAGMENTS]) + " AS fragments",
            "CASE WHEN o_orderkey % 5 = 0 THEN 500 ELSE 1000 END AS max_rows",
        ],
        None,
    ),
    # One model selection per event.
    "selections": (
        "events",
        [
            "event_id AS selection_id",
            _case("event_id % 5", [_text(m) for m in [*_MEASURE_NAMES, "profit_by_moon"]]) + " AS measure",
            _case(f"{_K} % 8", [_text(r) for r in _REFS]) + " AS refs",
            _case(f"{_K} % 7", ["NULL", "'5'", "' 12 '", "'abc'", "'3.5'", "'-7'", "'1_000'"]) + " AS top_n",
            f"CASE WHEN {_K} % 3 <> 0 THEN event_type END AS category",
        ],
        None,
    ),
    # One labelled case with its observed outputs per event.
    "cases": (
        "events",
        [
            "event_id AS case_id",
            f"{_CATEGORY} AS category",
            f"{_ROUTE} AS expected_route",
            f"CASE WHEN {_K} % 10 = 0 THEN 'hybrid' WHEN {_K} % 10 = 1 THEN 'sql' WHEN {_K} % 10 = 2 THEN 'rag' ELSE {_ROUTE} END AS actual_route",
            f"{_WANTED} AS expected_measure",
            f"CASE WHEN {_K} % 7 = 0 THEN NULL WHEN {_K} % 11 = 0 THEN 'aov_by_state' WHEN event_type = 'signup' THEN 'return_rate_by_category' ELSE {_WANTED} END AS raw_measure",
            f"CAST({_K} AS DOUBLE) / 100 AS raw_confidence",
            f"CASE WHEN {_K} % 4 = 0 THEN 'time_periods.last_quarter' ELSE 'time_periods.last_quarter,regions.south' END AS expected_refs",
            f"CASE WHEN {_K} % 6 = 0 THEN 'last_quarter' WHEN {_K} % 6 = 1 THEN 'regions.south,regions.north' ELSE 'south,last_quarter' END AS actual_refs",
            "CASE WHEN event_type IN ('signup') THEN 'no_measure_matched' END AS expected_status",
            "event_type = 'error' AS expects_hedge",
            "least(1.0, floor(value * 4) / 100) AS confidence",
            f"{_K} % 3 % 2 AS revision_count",
            "user_id AS run_group",
        ],
        None,
    ),
    # Raw model output text, some fenced, some broken.
    "outputs": (
        "events",
        [
            "event_id AS output_id",
            "concat("
            f"CASE WHEN {_K} % 4 = 0 THEN concat('```json', chr(10)) WHEN {_K} % 4 = 1 THEN '  ```' ELSE ' ' END, "
            "'{\"measure\": \"', " + _case(f"{_K} % 5", [_text(m) for m in [*_MEASURE_NAMES, "profit_by_moon"]]) + ", "
            "'\", \"glossary_refs\": [\"time_periods.last_month\"], \"filters\": {\"top_n\": \"', "
            f"CAST({_K} AS STRING), '\"}}', "
            f"CASE WHEN {_K} % 9 = 0 THEN '' ELSE ', \"reasoning\": \"fits\"' END, "
            f"', \"confidence\": ', CASE WHEN {_K} % 13 = 0 THEN '1.5' ELSE concat('0.', lpad(CAST({_K} AS STRING), 2, '0')) END, "
            f"CASE WHEN {_K} % 17 = 0 THEN '' ELSE '}}' END, "
            f"CASE WHEN {_K} % 4 < 2 THEN concat(chr(10), '```') ELSE '' END) AS output",
            f"{_K} AS k",
        ],
        None,
    ),
    "passages": ("documents", ["doc_id AS chunk_id", "lang AS doc_type", "source", "text AS content"], None),
    "asked": ("benchmark", ["item_id AS query_id", "text"], None),
    # Markdown made from a text: the first word of each further line becomes an H2 title.
    "markdown": (
        "documents",
        [
            "CAST(doc_id AS STRING) AS source",
            "lang AS doc_type",
            "concat(CASE WHEN doc_id % 3 = 0 THEN concat('# ', source, ' notes', chr(10), chr(10)) WHEN doc_id % 3 = 1 THEN concat('# ', source, chr(10), '## Start', chr(10)) ELSE '' END, {headed}) AS content",
        ],
        None,
    ),
}

# Roles whose rows feed costly expressions: columns to read, the first one spreads the rows.
_COSTLY = {
    "passages": ["doc_id", "text", "lang", "source"],
    "markdown": ["doc_id", "text", "lang", "source"],
    "statements": ["o_orderkey"],
    "outputs": ["event_id", "props"],
    "selections": ["event_id", "event_type", "props"],
}

# Role text that is not a plain projection.
_JOINED = {
    "translation": "SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english FROM part WHERE p_type <> 'PROMO'",
    "customers": "SELECT c_custkey AS customer_id, c_nationkey * 1000 + c_custkey % 700 AS customer_unique_id, c_nationkey AS customer_zip_code_prefix, c_mktsegment AS customer_city, n_name AS customer_state FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "sellers": "SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix, n_name AS seller_state, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "geolocation": "SELECT c_nationkey AS geolocation_zip_code_prefix, c_acctbal / 203 AS geolocation_lat, c_acctbal / 97 - 40 AS geolocation_lng, c_mktsegment AS geolocation_city, CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS geolocation_state FROM customer",
}

_HEADED = {
    "spark": r"regexp_replace(text, '\n([^ \n]+) ', '\n## $1\n')",
    "duckdb": r"regexp_replace(text, '\n([^ \n]+) ', E'\n## \\1\n', 'g')",
}


def role_sql(name: str, engine: str) -> str:
    if name in _JOINED:
        return _JOINED[name]
    table, cols, where = ROLES[name]
    text = f"SELECT {', '.join(c.replace('{headed}', _HEADED[engine]) if name == 'markdown' else c for c in cols)} FROM {table}"
    return text + (f" WHERE {where}" if where else "")


def with_roles(names: list[str], body: str) -> str:
    """``body`` with the named roles in front as common table expressions."""
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({role_sql(n, 'duckdb')})" for n in names)
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"


class Tables:
    """The given tables and their roles as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def role(self, name: str) -> DataFrame:
        if name in _JOINED:
            return getattr(self, f"_{name}")()
        table, cols, where = ROLES[name]
        df = self.read(table)
        if where:
            df = df.where(where)
        if name in _COSTLY:
            df = spread(df.select(*_COSTLY[name]), _COSTLY[name][0])
        return df.selectExpr(*[c.replace("{headed}", _HEADED["spark"]) if name == "markdown" else c for c in cols])

    def _translation(self) -> DataFrame:
        kinds = self.read("part").where("p_type <> 'PROMO'").select("p_type").distinct()
        return kinds.selectExpr("p_type AS product_category_name", "lower(p_type) AS product_category_name_english")

    def _customers(self) -> DataFrame:
        nation = self.read("nation").select("n_nationkey", "n_name")
        joined = self.read("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.selectExpr(
            "c_custkey AS customer_id",
            "c_nationkey * 1000 + c_custkey % 700 AS customer_unique_id",
            "c_nationkey AS customer_zip_code_prefix",
            "c_mktsegment AS customer_city",
            "n_name AS customer_state",
        )

    def _sellers(self) -> DataFrame:
        places = self.read("nation").join(self.read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        joined = self.read("supplier").join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.selectExpr(
            "s_suppkey AS seller_id", "s_nationkey AS seller_zip_code_prefix", "n_name AS seller_state", "r_name AS region"
        )

    def _geolocation(self) -> DataFrame:
        return self.read("customer").selectExpr(
            "c_nationkey AS geolocation_zip_code_prefix",
            "c_acctbal / 203 AS geolocation_lat",
            "c_acctbal / 97 - 40 AS geolocation_lng",
            "c_mktsegment AS geolocation_city",
            "CASE WHEN c_acctbal < 0 THEN 'debit' ELSE 'credit' END AS geolocation_state",
        )

    @cached_property
    def model(self) -> dict[str, DataFrame]:
        return {
            "dim_customers": self.role("customers"),
            "dim_sellers": self.role("sellers"),
            "dim_products": self.role("products"),
            "dim_category_translation": self.role("translation"),
            "fact_orders": self.role("purchases"),
            "fact_order_items": self.role("items"),
            "fact_order_payments": self.role("payments"),
            "fact_order_reviews": self.role("reviews"),
        }

    @cached_property
    def catalog(self) -> Catalog:
        """Governed values with this data's reference date and regions (25 fixed nations in 5 regions)."""
        europe = [f"NATION_{i}" for i in range(3, 25, 5)]
        asia = [f"NATION_{i}" for i in range(2, 25, 5)]
        return Catalog(reference_date=REFERENCE_DATE, regions={"europe": europe, "asia": asia})

    def selections(self) -> DataFrame:
        """Selections with array and map columns."""
        return self.role("selections").selectExpr(
            "selection_id",
            "measure",
            "filter(split(refs, ','), x -> x <> '') AS glossary_refs",
            "map_filter(map('top_n', top_n, 'category', category), (k, v) -> v IS NOT NULL) AS filters",
        )

    def cases(self) -> DataFrame:
        return (
            self.role("cases")
            .withColumn("expected_glossary", F.split("expected_refs", ","))
            .withColumn("glossary_refs", F.split("actual_refs", ","))
        )
