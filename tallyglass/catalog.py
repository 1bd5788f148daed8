"""Declared semantic layer: terms, measures, join policy and glossary."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# ---------------------------------------------------------------- fixed values
# Names, texts and defaults below are part of the governed contract.

REFERENCE_DATE = dt.date(2018, 10, 17)

TERMS = {
    "revenue": {"source_table": "fact_order_items", "grain": "item"},
    "aov": {"source_table": "fact_order_items", "grain": "order"},
    "seller_rating": {"source_table": "fact_order_reviews", "grain": "review"},
    "return_rate": {"source_table": "fact_orders", "grain": "order"},
}

REGIONS = {
    "south": ["RS", "SC", "PR"],
    "southeast": ["SP", "RJ", "MG", "ES"],
    "north": ["AM", "PA", "RO", "RR", "AC", "AP", "TO"],
}

TIME_PERIODS = ["last_quarter", "last_month", "this_year"]
FUZZY_TERMS = ["top", "underperforming", "high"]
DEFAULT_TOP_N = 10
MIN_REVIEWS = 5
MAX_ROWS = 1000
MAX_ROWS_RANGE = (1, 10_000)

# (from, to, on, grain, safe, note)
JOIN_POLICY = [
    ("fact_order_items", "dim_products", "product_id", "item", True, None),
    ("dim_products", "dim_category_translation", "product_category_name", "item", True, None),
    ("fact_order_items", "fact_orders", "order_id", "item", True, None),
    ("fact_orders", "dim_customers", "customer_id", "order", True, None),
    ("fact_order_reviews", "fact_orders", "order_id", "review", True, None),
    ("fact_order_items", "dim_sellers", "seller_id", "item", True, None),
    (
        "fact_order_items",
        "fact_order_payments",
        "order_id",
        "item",
        False,
        "FORBIDDEN for revenue measures. payments has multiple rows per order (installments/split). "
        "Causes fan-out. This is the join the guardrail must reject.",
    ),
]

# measure -> parameters: (name, kind, category or type, required, default)
MEASURES = {
    "top_categories_by_revenue": [
        ("date_filter", "glossary", "time_periods", False, ""),
        ("top_n", "scalar", "integer", False, "10"),
    ],
    "aov_by_state": [],
    "seller_ratings_by_state": [
        ("date_filter", "glossary", "time_periods", False, ""),
        ("state_filter", "glossary", "regions", False, ""),
        ("top_n", "scalar", "integer", False, "10"),
    ],
    "return_rate_by_category": [
        ("category", "scalar", "string", True, None),
    ],
}

MEASURE_THRESHOLD = 0.5
REVIEW_GATE = 0.7
# ------------------------------------------------------------ end fixed values

PARAM_STRUCT = "array<struct<name:string,kind:string,category:string,required:boolean,default:string>>"


@dataclass(frozen=True)
class Catalog:
    """One deployment's semantic layer. Defaults are the governed values above."""

    reference_date: dt.date = REFERENCE_DATE
    regions: dict = field(default_factory=lambda: dict(REGIONS))
    terms: dict = field(default_factory=lambda: dict(TERMS))
    join_policy: list = field(default_factory=lambda: list(JOIN_POLICY))
    measures: dict = field(default_factory=lambda: dict(MEASURES))
    # measure -> text with {placeholders}; only the contract check reads it
    templates: dict = field(default_factory=dict)

    def known_tables(self) -> list[str]:
        names = {t for edge in self.join_policy for t in edge[:2]}
        names |= {t["source_table"] for t in self.terms.values()}
        return sorted(names)

    def unsafe_joins(self) -> list[tuple[str, str, str]]:
        return [(e[0], e[1], e[5] or "forbidden join") for e in self.join_policy if not e[4]]

    def glossary_keys(self) -> dict[str, list[str]]:
        """Namespace -> keys that carry a filter."""
        return {"time_periods": list(TIME_PERIODS), "regions": list(self.regions)}

    def metadata_keys(self) -> dict[str, list[str]]:
        """Namespace -> keys that exist but carry no filter."""
        return {"time_periods": ["dataset_reference_date"], "fuzzy_terms": list(FUZZY_TERMS)}

    def measure_table(self, spark: SparkSession) -> DataFrame:
        """One row per measure with its declared parameters."""
        rows = [(m, [tuple(p[:3]) + (p[3], p[4]) for p in params]) for m, params in self.measures.items()]
        return spark.createDataFrame(rows, f"measure string, params {PARAM_STRUCT}")

    def template_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (m, self.templates.get(m, ""), [p[0] for p in params]) for m, params in self.measures.items()
        ]
        return spark.createDataFrame(rows, "measure string, template string, declared array<string>")
