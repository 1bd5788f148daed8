"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (comma
separated name prefixes, or "all" for every registered query).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyglass.session import build_session  # noqa: E402
from tallyglass.workload import QUERIES  # noqa: E402

HEADLINES = [
    "m1_top_categories_by_revenue",
    "m1_top_categories_last_quarter",
    "m2_aov_by_state",
    "m3_seller_ratings_by_state",
    "m3_seller_ratings_window_region",
    "m5_return_rate_all",
    "w2_check_pk",
    "w3_check_fk",
    "w4_latest_per_key",
    "w7_geo_lookup",
    "w9_fanout_audit",
    "g4_underperforming",
    "g10_parameters_applied",
    "q5_audit_sql",
    "d1_parse_selections",
    "d9_render_context",
    "c6_chunk_documents",
    "c11_chunk_overlap",
    "v7_nearest_neighbours",
    "v11_inverted_index",
    "v12_bm25_scores",
    "v13_filtered_top_with_fill",
    "v16_retrieve",
    "e7_measure_eval_summary",
    "e10_retrieval_summary",
    "e17_scorecard",
    "x10_shipping_routes",
    "x12_seasonality",
]


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to compute every row and column of a query; nothing is collected."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "")
    names = HEADLINES
    if only == "all":
        names = list(QUERIES)
    elif only:
        names = [n for n in QUERIES if n.startswith(tuple(only.split(",")))]
    spark = build_session("bench", cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the executors before the clock
    seconds = {name: round(run(spark, name, sf_dir), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
