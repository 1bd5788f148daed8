import random

import pytest
from pyspark.sql import functions as F

from tallyglass.functions.joins import bounded_join, split_hot_join
from tallyglass.functions.vectors import cosine_distance, text_to_vec, vec_to_text
from tallyglass.operators import fanout, geo, keys
from tallyglass.operators.latest import latest_per_key
from tallyglass.operators.profile import profile_result
from tallyglass.operators.quantile import exact_quantile
from tallyglass.plans import measures, star
from tallyglass.plans.recipes import haversine_km


def test_latest_wins_with_null_and_equal_stamps(spark):
    rows = [("r1", None, 1), ("r1", "2018-01-01", 2), ("r2", None, 3), ("r3", "2018-01-02", 5), ("r3", "2018-01-02", 4), ("r4", "2018-01-01", 6), ("r4", "2018-02-01", 7)]
    df = spark.createDataFrame(rows, "review_id string, t string, v int").repartition(3)
    got = {r["review_id"]: r["v"] for r in latest_per_key(df, ["review_id"], "t", ["v"]).collect()}
    assert got == {"r1": 2, "r2": 3, "r3": 4, "r4": 7}


def test_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("if(id % 3 = 0, 0, id) k", "id t")
    plan = latest_per_key(df, ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange hashpartitioning") < plan.index("Partial")


def test_pk(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "a"), (2, None)], "k int, s string")
    assert tuple(keys.check_pk(df, ["k", "s"], "t").first()) == ("t", 5, 2, 1, 2, False)
    assert keys.check_pk(df.limit(0), ["k"], "t").first()["ok"] is True
    with pytest.raises(ValueError, match="duplicate key in t: 1, 'a'"):
        keys.require_unique(df, ["k", "s"], "t")
    assert keys.require_unique(df.dropDuplicates(), ["k", "s"]).count() == 4


def test_fk_lets_null_pass(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (None,), (9,), (9,)], "k int")
    parent = spark.createDataFrame([(1,), (2,)], "p int")
    assert tuple(keys.check_fk(child, ["k"], parent, ["p"], "fk").first()) == ("fk", 1, 2, False)
    assert [tuple(r) for r in keys.fk_orphans(child, ["k"], parent, ["p"]).collect()] == [(9, 2)]


def test_mode_is_of_the_pair(spark):
    rows = [(1, 0.0, 0.0, "x", "A")] * 2 + [(1, 3.0, 6.0, "x", "B")] * 2 + [(1, 0.0, 0.0, "y", "B")] * 2 + [(1, 0.0, 3.5, "w", "Z")]
    raw = spark.createDataFrame(rows, "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double, geolocation_city string, geolocation_state string")
    lookup = geo.build_geo_lookup(raw)
    r = lookup.first()
    # x is the most frequent city and B the most frequent state, but the pair decides; ties go to the smallest.
    assert (r["city"], r["state"]) == ("x", "A") and r["lat"] == pytest.approx(6 / 7)
    assert tuple(geo.reconcile(raw, lookup, "geolocation_zip_code_prefix").first()) == (7, 1, 1, True)


def test_fanout_never_makes_the_rows(spark):
    base = spark.createDataFrame([(1, 10.10), (1, 0.20), (2, 5.00), (3, 1.00)], "k int, v double")
    other = spark.range(1_000_000).selectExpr("cast(if(id < 10, 1, 2) as int) k")
    audit = fanout.fanout_audit(base, other, ["k"], "v")
    r = audit.first()
    assert r["true_total"] == 16.30 and r["joined_total"] == 10.3 * 10 + 5.0 * 999_990 and r["max_multiplicity"] == 999_990
    safe = fanout.pre_aggregate_then_join(base, base, ["k"], "v", "total")
    assert {(r["k"], r["total"]) for r in safe.collect()} == {(1, 10.30), (2, 5.0), (3, 1.0)}


def test_hot_keys_are_split_and_rows_kept(spark):
    rows = spark.range(6000).selectExpr("if(id % 3 = 0, null, if(id % 3 = 1, 0, id)) k", "id v")
    small = spark.createDataFrame([(0, "hot"), (5, "five"), (8, "eight"), (99999, "none"), (None, "null")], "k long, s string")
    for big in (rows, rows.limit(0)):
        got = split_hot_join(big, small, ["k"], parts=10)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, "k").collect()))
    # 2,000 of 6,000 rows under one key go to four shares.
    salts = split_hot_join(rows, small, ["k"], parts=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in salts and "strategy=broadcast" in salts


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 0.9999, 1.0])
def test_quantile_is_exact(spark, q):
    rng = random.Random(1)
    for values in ([1.0], [3.0, 1.0], [rng.lognormvariate(0, 9) for _ in range(5000)], [7.0] * 2000 + [float(i) for i in range(4000)], [-5.0, None, 2.5, 2.5],
                   [rng.gauss(0, 1e-9) for _ in range(2500)] + [1e12 + rng.random() for _ in range(2500)]):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
        got = df.limit(1).select(exact_quantile(df, "v", q, accuracy=50, points=8)).first()[0]
        known = sorted(v for v in values if v is not None)
        pos = q * (len(known) - 1)
        lo = int(pos)
        hi = min(lo + (pos > lo), len(known) - 1)
        assert got == pytest.approx(known[lo] + (known[hi] - known[lo]) * (pos - lo))


def test_quantile_of_nothing(spark):
    df = spark.createDataFrame([], "v double")
    assert spark.range(1).select(exact_quantile(df, "v", 0.5)).first()[0] is None


def test_salted_join_equals_the_broadcast_join(spark):
    big = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id % 50) k", "id")
    small = spark.createDataFrame([(0, "hot"), (7, "a"), (7, "b"), (99, "none")], "k long, s string")
    a, b = (bounded_join(big, small, ["k"], ["id"], n) for n in (10, 1))
    assert "BroadcastHashJoin" in a._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


# ---------------------------------------------------------------- measures


@pytest.fixture(scope="module")
def model(spark):
    items = [("o1", 1, "p1", "s1", 10.0), ("o1", 2, "p1", "s1", 10.0), ("o1", 3, "p2", "s2", 5.0), ("o2", 1, "p2", "s1", 7.5), ("o3", 1, "p3", "s2", 100.0), ("o4", 1, "p4", "s2", 50.0), ("zz", 1, "p1", "s1", 999.0)]
    return {
        "fact_order_items": spark.createDataFrame(items, "order_id string, order_item_id int, product_id string, seller_id string, price double"),
        "fact_orders": spark.createDataFrame(
            [("o1", "c1", "delivered", "2018-09-30 23:59:59"), ("o2", "c2", "canceled", "2018-10-01 00:00:00"), ("o3", "c3", "unavailable", "2018-09-01 00:00:00"), ("o4", "c1", None, "2017-01-01 00:00:00")],
            "order_id string, customer_id string, order_status string, order_purchase_timestamp string",
        ),
        "dim_products": spark.createDataFrame([("p1", "a"), ("p2", "b"), ("p3", None), ("p4", "untranslated")], "product_id string, product_category_name string"),
        "dim_category_translation": spark.createDataFrame([("a", "A"), ("b", "B")], "product_category_name string, product_category_name_english string"),
        "dim_customers": spark.createDataFrame([("c1", "u1", "SP"), ("c2", "u1", "RJ"), ("c3", "u2", "SP")], "customer_id string, customer_unique_id string, customer_state string"),
        "dim_sellers": spark.createDataFrame([("s1", "SP"), ("s2", "RS")], "seller_id string, seller_state string"),
        "fact_order_reviews": spark.createDataFrame([("r1", "o1", 1), ("r2", "o2", 5), ("r3", "o3", None), ("r4", None, 4)], "review_id string, order_id string, review_score int"),
    }


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_revenue_drops_untranslated_and_orphans(model):
    assert rows(measures.top_categories_by_revenue(model)) == [("A", 20.0), ("B", 12.5)]
    from tallyglass.catalog import REFERENCE_DATE
    from tallyglass.operators.glossary import time_window

    assert rows(measures.top_categories_by_revenue(model, time_window("last_month", REFERENCE_DATE))) == [("A", 20.0), ("B", 5.0)]


def test_aov(model):
    assert rows(measures.aov_by_state(model)) == [("SP", 175.0 / 3), ("RJ", 7.5)]


def test_ratings_count_review_item_pairs(model):
    out = rows(measures.seller_ratings_by_state(model, min_reviews=1))
    # s1: review 1 twice and review 5 once; s2: review 1 once and an unscored one.
    assert out == [("s2", "RS", 1.0, 2), ("s1", "SP", 7 / 3, 3)]
    assert rows(measures.seller_ratings_by_state(model, min_reviews=3)) == [("s1", "SP", 7 / 3, 3)]
    assert rows(measures.seller_ratings_by_state(model, min_reviews=1, distinct_reviews=True)) == [("s2", "RS", 1.0, 2), ("s1", "SP", 3.0, 2)]
    assert rows(measures.seller_ratings_by_state(model, states=["RS"], min_reviews=1)) == [("s2", "RS", 1.0, 2)]


def test_return_rate(model):
    assert sorted(rows(measures.return_rate_all(model))) == [("A", 0.0), ("B", 0.5)]
    assert rows(measures.return_rate_by_category(model, "B")) == [("B", 0.5)]
    assert rows(measures.return_rate_by_category(model, "no'such")) == []


def test_dispatch_binds_values(model):
    from tallyglass.catalog import Catalog

    run = lambda m, p: rows(measures.run_measure(model, m, p, Catalog()))
    assert run("return_rate_by_category", {"category": "B' OR '1'='1"}) == []
    assert run("top_categories_by_revenue", {"date_filter": "last_month", "top_n": "1"}) == [("A", 20.0)]
    assert run("aov_by_state", {})[0][0] == "SP"
    assert run("seller_ratings_by_state", {"state_filter": "south", "top_n": "3"}) == []
    with pytest.raises(ValueError):
        run("profit", {})


def test_bucketed_star_joins_without_moving_facts(spark, model):
    spark.sql("CREATE DATABASE IF NOT EXISTS star_test")
    try:
        star.save_star({k: model[k] for k in ("fact_orders", "fact_order_items")}, "star_test", 4)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stored = {k: spark.table(f"star_test.{k}") for k in ("fact_orders", "fact_order_items")}
        joined = stored["fact_order_items"].groupBy("order_id").agg(F.sum("price").alias("p")).join(stored["fact_orders"], "order_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE star_test CASCADE")


def test_buckets_follow_the_largest_fact(model):
    assert [star.bucket_count(model, n) for n in (1, 2, 3, 7, 100)] == [8, 4, 4, 1, 1]
    assert star.bucket_count({k: df.limit(0) for k, df in model.items()}) == 1


def test_star_from_raw(spark):
    raw = {n: spark.createDataFrame([], ddl) for n, ddl in star.RAW_SCHEMAS.items()}
    raw["order_reviews"] = spark.createDataFrame(
        [("r", "o", 1, None, None, "x", "2018-01-01 00:00:00"), ("r", "o", 5, None, None, "x", "2018-01-02 00:00:00")], star.RAW_SCHEMAS["order_reviews"]
    )
    raw["orders"] = spark.createDataFrame([("o", "c", "delivered", "2018-01-01 10:00:00", None, "bad", None, None)], star.RAW_SCHEMAS["orders"])
    model = star.build_star(raw, typed_times=True)
    assert [r["review_score"] for r in model["fact_order_reviews"].collect()] == [5]
    o = model["fact_orders"].first()
    assert o["order_purchase_timestamp"].hour == 10 and o["order_delivered_carrier_date"] is None
    pks, fks = star.check_star(model)
    assert pks.where("not ok").count() == 0
    assert {r["constraint_name"] for r in fks.where("not ok").collect()} == {"fk_orders_customer"}


# ---------------------------------------------------------------- small functions


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(cosine_distance("a", "b")).collect()]
    assert got[0] == 1.0 and got[1] == pytest.approx(0, abs=1e-12) and got[2] is None
    back = df.select("a", vec_to_text("a").alias("t"), text_to_vec(vec_to_text("a")).alias("v")).first()
    assert back["t"] == "[1.0,0.0]" and back["v"] == back["a"]


def test_haversine(spark):
    km = spark.range(1).select(haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert km == pytest.approx(6371 * 3.141592653589793)


def test_charts(spark):
    bar = spark.createDataFrame([("a", 1), ("b", 2)], "cat string, n int")
    assert {r["chart"] for r in profile_result(bar).collect()} == {"bar"}
    wide = spark.range(40).selectExpr("cast(id as string) cat", "id n")
    assert {r["chart"] for r in profile_result(wide).collect()} == {"table"}
    line = spark.range(40).selectExpr("cast(id as string) order_date", "id n")
    assert {r["chart"] for r in profile_result(line).collect()} == {"line"}
    assert {r["chart"] for r in profile_result(bar.limit(0)).collect()} == {"empty"}
    empty = spark.createDataFrame([("a", None)], "cat string, n int")
    assert [r["kind"] for r in profile_result(empty).collect()] == ["categorical", "categorical"]
