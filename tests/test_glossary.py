import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallyglass.catalog import REFERENCE_DATE, Catalog
from tallyglass.operators import glossary as g
from tallyglass.plans import measures
from tallyglass.workload.roles import RETURNED, Tables


@pytest.mark.parametrize(
    "name, start, end, closed",
    [
        ("last_quarter", "2018-07-01", "2018-10-01", False),
        ("last_month", "2018-09-01", "2018-10-01", False),
        ("this_year", "2018-01-01", "2018-10-17", True),
    ],
)
def test_windows_at_the_reference_date(name, start, end, closed):
    w = g.time_window(name, REFERENCE_DATE)
    assert (w.start.isoformat(), w.end.isoformat(), w.closed) == (start, end, closed)


@pytest.mark.parametrize("ref", [dt.date(2020, 1, 1), dt.date(2020, 2, 29), dt.date(2019, 3, 31), dt.date(2019, 12, 31)])
def test_windows_join_up(ref):
    m, q = g.time_window("last_month", ref), g.time_window("last_quarter", ref)
    assert m.end == ref.replace(day=1) and (m.end - m.start).days in (28, 29, 30, 31)
    assert q.start.day == 1 and q.start.month in (1, 4, 7, 10) and 90 <= (q.end - q.start).days <= 92
    assert q.end <= ref


def test_unknown_period():
    with pytest.raises(ValueError):
        g.time_window("next_week", REFERENCE_DATE)


def test_text_stamps_leave_out_the_closing_day(spark):
    df = spark.createDataFrame([("2018-10-16 23:59:59",), ("2018-10-17 00:00:00",), ("2018-10-18 00:00:00",)], "t string")
    w = g.time_window("this_year", REFERENCE_DATE)
    assert g.filter_window(df, "t", w).count() == 1
    assert g.filter_window(df, "t", w, whole_last_day=True).count() == 2
    typed = df.selectExpr("cast(t as timestamp_ntz) t")
    assert g.filter_window(typed, "t", w).count() == 2
    assert g.filter_window(typed, "t", w, whole_last_day=True).count() == 2


def test_window_filter_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = g.filter_window(df, "o_orderdate", g.time_window("last_month", dt.date(2001, 6, 15)))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


SEL = "id int, measure string, glossary_refs array<string>, filters map<string,string>"


def resolve(spark, measure, refs, filters):
    return g.resolve_selections(spark.createDataFrame([(1, measure, refs, filters)], SEL), Catalog()).first()


def test_defaults_and_values(spark):
    r = resolve(spark, "top_categories_by_revenue", [], {})
    assert r["resolution_error"] is None and r["parameters_applied"] == {"date_filter": "", "top_n": "10"}
    r = resolve(spark, "seller_ratings_by_state", ["regions.south", "time_periods.last_month"], {"top_n": " 05 "})
    assert r["parameters_applied"] == {"date_filter": "last_month", "state_filter": "south", "top_n": "5"}


def test_undeclared_inputs_are_ignored(spark):
    r = resolve(spark, "aov_by_state", ["regions.south", "regions.north", "bad"], {"x": "y"})
    assert r["resolution_error"] is None and r["parameters_applied"] == {}
    r = resolve(spark, "top_categories_by_revenue", ["fuzzy_terms.top"], {})
    assert r["parameters_applied"]["date_filter"] == ""


@pytest.mark.parametrize(
    "measure, refs, filters, part",
    [
        ("top_categories_by_revenue", ["time_periods.last_month", "time_periods.this_year"], {}, "ambiguous"),
        ("top_categories_by_revenue", ["time_periods.yesterday"], {}, "unknown glossary ref 'time_periods.yesterday'"),
        ("top_categories_by_revenue", ["time_periods.dataset_reference_date"], {}, "has no 'sql' fragment"),
        ("top_categories_by_revenue", [], {"top_n": "many"}, "cannot coerce 'many' to integer"),
        ("top_categories_by_revenue", [], {"top_n": "5.0"}, "cannot coerce '5.0' to integer"),
        ("return_rate_by_category", [], {}, "required scalar parameter not found"),
        ("profit_by_moon", [], {}, "unknown measure profit_by_moon"),
    ],
)
def test_resolution_errors(spark, measure, refs, filters, part):
    r = resolve(spark, measure, refs, filters)
    assert part in r["resolution_error"] and r["parameters_applied"] is None


def test_scalar_types(spark):
    from pyspark.sql import functions as F

    rows = [("integer", "-7", "-7"), ("integer", "1_000", "1000"), ("integer", "1__0", None), ("float", "2.50", "2.5"), ("float", "x", None),
            ("boolean", "YES", "True"), ("boolean", "no", "False"), ("date", "2018-01-01", "2018-01-01"), ("string", " a'b ", " a'b ")]
    df = spark.createDataFrame(rows, "kind string, raw string, want string")
    for r in df.withColumn("got", g.coerce_scalar(F.col("raw"), F.col("kind"))).collect():
        assert r["got"] == r["want"], r


def test_templates(spark):
    g.require_templates(spark, Catalog(templates={"return_rate_by_category": "... = {category} {category}"}))
    with pytest.raises(RuntimeError, match="limit_"):
        g.require_templates(spark, Catalog(templates={"aov_by_state": "LIMIT {limit_}"}))


@pytest.mark.parametrize("kind", ["timestamp", "date", "string"])
def test_window_cells_are_the_windows(spark, kind):
    ref = dt.date(2018, 10, 17)
    windows = {name: g.time_window(name, ref) for name in ("last_quarter", "last_month", "this_year")}
    days = ["2017-12-31", "2018-01-01", "2018-06-30", "2018-07-01", "2018-08-31", "2018-09-01", "2018-09-30", "2018-10-01", "2018-10-17", "2018-10-18"]
    stamps = [d + tail for d in days for tail in (("",) if kind == "date" else ("", " 00:00:00", " 09:30:00"))] + [None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(stamps)], "id int, s string").withColumn("s", F.col("s").cast(kind))
    cell, names = g.window_cells(F.col("s"), df.schema["s"].dataType, windows)
    got = {r["id"]: set(r["n"]) for r in df.withColumn("cell", cell).select("id", names.alias("n")).collect()}
    for name, w in windows.items():
        inside = {r["id"] for r in g.filter_window(df, "s", w).collect()}
        assert {i for i, n in got.items() if name in n} == inside
    assert all("" in n for n in got.values())


def test_selections_as_a_table_equal_single_measures(spark, sf_dir):
    t = Tables(spark, sf_dir)
    asked = [
        (1, "top_categories_by_revenue", [], {}),
        (2, "top_categories_by_revenue", ["time_periods.last_quarter"], {"top_n": "2"}),
        (3, "aov_by_state", ["time_periods.last_month"], {"top_n": "1"}),
        (4, "seller_ratings_by_state", ["time_periods.this_year", "regions.europe"], {"top_n": "7"}),
        (5, "seller_ratings_by_state", ["regions.asia"], {}),
        (6, "return_rate_by_category", [], {"category": "economy"}),
        (7, "return_rate_by_category", [], {"category": "nothing"}),
        (8, "seller_ratings_by_state", ["regions.nowhere"], {}),
        (9, "no_measure", [], {}),
        (10, "top_categories_by_revenue", [], {"top_n": "-3"}),
        (11, "seller_ratings_by_state", [], {"top_n": "3000"}),
    ]
    picked = spark.createDataFrame(asked, "id int, measure string, glossary_refs array<string>, filters map<string,string>")
    resolved = g.resolve_selections(picked, t.catalog)
    got = {}
    for r in measures.run_selections(resolved, "id", t.model, t.catalog, RETURNED).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append((r["label"], r["value"]))
    for row in resolved.collect():
        if row["parameters_applied"] is None or row["id"] == 10:
            assert row["id"] not in got
            continue
        one = measures.run_measure(t.model, row["measure"], row["parameters_applied"], t.catalog, RETURNED)
        value = {"top_categories_by_revenue": "revenue", "aov_by_state": "aov", "seller_ratings_by_state": "avg_rating", "return_rate_by_category": "return_rate"}[row["measure"]]
        want = [(str(r[0]), r[value]) for r in one.collect()]
        assert [x[0] for x in got.get(row["id"], [])] == [x[0] for x in want]
        assert [x[1] for x in got.get(row["id"], [])] == pytest.approx([x[1] for x in want])
