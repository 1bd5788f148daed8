import pytest
from pyspark.sql import functions as F

from tallyglass.operators import scoring as s
from tallyglass.plans import scorecard as card


def test_measure_details(spark):
    rows = [("a", "m", "m", True, ""), ("b", None, None, True, "correct refusal (no measure for out-of-scope question)"),
            ("c", None, "m", False, "hallucinated measure 'm' for out-of-scope question"),
            ("d", "m", None, False, "refused but a measure was expected"), ("e", "m", "n", False, "wrong measure")]
    df = spark.createDataFrame(rows, "id string, expected_measure string, selected_measure string, ok boolean, want string")
    for r in s.score_measure(df).collect():
        assert (r["measure_passed"], r["measure_detail"]) == (r["ok"], r["want"])


@pytest.mark.parametrize(
    "expected, actual, detail",
    [
        (["time_periods.last_quarter"], ["last_quarter"], ""),
        (["a.x", "x"], ["b.c.x"], ""),
        ([], [], ""),
        (["a.x", "a.y"], ["a.z"], "missing ['x', 'y']; extra ['z']"),
        ([], ["q"], "extra ['q']"),
    ],
)
def test_glossary_leaves(spark, expected, actual, detail):
    df = spark.createDataFrame([(expected, actual)], "expected_glossary array<string>, glossary_refs array<string>")
    r = s.score_glossary(df).first()
    assert r["glossary_detail"] == detail and r["glossary_passed"] is (detail == "")


def test_hedge_boundary(spark):
    df = spark.createDataFrame([(0.7, False), (0.69, True), (0.7, True)], "confidence double, expects_hedge boolean")
    assert [r["hedge_passed"] for r in s.score_hedge(df).collect()] == [True, True, False]


def test_gate_fired_and_recovered(spark):
    rows = [(0.2, 1, True, True, False), (0.95, 0, False, False, False), (0.8, 1, True, True, True), (0.69, 0, True, True, False)]
    df = spark.createDataFrame(rows, "confidence double, revision_count int, expects_hedge boolean, f boolean, r boolean")
    for r in s.hedge_eval(df).collect():
        assert (r["gate_fired"], r["recovered"]) == (r["f"], r["r"])


def test_published_hedge_run(spark):
    """Ten cases of a published run: five resolving, five unanswerable of which one did not hedge."""
    rows = [("h1", False, 0.85, 0), ("h3", False, 0.95, 0), ("r1", False, 0.95, 0), ("r4", False, 0.9, 0), ("r6", False, 0.95, 0),
            ("g1", True, 0.2, 1), ("g2", True, 0.15, 1), ("g3", True, 0.15, 1), ("g4", True, 0.95, 0), ("g5", True, 0.15, 1)]
    df = spark.createDataFrame(rows, "case_id string, expects_hedge boolean, confidence double, revision_count int")
    assert tuple(s.hedge_summary(s.hedge_eval(df)).first()) == (9, 10, 5, 5, 4, 5, 0)


def test_published_retrieval_ranks(spark):
    """16 published first-hit ranks (one miss) give hit rate 0.9375 and MRR 0.796875."""
    ranks = [2, 2, 2, 4] + [1] * 11 + [None]
    hits = spark.createDataFrame([(i, f"s{j}", j) for i in range(16) for j in range(1, 6)], "query_id int, source string, rank int")
    want = spark.createDataFrame([(i, f"s{r}" if r else "zz") for i, r in enumerate(ranks)] + [(0, "never")], "query_id int, source string")
    out = s.retrieval_summary(s.score_retrieval(hits, want)).first()
    assert out["hit_rate"] == 0.9375 and out["n"] == 16
    assert out["mrr"] == pytest.approx(sum(1 / r for r in ranks if r) / 16)


def test_sources_rank_by_first_appearance(spark):
    hits = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "c", 4), (2, "a", 5)], "query_id int, source string, rank int")
    got = {tuple(r) for r in s.dedupe_sources(hits).collect()}
    assert got == {(1, "b", 1), (1, "a", 2), (1, "c", 3), (2, "a", 1)}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "query_id int, rank int, hit boolean, reciprocal_rank double")
    assert tuple(s.retrieval_summary(none).first()) == (0.0, 0.0, 0)
    assert s.summarize(spark.createDataFrame([], "dimension string, passed boolean")).count() == 0
    zero = spark.createDataFrame([(0, 0)], "p bigint, n bigint")
    assert zero.select(s.accuracy("p", "n"), card.pct(F.col("p"), F.col("n"))).first()[:] == (0.0, "n/a")


def test_confusion_fills_zeros(spark):
    rows = [("sql", "sql")] * 15 + [("rag", "rag")] * 14 + [("rag", "sql")] + [("hybrid", "hybrid")] * 6
    df = spark.createDataFrame(rows, "expected_route string, actual_route string")
    got = {r["expected"]: tuple(r)[1:] for r in s.confusion(df, s.ROUTES).collect()}
    assert got == {"sql": (15, 0, 0), "rag": (1, 14, 0), "hybrid": (0, 0, 6)}
    line = card.score_line(df.agg(F.lit(35).alias("p"), F.lit(36).alias("n")), 1, "Routing accuracy", "p", "n").first()
    assert line["score"] == "35/36 (97%)"


def test_gate_turns_a_pick_into_a_refusal(spark):
    rows = [(1, None, "m", 0.15, [], "no_measure_matched"), (2, "m", "m", 0.95, ["time_periods.x"], None), (3, None, None, None, [], "no_measure_matched")]
    df = spark.createDataFrame(rows, "case_id int, expected_measure string, raw_measure string, raw_confidence double, glossary_refs array<string>, expected_status string")
    out = s.measure_eval(df.withColumn("expected_glossary", F.array(F.lit("x")))).orderBy("case_id").collect()
    assert [(r["measure_passed"], r["status_passed"], r["glossary_passed"], r["gated_out"]) for r in out] == [
        (True, True, None, True), (True, True, True, False), (True, True, None, False),
    ]
    assert s.measure_eval_summary(s.measure_eval(df.withColumn("expected_glossary", F.array(F.lit("x"))))).first()["refusals_via_gate"] == 1


def test_reliability(spark):
    df = spark.createDataFrame([("a", True, 0.1), ("a", True, 0.2), ("b", True, 0.3), ("b", False, 0.9)], "case_id string, fired boolean, confidence double")
    got = {r["case_id"]: (r["n_runs"], r["share_fired"], r["stable"]) for r in s.reliability(df).collect()}
    assert got == {"a": (2, 1.0, True), "b": (2, 0.5, False)}


def test_label_rules(spark):
    rows = [("ok", "sql_positive", "m", None, None, False), ("x", "sql_oos", "m", "success", None, False), ("y", "rag_oos", None, None, None, False),
            ("z", "hybrid_positive", None, None, [], False), ("w", "rag_positive", None, None, ["a"], False)]
    df = spark.createDataFrame(rows, "id string, category string, expected_measure string, expected_status string, expected_sources array<string>, expects_hedge boolean")
    got = {r["id"]: len(r["label_errors"]) for r in s.check_labels(df).collect()}
    assert got == {"ok": 0, "x": 2, "y": 1, "z": 2, "w": 0}


def test_scorecard_text(spark):
    one = spark.createDataFrame([(7, 7, 2)], "p bigint, n bigint, r bigint")
    lines = [card.score_line(one, 2, "B", "p", "n", F.concat("r", F.lit(" refused"))), card.score_line(one, 1, "A", "r", "n")]
    got = [r["value"] for r in card.render_markdown(card.scorecard(lines)).collect()]
    assert got == ["| A | 2/7 (29%) |  |", "| B | 7/7 (100%) | 2 refused |"]


def test_misses_of_measures_and_retrieval(spark):
    measured = spark.createDataFrame(
        [(1, True, True, None, "m", "m"), (2, True, False, None, "m", None), (3, True, True, False, "m", "m"), (4, True, True, True, "m", "m"), (5, False, True, None, None, "n")],
        "case_id long, measure_passed boolean, status_passed boolean, glossary_passed boolean, expected_measure string, selected_measure string",
    )
    got = sorted((r["case_id"], r["expected"], r["actual"]) for r in card.measure_misses(measured).collect())
    assert got == [("2", "m", "None"), ("3", "m", "m"), ("5", "None", "n")]

    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "z", 2), (2, "y", 1)], "query_id long, source string, rank int")
    wanted = spark.createDataFrame([(1, "b"), (2, "q"), (2, "a"), (3, "a")], "query_id long, source string")
    found = s.score_retrieval(ranked, wanted)
    got = sorted((r["case_id"], r["expected"], r["actual"]) for r in card.retrieval_misses(found, ranked, wanted).collect())
    assert got == [("2", "a,q", "y,z"), ("3", "a", "")]


def test_misses_state_the_rules_behind_a_verdict_once(spark):
    texts = F.transform(F.array("id"), lambda x: F.regexp_replace(x.cast("string"), "1", ""))
    scored = spark.range(40).withColumn("left", F.size(F.filter(texts, lambda x: x != "")))
    scored = scored.withColumn("ok", (F.col("left") > 0) & (F.col("left") < 9) & (F.col("left") != 5))
    lost = card.misses(scored, "ok", "d", "id", F.lit("a"), F.lit("b"))
    assert [r.case_id for r in lost.orderBy(F.col("case_id").cast("int")).collect()] == ["1", "11"]
    assert lost._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 1
