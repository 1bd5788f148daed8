import json

import pytest
from pyspark.sql import functions as F

from tallyglass.operators import gates


def test_measure_gate_boundary(spark):
    df = spark.createDataFrame([(1, "m", 0.5), (2, "m", 0.49), (3, None, None)], "id int, measure string, conf double")
    a, b, c = gates.gate_measure(df, "measure", "conf").orderBy("id").collect()
    assert (a["gated_out"], a["accepted_measure"], a["failure_reason"]) == (False, "m", None)
    assert b["gated_out"] and b["rejected_measure"] == "m" and b["accepted_measure"] is None
    assert b["failure_reason"] == (
        "Closest measure 'm' was selected at confidence 0.49, below the 0.5 threshold. "
        "The question likely falls outside the governed measures."
    )
    assert c["gated_out"] is False and c["failure_reason"] == gates.NO_MEASURE


@pytest.mark.parametrize(
    "grounded, conf, count, revised, want",
    [
        (True, 0.7, 0, "x", "end"),
        (True, 0.69, 0, "x", "revise"),
        (True, 0.69, 0, None, "end"),
        (True, 0.69, 1, "x", "end"),
        (False, 0.95, 0, "x", "revise"),
        (True, 0.0, 0, None, "end"),  # what a failed reviewer reports
    ],
)
def test_review_decision(spark, grounded, conf, count, revised, want):
    df = spark.createDataFrame([(grounded, conf, count, revised)], "g boolean, c double, n int, r string")
    assert df.select(gates.review_decision("g", "c", "n", "r")).first()[0] == want


GOOD = {"measure": "aov_by_state", "glossary_refs": ["regions.south"], "filters": {"top_n": "5"}, "reasoning": "r", "confidence": 1.0}


@pytest.mark.parametrize(
    "text, ok",
    [
        (json.dumps(GOOD), True),
        ("```json\n" + json.dumps(GOOD) + "\n```", True),
        ("  ```\n" + json.dumps(GOOD) + "```  \n", True),
        (json.dumps({**GOOD, "confidence": 1.01}), False),
        (json.dumps({**GOOD, "confidence": -0.1}), False),
        (json.dumps({**GOOD, "measure": "nope"}), False),
        (json.dumps({k: v for k, v in GOOD.items() if k != "reasoning"}), False),
        (json.dumps({k: v for k, v in GOOD.items() if k not in ("filters", "glossary_refs")}), True),
        (json.dumps({**GOOD, "confidence": "0.9"}), True),
        (json.dumps({**GOOD, "confidence": None}), False),
        (json.dumps({**GOOD, "filters": {"top_n": 5}}), False),
        (json.dumps({**GOOD, "filters": None}), False),
        (json.dumps({**GOOD, "filters": []}), False),
        (json.dumps({**GOOD, "glossary_refs": ["a", 1]}), False),
        (json.dumps({**GOOD, "glossary_refs": [None]}), False),
        (json.dumps({**GOOD, "glossary_refs": "regions.south"}), False),
        (json.dumps({**GOOD, "glossary_refs": [], "filters": {}, "extra": 1}), True),
        (json.dumps({**GOOD, "reasoning": 3}), False),
        ("[1]", False),
        ("null", False),
        (json.dumps(GOOD)[:-2], False),
        ("I cannot help", False),
        ("", False),
        (None, False),
    ],
)
def test_parse(spark, text, ok):
    sel = gates.parse_selections(spark.createDataFrame([(text,)], "t string"), "t").first()["selection"]
    assert (sel is not None) is ok
    if ok:
        assert sel["glossary_refs"] in (["regions.south"], []) and sel["filters"] in ({"top_n": "5"}, {})


def test_status_ladder_takes_the_first_failure(spark):
    rows = [(1, None, "e", False, "x"), (2, "m", "e", False, "x"), (3, "m", None, False, "x"), (4, "m", None, True, "x"), (5, "m", None, True, None)]
    df = spark.createDataFrame(rows, "id int, m string, r string, g boolean, x string").orderBy("id")
    got = [r[0] for r in df.select(gates.status_ladder("m", "r", "g", "x")).collect()]
    assert got == ["no_measure_matched", "resolution_failed", "guardrail_violation", "execution_failed", "success"]


def test_routes_fall_back_to_hybrid(spark):
    df = spark.createDataFrame([("sql",), ("",), (None,), ("rag",)], "route string")
    got = [tuple(r)[1:] for r in gates.apply_route(df).collect()]
    assert got == [("sql", True, False), ("hybrid", True, True), ("hybrid", True, True), ("rag", False, True)]


def test_second_pass_replaces_hits_even_by_none(spark):
    q = spark.createDataFrame(
        [(1, "revise", "rag", "new", 0), (2, "revise", "sql", "new", 0), (3, "revise", "rag", "", 0), (4, "end", "rag", "new", 0), (5, "revise", None, "none", 0)],
        "query_id int, decision string, route string, revised_query string, revision_count int",
    )
    hits = spark.createDataFrame([(i, f"old{i}") for i in range(1, 6)], "query_id int, chunk_id string")
    counted, merged = gates.two_pass_retrieve(
        q, hits, lambda r: r.where("text = 'new'").select("query_id", F.concat(F.lit("new"), F.col("query_id")).alias("chunk_id"))
    )
    assert {tuple(r) for r in merged.collect()} == {(1, "new1"), (2, "old2"), (3, "old3"), (4, "old4")}
    assert {r["query_id"]: r["revision_count"] for r in counted.collect()} == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1}


def test_bands_and_labels(spark):
    df = spark.createDataFrame([(0.85, 0), (0.84, 1), (0.7, 2), (0.69, None), (None, 0)], "c double, n int")
    got = [tuple(r) for r in df.select(gates.confidence_band("c"), gates.revision_label("n")).collect()]
    assert got == [("green", None), ("orange", "Self-corrected once"), ("orange", "Revised ×2"), ("red", None), ("red", None)]
