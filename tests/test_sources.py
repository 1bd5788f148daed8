import pytest
from pyspark.sql import functions as F

from tallyglass.operators import evidence
from tallyglass.sources import cases, chunks, corpus, landing, results


def test_csv_landing(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text('seller_id,seller_zip_code_prefix,seller_city,seller_state\n"0012",01001,"são paulo",SP\n"x",,,\n')
    got = landing.land_csv(spark, str(tmp_path), {"sellers": landing.RAW_SCHEMAS["sellers"]})["sellers"]
    assert [tuple(r) for r in got.collect()] == [("0012", 1001, "são paulo", "SP"), ("x", None, None, None)]
    landing.save_raw({"sellers": got}, str(tmp_path / "out"))
    landing.save_raw({"sellers": got}, str(tmp_path / "out"))  # replace, not append
    assert spark.read.parquet(str(tmp_path / "out" / "raw_sellers")).count() == 2
    assert [tuple(r) for r in landing.table_counts({"sellers": got}).collect()] == [("sellers", 2, 4)]


def test_bad_csv_fails(spark, tmp_path):
    (tmp_path / "sellers.csv").write_text("seller_id,seller_zip_code_prefix,seller_city,seller_state\na,notanumber,c,SP\n")
    with pytest.raises(Exception):
        landing.land_csv(spark, str(tmp_path), {"sellers": landing.RAW_SCHEMAS["sellers"]})["sellers"].collect()


def test_landing_audit(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 100)
    (tmp_path / "b.csv").write_bytes(b"x" * 99)
    audit = landing.audit_landing(spark, str(tmp_path))
    assert {r["path"][-5:]: r["ok"] for r in audit.collect()} == {"a.csv": True, "b.csv": False}
    assert tuple(landing.landing_tally(audit).first()) == (1, 1)


def test_corpus(spark, tmp_path):
    for folder, name in (("policy", "p 1.md"), ("categories", "c.md"), ("data_dictionary", "d.md")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_text("# T\né\n", encoding="utf-8")
    (tmp_path / "policy" / "skip.txt").write_text("no")
    got = {tuple(r) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got == {("p 1.md", "policy", "# T\né\n"), ("c.md", "category_def", "# T\né\n"), ("d.md", "data_dictionary", "# T\né\n")}


def test_chunk_storage(spark, tmp_path):
    rows = [("1", "b.md", "policy", "T", "S", 1, 0, 3, 1, "x\n\"y"), ("2", "b.md", "policy", "T", "", 0, 0, 3, 1, "é"), ("3", "a.md", "other", None, "S", 0, 0, 3, 1, "z")]
    df = spark.createDataFrame(rows, chunks.CHUNK_SCHEMA)
    chunks.write_chunks_json(df, str(tmp_path / "json"))
    assert sorted(map(tuple, chunks.read_chunks_json(spark, str(tmp_path / "json")).collect())) == sorted(rows, key=lambda r: r[0])
    for _ in range(2):
        chunks.save_chunks(df, str(tmp_path / "t"))
    back = chunks.scan_chunks(spark, str(tmp_path / "t"))
    assert [(r["source"], r["chunk_index"]) for r in back.collect()] == [("a.md", 0), ("b.md", 0), ("b.md", 1)]
    one = chunks.scan_chunks(spark, str(tmp_path / "t"), "policy")
    assert one.count() == 2 and "doc_type" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_results(spark, tmp_path):
    root = str(tmp_path / "results")
    assert results.load_results(spark, "routing", root) is None
    c = spark.createDataFrame([("a", True), ("b", False)], "case_id string, passed boolean")
    s = c.agg(F.count_if("passed").alias("passed"), F.count("*").alias("total"))
    for _ in range(2):
        results.save_results("routing", s, c, root)
    e = results.load_results(spark, "routing", root)
    head = e.summary.first()
    assert head["dimension"] == "routing" and tuple(head["summary"]) == (1, 2) and "T" in head["timestamp"]
    assert sorted(map(tuple, e.cases.collect())) == [("a", True), ("b", False)]


def test_cases(spark, tmp_path):
    p = tmp_path / "cases.json"
    p.write_text('{"id":"s1","text":"q","category":"sql_positive","expected_route":"sql"}\n{"id":"s2","text":"q","category":"rag_oos","expected_route":"rag","expects_hedge":true}\n')
    df = cases.load_eval_cases(spark, str(p))
    assert {r["id"]: r["expects_hedge"] for r in df.collect()} == {"s1": False, "s2": True}
    p.write_text('{"id":"s1","category":"sql_positive"}\n{"id":"s1","category":"sql_oos"}\n')
    with pytest.raises(ValueError, match="duplicate key in eval cases: 's1'"):
        cases.load_eval_cases(spark, str(p))
    p.write_text('{"id":"s1","category":"sql_positiv"}\n')
    with pytest.raises(ValueError, match="unknown category"):
        cases.load_eval_cases(spark, str(p))
    p.write_text('{"id":"a1","sql":"DROP","fails":"is_read_only","reason_fragments":["DROP"]}\n')
    assert cases.load_adversarial_set(spark, str(p)).first()["reason_fragments"] == ["DROP"]


# ---------------------------------------------------------------- evidence


def test_context(spark):
    res = spark.createDataFrame(
        [(1, "m", "success", None, "a | b", None), (2, None, "no_measure_matched", None, None, ["sql: x"]), (3, "m", "success", None, "a", None)],
        "question_id int, measure string, status string, failure_reason string, header string, errors array<string>",
    )
    lines = spark.createDataFrame([(1, 2, "3 | 4"), (1, 1, "1 | 2")], "question_id int, row_no int, line string")
    hits = spark.createDataFrame(
        [(2, 2, "b.md", "S", "two"), (2, 1, "a.md", None, "one"), (2, 3, "b.md", "S", "three"), (2, 6, "z.md", "S", "six"), (4, 1, "c.md", "S", "c")],
        "question_id int, rank int, source string, section string, content string",
    )
    rag = evidence.passage_evidence(hits).withColumn("errors", F.array(F.lit("rag: y")))
    merged = evidence.merge_evidence(evidence.sql_evidence(res, lines), rag)
    out = {r["question_id"]: r for r in evidence.render_context(evidence.collect_sources(merged)).collect()}
    assert out[1]["context"] == "SQL result from the m measure (2 rows):\na | b\n1 | 2\n3 | 4\n\nDocument excerpts: none retrieved."
    assert out[2]["context"] == (
        "SQL result: could not be computed (status=no_measure_matched). Reason: unknown error\n\n"
        "Document excerpts (most relevant first):\n\n[1] source: a.md | section: None\none\n\n[2] source: b.md | section: S\ntwo\n\n[3] source: b.md | section: S\nthree"
    )
    assert out[4]["context"].startswith("SQL result: none (no database query was run for this question).")
    assert out[2]["sources_used"] == ["a.md", "b.md"] and out[2]["errors"] == ["sql: x", "rag: y"]
    assert [(out[i]["has_sql"], out[i]["has_rag"]) for i in (1, 2, 3, 4)] == [(True, False), (False, True), (False, False), (False, True)]
    assert out[1]["sources_used"] == ["m"] and out[4]["errors"] == ["rag: y"]


def test_invented_figures_are_found(spark):
    rows = [
        ("The top category by revenue is toys, which generated 5,000,000 reais, followed by health_beauty at 1,258,681.34 reais.",
         "category | revenue\nhealth_beauty | 1258681.34\nwatches_gifts | 1205005.68", ["toys", "health_beauty", "beauty"]),
        ("Revenue was 12.50 for health_beauty.", "health_beauty | 12.5", ["beauty", "health_beauty"]),
    ]
    df = spark.createDataFrame(rows, "answer string, evidence string, names array<string>")
    a, b = evidence.grounding_audit(df, "answer", "evidence", "names").collect()
    assert (a["ungrounded_numbers"], a["ungrounded_tokens"], a["grounded"]) == (["5000000"], ["toys"], False)
    assert b["grounded"] is True


def test_lines_beyond_the_row_limit_of_the_request(spark):
    results = spark.createDataFrame([("a", "m", "success", None, "h")], "question_id string, measure string, status string, failure_reason string, header string")
    rows = spark.range(1, 1501).selectExpr("'a' AS question_id", "CAST(id AS INT) AS row_no", "CONCAT('l', id) AS line")
    for limit, kept in ((None, 1000), (1200, 1200), (10_000, 1500)):
        got = evidence.sql_evidence(results, rows, **({"max_rows": limit} if limit else {})).first()["lines"]
        assert got == [f"l{i}" for i in range(1, kept + 1)]


def _some_chunks(spark, n, word="x"):
    return spark.range(n).selectExpr(
        "cast(id as string) as chunk_id", "'a.md' as source", "if(id % 2 = 0, 'policy', 'faq') as doc_type", "cast(id as int) as chunk_index",
        f"concat('{word}', id) as content",
    )


def test_failed_replacement_leaves_the_chunk_table(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        chunks.scan_chunks(spark, path)
    first = chunks.save_chunks(_some_chunks(spark, 8), path)
    torn = _some_chunks(spark, 8, "new").withColumn("content", F.when(F.col("chunk_index") == 7, F.raise_error(F.lit("torn"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="torn"):
        chunks.save_chunks(torn, path)
    assert [r["content"] for r in chunks.scan_chunks(spark, path).collect()] == [f"x{i}" for i in range(8)]
    assert chunks.current_snapshot(spark, path) == first
    assert chunks.drop_snapshots(spark, path) == 1  # what the failed write left
    assert chunks.scan_chunks(spark, path).count() == 8


def test_reader_keeps_its_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    chunks.save_chunks(_some_chunks(spark, 4), path)
    before = chunks.scan_chunks(spark, path)
    second = chunks.save_chunks(_some_chunks(spark, 6, "y"), path)
    assert [r["content"] for r in before.collect()] == [f"x{i}" for i in range(4)]
    assert [r["content"] for r in chunks.scan_chunks(spark, path).collect()] == [f"y{i}" for i in range(6)]
    for i in range(10):  # ten markers and more keep their order
        second = chunks.save_chunks(_some_chunks(spark, 1, f"z{i}"), path)
    assert chunks.current_snapshot(spark, path) == second
    assert chunks.drop_snapshots(spark, path, keep=2) == 10
    assert [r["content"] for r in chunks.scan_chunks(spark, path).collect()] == ["z90"]
    # a table that becomes empty is still a table, and a type that looks like a number stays text
    chunks.save_chunks(_some_chunks(spark, 0), path)
    assert chunks.scan_chunks(spark, path).collect() == []
    chunks.save_chunks(_some_chunks(spark, 1).withColumn("doc_type", F.lit("007")), path)
    assert chunks.scan_chunks(spark, path, "007").first()["doc_type"] == "007"
