import pytest

from tallyglass.catalog import Catalog
from tallyglass.operators.audit import LAYERS, audit_sql, by_layer
from tallyglass.operators.scoring import score_guardrail

SCHEMA = "id string, sql string, target_layer string, reason_fragments array<string>, max_rows int"

# Each statement breaks one rule.
PROBES = [
    ("a1", "SELECT SUM(oi.price) AS revenue\nFROM fact_order_items oi\nJOIN fact_order_payments pay ON oi.order_id = pay.order_id\nLIMIT 1000", "joins_safe", ["Forbidden join detected", "fact_order_items -> fact_order_payments"]),
    ("a2", "UPDATE fact_orders SET order_status = 'shipped' LIMIT 5", "is_read_only", ["Write operation not allowed", "UPDATE"]),
    ("a3", "SELECT * FROM ghost_table LIMIT 10", "schema_valid", ["Unknown table referenced", "ghost_table"]),
    ("a4", "SELECT order_id FROM fact_orders", "row_limit_enforced", ["No LIMIT clause"]),
    ("a5", "SELECT order_id FROM fact_orders LIMIT 99999", "row_limit_enforced", ["exceeds max_rows"]),
    ("a6", "SELECT order_id FROM fact_orders LIMIT 10; DROP TABLE fact_orders", "is_read_only", ["Write operation not allowed", "DROP"]),
    ("a7", "delete from fact_orders where order_id = 'x' LIMIT 1", "is_read_only", ["Write operation not allowed", "DELETE"]),
]


@pytest.fixture(scope="module")
def audited(spark):
    rows = [(i, s, t, f, 1000) for i, s, t, f in PROBES]
    return audit_sql(spark.createDataFrame(rows, SCHEMA), Catalog(), "sql", "max_rows")


def test_each_probe_fails_one_layer(audited):
    for row in audited.collect():
        assert row["passed"] is False
        assert {k: row[k] for k in LAYERS} == {k: k != row["target_layer"] for k in LAYERS}, row["id"]
        assert all(f in " ".join(row["violations"]) for f in row["reason_fragments"])


def test_catch_rates(audited):
    got = {r["target_layer"]: (r["n_passed"], r["n_total"]) for r in by_layer(score_guardrail(audited)).collect()}
    assert got == {"joins_safe": (1, 1), "is_read_only": (3, 3), "schema_valid": (1, 1), "row_limit_enforced": (2, 2)}


def one(spark, sql, max_rows=1000):
    return audit_sql(spark.createDataFrame([(sql, max_rows)], "sql string, max_rows int"), Catalog(), "sql", "max_rows").first()


def test_messages(spark):
    row = one(spark, "Insert into X select * from ghosts join fact_orders; drop table y; INSERT", 10)
    assert row["violations"] == [
        "Write operation not allowed: INSERT, DROP",
        "Unknown table referenced: 'ghosts'",
        "No LIMIT clause found. All queries must be row-limited.",
    ]
    assert one(spark, "select 1 from fact_orders limit 0011", 10)["violations"] == ["LIMIT 11 exceeds max_rows=10."]


@pytest.mark.parametrize(
    "sql, passed",
    [
        ("SELECT a FROM fact_orders LIMIT 1000", True),
        ("SELECT a FROM fact_orders LIMIT 1001", False),
        ("SELECT a FROM fact_orders LIMIT -5", False),  # reads as missing
        ("SELECT a FROM (SELECT * FROM fact_orders LIMIT 5) t", True),  # the first LIMIT counts
        ("SELECT a FROM fact_orders LIMIT 99999999999999999999999", False),
        ("SELECT created_at, dropped FROM fact_orders LIMIT 5", True),  # whole words only
        ("SELECT EXTRACT(YEAR FROM order_ts) FROM fact_orders LIMIT 5", False),  # order_ts reads as a table
        ("WITH t AS (SELECT 1) SELECT * FROM t LIMIT 5", False),
        ("SELECT * FROM FACT_ORDERS, ghost LIMIT 5", True),  # only names after FROM and JOIN are read
        ("SELECT 'fact_order_payments' FROM fact_order_items LIMIT 5", False),  # names anywhere in the text
        ("SELECT * FROM geo_lookup LIMIT 5", False),
        ("SELECT * FROM fact_order_payments LIMIT 5", True),
        ("MERGE INTO x; COPY y; CALL z; SELECT 1 LIMIT 1", True),
    ],
)
def test_rules_read_text_only(spark, sql, passed):
    assert one(spark, sql)["passed"] is passed


def test_scorer_names_what_went_wrong(spark):
    rows = [("b1", "SELECT 1 FROM fact_orders LIMIT 1", "schema_valid", ["x"], 1000), ("b2", "DROP TABLE a", "is_read_only", ["DROP"], 1000)]
    out = score_guardrail(audit_sql(spark.createDataFrame(rows, SCHEMA), Catalog(), "sql", "max_rows")).orderBy("id").collect()
    assert out[0]["detail"] == "guardrail did not reject; target layer schema_valid did not fail; missing reason fragment 'x'"
    assert out[0]["actual"] == "passed" and out[0]["expected"] == "reject@schema_valid"
    assert out[1]["detail"] == "non-target layer row_limit_enforced also failed (not isolated)"


def test_streamed_log_is_audited_once(spark, tmp_path):
    from tallyglass.streaming.statement_log import read_log, write_audit

    log = tmp_path / "log"
    df = spark.createDataFrame([(p[0], p[1]) for p in PROBES] + [("ok", "SELECT 1 FROM fact_orders LIMIT 1")], "id string, sql string")
    df.write.json(str(log))
    for _ in range(2):  # a restart finds nothing new
        q = write_audit(read_log(spark, str(log), "id string, sql string"), Catalog(), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 8
    assert [r["id"] for r in out.where("passed = 'true'").collect()] == ["ok"]
