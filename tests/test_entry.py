import importlib.util
import os
import re

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(_ROOT, "__spark_entry__.py"))
entry_module = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(entry_module)


def test_entry_gives_rows(spark, sf_dir):
    df = entry_module.entry(spark)
    assert df.columns == ["category", "revenue"]
    assert df.count() > 0


def test_every_twin_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_inventory_is_covered():
    ids = {n.split("_")[0] for n in entry_module.queries()}
    wanted = {"s": 10, "w": 10, "m": 6, "r": 12, "g": 10, "q": 7, "d": 12, "c": 11, "v": 20, "e": 18, "x": 12}
    missing = {f"{k}{i}" for k, n in wanted.items() for i in range(1, n + 1)} - ids
    assert not missing


def test_few_queries_are_rows_only():
    rows_only = set(entry_module.queries()) - set(entry_module.oracle_sql())
    rows_only = {n for n in rows_only if not re.match(r"op\d+_|pipeline$", n)}
    assert rows_only == {
        "s3_audit_landing", "v8_approximate_neighbours", "v19_projection",
    }
