"""Every registered query with a twin gives the twin's rows; the others give rows of a stable schema."""

import importlib.util
import os

import pytest

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_spec = importlib.util.spec_from_file_location("compare", os.path.join(_ROOT, "tools", "compare.py"))
compare = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(compare)


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", sorted(compare.QUERIES))
def test_twin(spark, con, sf_dir, name):
    ok, message, _ = compare.compare(spark, con, name, sf_dir)
    assert ok, message
