"""Every registered query against its DuckDB text on the smallest given tables."""

import importlib.util
import os

import pytest

from tallymill.plans import catalog

_path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools", "check.py")
_spec = importlib.util.spec_from_file_location("check", _path)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_duckdb(spark, name):
    status, _, _, note = check.compare(spark, FOLDER, name)
    assert status == "ok", note


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracles())
