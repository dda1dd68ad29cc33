"""Every plan on the smallest tables: against its SQL, or at least running with rows."""

from __future__ import annotations

import os

import pytest
from compare import connect, rows_of, rows_of_sql

from tidewatch.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plan(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert df.columns
        df.collect()
        return
    names, want = rows_of_sql(con, SQL[name])
    assert sorted(df.columns) == names
    assert rows_of(df) == want


def test_sql_only_for_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    monkeypatch.setitem(sys.modules, "tidewatch.llm", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(e.queries())
    assert not any(k.startswith(("p1_", "p3_", "p8_")) for k in e.queries())
    sys.modules.pop("__spark_entry__", None)
