"""Every registered query of the chat library against DuckDB, on the smallest tables."""

import importlib.util

import pytest
from compare import DATA, canonical, tables


import __spark_entry__ as entry
from chatguard import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = tables(DATA).execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert canonical(got) == canonical(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(5).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if importlib.util.find_spec("chatguard.llm") is None:
        assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())


def test_scan_has_mixed_outcomes(spark):
    rows = core.QUERIES["archive_scan"](spark, DATA).groupBy("action").count().collect()
    assert {r["action"] for r in rows} >= {"allow", "mask", "block"}
