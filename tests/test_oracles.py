"""Every query with an oracle matches DuckDB on the same parquet tables (sf0.001)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_check import compare

ORACLE_NAMES = sorted(E.oracle_sql())


def test_registry_consistent():
    qs, orc = E.queries(), E.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 80


@pytest.mark.parametrize("name", ORACLE_NAMES)
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)
    assert res[name][0] == "MATCH", res[name]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2
    assert {r["regime"] for r in rows} == {"random", "group"}
