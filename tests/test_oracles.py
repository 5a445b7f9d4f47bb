"""Every registered query against its DuckDB oracle on sf0.001 (the driver
repeats this at sf0.01); rows-only queries must at least run."""

import pytest

import __spark_entry__ as entry
from conftest import SF0001
from tools.oracle_check import check, duck

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = check(spark, con, name, QUERIES[name], ORACLES.get(name), SF0001)
    assert res["status"] in ("ok", "rows-only"), res
    assert "types" not in res, res


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["id", "pred", "gold"]
