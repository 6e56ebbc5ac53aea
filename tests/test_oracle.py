"""Every query with SQL against DuckDB on the same files."""

import oracle
import pytest

import __spark_entry__ as entry

CORE = {k: v for k, v in entry.QUERIES.items()}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(k for k in CORE if k in entry.SQL))
def test_query_equals_sql(spark, con, sf, name):
    assert oracle.differences(spark, con, name, CORE[name], entry.SQL[name], sf) is None


@pytest.mark.parametrize("name", sorted(k for k in CORE if k not in entry.SQL))
def test_query_runs(spark, sf, name):
    df = CORE[name](spark, sf)
    assert df.columns and df.count() > 0


def test_entry(spark, sf):
    r = entry.flagship(spark, sf).first()
    assert r.ci_lower <= r.mean <= r.ci_upper and r.replicates == 100
