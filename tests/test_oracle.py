"""Every registered query against its DuckDB oracle (rows-only queries must
at least run) on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    if name not in ORACLE:
        assert len(got.columns) > 0
        return
    want = con.sql(ORACLE[name]).to_arrow_table().to_pandas()
    ok, msg = compare(got, want)
    assert ok, msg


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) >= {"source_id", "column", "anomaly_count"}
