"""Every query with an oracle SQL must equal DuckDB on sf0.001; every
rows-only query must run and return rows."""

import pytest

import __spark_entry__ as E
from oracle_check import duck, frame_rows

from conftest import SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    exp = con.execute(ORACLE[name]).df()
    gc, gr = frame_rows(got)
    ec, er = frame_rows(exp)
    assert gc == ec
    assert len(gr) == len(er)
    assert gr == er


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "compound_score" in df.columns
