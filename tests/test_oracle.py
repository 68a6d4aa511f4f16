"""Every signal query against its SQL in DuckDB, over the smallest tables."""

import duckdb
import pytest

from cadenza.oracle import ORACLE
from cadenza.queries import QUERIES

TABLES = ("events", "lineitem")


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(None if x is None or x != x else float(x) for x in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf_dir, duck, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
