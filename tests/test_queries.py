"""Every registered query of the engine against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from arborstat.plans import analysis, analysis_oracles, catalogue, fixtures, fixtures_oracles, oracles, reporting, reporting_oracles

QUERIES = catalogue.queries() | reporting.queries() | analysis.queries() | fixtures.queries()
ORACLES = oracles.oracle_sql() | reporting_oracles.oracle_sql() | analysis_oracles.oracle_sql() | fixtures_oracles.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    held = duckdb.connect()
    for t in TABLES:
        held.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return held


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, sf_dir, name):
    df, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    place = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in place) for r in want.fetchall())
