"""Each stand-in view built in Spark equals the same view built by its SQL text in DuckDB."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import TABLES, rows_of  # noqa: E402
from tillage.sources.fixtures import FIXTURE_SQL, Catalog, with_fixtures  # noqa: E402

SF = "/root/testdata/sf0.001"
ATTR = {"fx_addresses": "addresses", "fx_cnf_companies": "cnf_companies"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(FIXTURE_SQL))
def test_fixture_matches_its_sql(spark, duck, name):
    df = getattr(Catalog(spark, SF), ATTR.get(name, name[3:]))
    res = duck.execute(with_fixtures(f"SELECT * FROM {name}", name))
    cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(cols)
    assert rows_of(df.columns, df.collect()) == rows_of(cols, res.fetchall())
