"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tessera import queries, queries_plans, queries_services, queries_sources  # noqa: F401  all register in the first

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(repr, d[columns].itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_flagship(spark):
    rows = queries_plans.search_end_to_end(spark, SF).collect()
    assert rows and max(r["rank"] for r in rows) <= queries.TOP
