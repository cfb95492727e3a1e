"""Every query with SQL agrees with DuckDB on the smallest tables; the others run."""

from __future__ import annotations

import duckdb
import pytest

from emulsia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(rows, names):
    at = [names.index(c) for c in sorted(names)]
    return sorted(tuple(repr(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in catalogue.SQL:
        found = duck.sql(catalogue.SQL[name])
        assert sorted(found.columns) == sorted(df.columns)
        assert normal(rows, df.columns) == normal(found.fetchall(), found.columns)
