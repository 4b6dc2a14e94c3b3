"""Every interval query against its SQL on the smallest tables."""

import duckdb
import pytest

from spanweave import registry

DIR = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem events".split()
SQL = registry.oracle_sql()


def rows(frame):
    cols = sorted(frame.columns)
    held = frame[cols].astype(object).where(frame[cols].notna(), None)
    return sorted(map(str, held.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    assert rows(registry.queries()[name](spark, DIR).toPandas()) == rows(con.sql(SQL[name]).df())
