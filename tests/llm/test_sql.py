"""Queries of this subpackage against their SQL, on the smallest tables."""

import os

import pytest

from ledgerloom.llm import queries
from tests.test_registry_rows import AT, norm


@pytest.mark.skipif(not os.path.exists(AT), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = queries.queries()[name](spark, AT)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{AT}/{f}'")
    con.execute(queries.oracle_sql()[name])
    found = [x[0] for x in con.description]
    assert sorted(found) == columns
    assert sorted(tuple(norm(r[found.index(c)]) for c in columns) for r in con.fetchall()) == rows
