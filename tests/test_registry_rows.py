"""Registered queries of the core against their SQL, on the smallest tables."""

import math
import os

import pytest

from ledgerloom.plans import registry

AT = "/root/testdata/sf0.001"
SLOW = {"answers", "quality_gate"}  # tests of their own


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.exists(AT), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = registry.queries()[name](spark, AT)
    columns = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert columns
        return
    con = duckdb.connect()
    for f in os.listdir(AT):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{AT}/{f}'")
    con.execute(sql)
    found = [x[0] for x in con.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert sorted(tuple(norm(r[i]) for i in at) for r in con.fetchall()) == rows
