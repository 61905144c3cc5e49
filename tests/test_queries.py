import os

import duckdb
import pytest

from docsieve.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns) and not got.isEmpty()
    cols = sorted(got.columns)
    quoted = [f'"{c}"' for c in cols]
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want.select(*quoted).fetchall()))


def test_entry_lists_all_queries():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
