import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_call_graph_has_the_calls_out_of_all_symbols(spark):
    import duckdb

    from sylvan.plans import relations

    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    only = " WHERE caller IN (SELECT id FROM cur WHERE kind = 'method')"
    sql = relations.SQL["call_graph"]
    assert only in sql
    methods, every = (sorted(con.execute(q).fetchall()) for q in (sql, sql.replace(only, "")))
    got = sorted(tuple(r) for r in relations.QUERIES["call_graph"](spark, DATA).collect())
    assert got == every and set(methods) < set(got)
