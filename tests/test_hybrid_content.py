import glob
import os

import pytest

from sylvan.operators import hybrid, text_search

DATA = "/root/testdata/sf0.001"
CONTENTS = "path string, content string"


def test_symbols_are_found_through_the_text_of_their_file(spark, nodes_df):
    nodes = nodes_df(
        [
            {"id": "1", "kind": "function", "name": "apply", "qualified_name": "apply", "file_path": "src/a.py", "start_line": 3, "end_line": 8},
            {"id": "2", "kind": "variable", "name": "tmp", "qualified_name": "apply.tmp", "file_path": "src/a.py", "start_line": 5, "end_line": 5},
            {"id": "3", "kind": "function", "name": "far", "qualified_name": "far", "file_path": "src/a.py", "start_line": 300, "end_line": 310},
            {"id": "4", "kind": "function", "name": "other", "qualified_name": "other", "file_path": "src/b.py", "start_line": 1, "end_line": 2},
        ]
    )
    text = "\n\ndef apply():\n    # wallet quota exceeded\n    tmp = 1\n"
    contents = spark.createDataFrame([("src/a.py", text), ("src/a.py", text), ("src/b.py", "def other():\n    pass\n"), (None, "wallet"), ("src/c.py", None)], CONTENTS)
    got = hybrid.hybrid_search(nodes, contents, "wallet quota exceeded").collect()
    assert {r["id"] for r in got} == {"1", "3"} and {r["arm"] for r in got} == {"content"}
    assert got[0]["id"] == "1", "what stands at the hits comes first"
    # a word that is only part of words is no hit of the index: all texts are looked through
    parts = spark.createDataFrame([("src/a.py", "\n\ndef apply():\n    mywalletx()\n")], CONTENTS)
    assert {r["id"] for r in hybrid.hybrid_search(nodes, parts, "wallet").collect()} == {"1", "3"}
    assert hybrid.hybrid_search(nodes, contents.limit(0), "wallet").count() == 0


def test_compound_words_are_ranked_where_their_parts_follow_each_other(spark):
    docs = spark.createDataFrame([("a", "x bind_frame(y)"), ("b", "frame bind"), ("c", "none"), ("d", "bind")], CONTENTS)
    assert {r["path"] for r in text_search.bm25(docs, "path", "content", ["bind_frame"]).collect()} == {"a"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_five_arms_equal_the_sql_with_the_content_arm_added(spark):
    import duckdb

    from sylvan.plans import texts

    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    sql = texts.SQL["hybrid_search"]
    last = "UNION ALL SELECT *, 'compound' FROM a_compound"
    assert last in sql
    sql = sql.replace(", fused AS (", f", {texts.CONTENT_SQL}, fused AS (", 1).replace(last, last + " UNION ALL SELECT *, 'content' FROM a_content", 1)
    want = [tuple(r) for r in con.execute(sql).fetchall()]
    got = [tuple(r) for r in texts.QUERIES["hybrid_search"](spark, DATA).collect()]
    assert sorted(got) == sorted(want) and any(r[-1] == "content" for r in got)
