import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_stream_leaves_the_same_snapshot_as_the_batch(spark, tmp_path):
    from sylvan.streaming import changes

    schema = "path string, v bigint, x string"
    for i, rows in enumerate([[("a", 1, "old"), ("b", 5, "new")], [("a", 3, "new"), ("b", 2, "late"), (None, 9, "z")], [("c", 1, "new"), ("a", 3, "new")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "feed"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "feed"))
    got = {tuple(r) for r in changes.apply_feed(feed, "path", "v").collect()}
    assert got == {("a", 3, "new"), ("b", 5, "new"), ("c", 1, "new")}


def test_watermarked_windows_equal_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from sylvan.streaming import changes

    rows = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 400).cast("timestamp").alias("ts"), (F.col("id") % 3).cast("string").alias("event_type"))
    rows.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "e"))
    closed = {tuple(r) for r in changes.run_to_table(changes.change_windows(stream), "append", "w").collect()}
    whole = {tuple(r) for r in changes.change_windows(rows).collect()}
    assert closed and closed <= whole


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "p1_found" in e.queries() and "p5_found" in e.queries()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
@pytest.mark.parametrize("name", ["p5_found", "p5_key_stats", "search_prefix", "callers", "bm25_search", "sync_diff"])
def test_query_equals_its_sql(spark, name):
    import glob

    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for p in glob.glob(DATA + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = e.queries()[name](spark, DATA).toPandas()
    want = con.execute(e.oracle_sql()[name]).fetchdf()
    import pandas as pd

    plain = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v == int(v) else v
    norm = lambda df: sorted(str([plain(v) for v in row]) for row in df[sorted(df.columns)].values.tolist())
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_a_feed_goes_on_after_a_restart(spark, tmp_path):
    """Two runs over one growing folder with a durable snapshot equal one run over all of it."""
    from sylvan.staging import scope
    from sylvan.streaming.changes import Book, apply_feed

    schema, source, at = "k string, v bigint, text string", str(tmp_path / "in"), "file://" + str(tmp_path / "snap")

    def feed():
        return spark.readStream.schema(schema).parquet(source)

    first = [(f"k{i % 7}", i, f"a{i}") for i in range(20)] + [(None, 99, "none")]
    spark.createDataFrame(first, schema).write.parquet(source)
    one = {r["k"]: r["v"] for r in apply_feed(feed(), "k", "v", at=at, buckets=4).collect()}
    assert one == {f"k{i}": max(j for j in range(20) if j % 7 == i) for i in range(7)}
    spark.createDataFrame([("k1", 3, "late"), ("k2", 50, "new"), ("k9", 1, "fresh")], schema).write.mode("append").parquet(source)
    with scope():
        got = {r["k"]: r["text"] for r in apply_feed(feed(), "k", "v", at=at, buckets=4).collect()}
    want = {r[0]: r[2] for r in sorted([r for r in first if r[0]], key=lambda r: r[1])} | {"k2": "new", "k9": "fresh"}
    assert got == want
    before = Book(spark, at).read()
    assert {r["k"] for r in apply_feed(feed(), "k", "v", at=at, buckets=4).collect()} == set(want) and Book(spark, at).read()["buckets"] == before["buckets"]


def test_scope_removes_what_it_staged(spark):
    import os

    from sylvan.staging import Staging, scope

    with scope():
        st = Staging(spark, "scoped")
        st.put(spark.range(3), "rows")
        folder = st.base.removeprefix("file://")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)
