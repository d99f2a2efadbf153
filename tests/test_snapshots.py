from sylvan.api import Engine, metadata, put_metadata
from sylvan.operators import sync

SOURCES = [("src/a.py", "python", "def load(x):\n    return trim(x)\n"), ("src/b.py", "python", 'def trim(x):\n    """Cuts."""\n    return x\n')]
SCHEMA = "path string, language string, content string"


def test_init_is_idempotent_and_old_snapshots_are_read(spark, tmp_path):
    folder = str(tmp_path / "snap")
    assert Engine.init(spark, folder).nodes.count() == 0 and Engine.init(spark, folder).edges.count() == 0
    assert {r["key"]: r["value"] for r in metadata(spark, folder).collect()} == {"schema_version": "1"}
    put_metadata(spark, folder, {"owner": "x", "schema_version": "2"})
    put_metadata(spark, folder, {"owner": None})
    assert {r["key"]: r["value"] for r in metadata(spark, folder).collect()} == {"schema_version": "2"}
    old = str(tmp_path / "old")
    engine = Engine.update(spark, old, spark.createDataFrame(SOURCES, SCHEMA))
    engine.save(old)
    for table, gone in (("nodes", "decorators"), ("files", "errors")):
        rows = spark.read.parquet(f"{old}/{table}.parquet").drop(gone)
        rows.write.parquet(f"{old}/{table}.next")
        spark.read.parquet(f"{old}/{table}.next").write.mode("overwrite").parquet(f"{old}/{table}.parquet")
    again = Engine.open(spark, old)
    assert "decorators" in again.nodes.columns and {r["name"] for r in again.callers("trim").collect()} == {"load"}
    newer = Engine.update(spark, old, spark.createDataFrame([SOURCES[0], ("src/b.py", "python", "def cut(x):\n    return x\n")], SCHEMA))
    assert {r["name"] for r in newer.nodes.collect()} >= {"load", "cut"} and newer.callers("trim").count() == 0


def test_find_and_definition(spark):
    engine = Engine.index(spark, spark.createDataFrame(SOURCES, SCHEMA))
    assert [r["name"] for r in engine.find("kind:function file:b.py tr").collect()] == ["trim"] and engine.find("file:a.py tr").count() == 0
    assert [r["name"] for r in engine.definition("src/a.py", 2, 12).collect()] == ["trim"]
    assert engine.definition("src/a.py", 2, 0).count() == 0 and engine.definition("gone", 1, 0).count() == 0


def test_equal_times_pass_without_a_hash(spark):
    schema = "path string, size bigint, content_hash string, modified_at bigint"
    stored = spark.createDataFrame([("a", 1, "x", 5), ("b", 1, "x", 5), ("c", 1, "x", 5), ("d", 1, "x", None), ("e", 1, "x", 5)], schema)
    scanned = spark.createDataFrame([("a", 1, "y", 5), ("b", 1, "x", 6), ("c", 2, "y", 5), ("d", 1, "y", None)], schema)
    assert {r["path"]: r["state"] for r in sync.classify(stored, scanned, times=True).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "changed", "e": "deleted"}
    assert {r["path"]: r["state"] for r in sync.classify(stored, scanned).collect()}["a"] == "changed"
