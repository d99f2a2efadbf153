import os

from pyspark.sql import functions as F

from sylvan.api import Engine
from sylvan.cli import main
from sylvan.operators import graph, search, text_search
from sylvan.sources.scan import compile_units, scan_files

A = "def load(x):\n    return trim(x)\n\ndef trim(x):\n    return x\n"
B = "from a import load\n\ndef outer():\n    load(1)\n\ndef lonely():\n    pass\n"


def sources(spark, **texts):
    return spark.createDataFrame([(p.replace("_py", ".py"), t, "python") for p, t in texts.items()], "path string, content string, language string")


def test_index_resolve_ask_and_sync(spark):
    e = Engine.index(spark, sources(spark, a_py=A, b_py=B))
    load = e.bind("load")
    assert e.edges.filter((F.col("kind") == "calls") & (F.col("target") == load)).count() == 1
    assert {r["name"] for r in e.callers("trim").collect()} == {"load"}
    assert {r["name"] for r in e.callees("outer").collect()} == {"load"}
    assert {r["name"] for r in e.uncalled().collect()} == {"outer", "lonely"}
    assert {r["name"] for r in e.impact("trim", 2).collect()} == {"trim", "load", "outer"}
    path = e.trace("outer", "trim")
    assert len(path) == 3 and path[0] == e.bind("outer") and e.trace("trim", "outer") is None
    assert e.search("lo").count() == 2 and e.search("load").first()["rank"] == 0
    assert e.content_search("lonely").first()["path"] == "b.py"
    assert "load" in e.context_markdown("how does load_rows call trim")
    again = e.sync(sources(spark, a_py=A.replace("trim", "cut"), b_py=B))
    assert {r["name"] for r in again.callees("load").collect()} == {"cut"}
    assert {r["name"] for r in again.callees("outer").collect()} == {"load"}, "edges into a changed file are found again"
    gone = again.sync(sources(spark, b_py=B))
    assert gone.nodes.filter("file_path = 'a.py'").count() == 0


def test_scan_index_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a.py").write_text(A)
    (tmp_path / "src" / "skip.py").write_text("def no(): pass\n")
    (tmp_path / "src" / "notes.md").write_text("x")
    (tmp_path / "target" / "b.py").write_text(B)
    (tmp_path / ".gitignore").write_text("skip.py\n")
    found = scan_files(spark, str(tmp_path))
    assert [r["path"] for r in found.select("path").collect()] == ["src/a.py"]
    snap = str(tmp_path / "snap")
    assert main(["index", "--root", str(tmp_path / "src"), "--snapshot", snap]) == 0
    assert main(["callers", "trim", "--snapshot", snap, "--json"]) == 0
    assert '"name":"load"' in capsys.readouterr().out
    assert main(["ctags", str(tmp_path / "tags"), "--snapshot", snap]) == 0
    text = "".join((tmp_path / "tags" / f).read_text() for f in os.listdir(tmp_path / "tags") if f.startswith("part"))
    assert text.startswith("!_TAG_FILE_FORMAT") and "\nload\t" in text
    db = tmp_path / "compile_commands.json"
    db.write_text('[{"directory": "/p", "file": "x.c", "command": "cc -I inc -Ilib x.c"}]')
    assert compile_units(spark, str(db), "/p").first()["include_dirs"] == ["inc", "lib"]


def test_callers_by_id_and_by_name_equal_the_or_join(spark, nodes_df, edges_df):
    nodes = nodes_df([{"id": i, "name": n, "kind": "function", "file_path": "f", "start_line": 1} for i, n in (("1", "a"), ("2", "b"), ("3", "b"), ("4", None))])
    edges = edges_df(
        [{"source": s, "target": t, "kind": "calls", "line": 1, "col": 1} for s, t in (("1", "2"), ("1", "b"), ("1", "b"), ("3", "a"), ("9", "a"), ("2", None), (None, "a"))]
    )
    got = {(r["id"], r["caller_id"]) for r in graph.callers(nodes, edges).collect()}
    n, e = nodes.alias("n"), edges.alias("e")
    want = e.join(n, (F.col("e.target") == F.col("n.id")) | (F.col("e.target") == F.col("n.name"))).join(nodes.alias("s"), F.col("e.source") == F.col("s.id"))
    assert got == {tuple(r) for r in want.select("n.id", "e.source").collect()}
    assert {r["id"] for r in graph.uncalled_functions(nodes, edges).collect()} == {"4"}


def test_bfs_matches_a_walk_and_empty_tables(spark, edges_df, nodes_df):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "y")]
    edges = edges_df([{"source": s, "target": t, "kind": "calls"} for s, t in links])
    got = {r["node"]: r["depth"] for r in graph.bfs(edges, spark.createDataFrame([("a",)], "node string"), "calls", "out", 3).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    back = {r["node"]: r["depth"] for r in graph.bfs(edges, spark.createDataFrame([("d",)], "node string"), "calls", "in", 9).collect()}
    assert back == {"d": 0, "c": 1, "b": 2, "a": 3}
    none = graph.bfs(edges_df([]), spark.createDataFrame([("a",)], "node string"))
    assert none.count() == 1
    assert search.search_symbols(nodes_df([]), "x").count() == 0


def test_clusters_and_positions(spark, nodes_df):
    ranges = spark.createDataFrame([("f", 10, 12), ("f", 22, 25), ("f", 60, 61), ("f", 60, 61), ("g", 1, 2)], "file_path string, start_line int, end_line int")
    got = {tuple(r) for r in text_search.line_clusters(ranges, "file_path").collect()}
    assert got == {("f", 7, 28), ("f", 57, 64), ("g", 1, 5)}
    nodes = nodes_df([{"id": i, "name": i, "kind": "function", "file_path": "f", "start_line": a, "end_line": b, "start_column": 0, "end_column": 9} for i, a, b in (("o", 1, 30), ("i", 5, 9))])
    points = spark.createDataFrame([("f", 6, 1), ("f", 20, 1), ("f", 99, 1), ("f", None, 1)], "file_path string, line int, col int")
    assert {(r["line"], r["id"]) for r in search.innermost_at(nodes, points).collect()} == {(6, "i"), (20, "o")}
    assert {tuple(r) for r in search.enclosing_parent(nodes).collect()} == {("i", "o")}
