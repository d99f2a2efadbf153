import pytest

from sylvan.api import Engine
from sylvan.operators import context, resolve

SOURCES = [
    ("app/queue.py", "python", "import os\n\n\ndef drain_queue(lock):\n    # takes the queue lock\n    held = take_lock(lock)\n    return flush_queue(held)\n\n\ndef flush_queue(items):\n    return write_items(items)\n\n\ndef take_lock(lock):\n    return lock\n"),
    ("app/store.py", "python", "def write_items(items):\n    # the queue ends here\n    return len(items)\n\n\ndef unrelated(x):\n    return x\n"),
    ("app/test_queue.py", "python", "def test_drain_queue():\n    drain_queue(None)\n"),
]


@pytest.fixture(scope="module")
def engine(spark):
    seen = {}
    e = Engine.index(spark, spark.createDataFrame(SOURCES, "path string, language string, content string"), progress=lambda stage, n: seen.update({stage: n}))
    assert seen["extracted"]["symbols"] == 7 and "resolved" in seen
    return e


def test_context_has_roots_neighbours_paths_and_code(engine):
    got = engine.build_context("How does drain_queue flush_queue to the store?")
    names = {n["name"]: n["is_root"] for n in got.nodes}
    assert names["drain_queue"] and names["flush_queue"] and "write_items" in names
    assert ["drain_queue", "flush_queue", "write_items"] in got.call_paths
    assert any(b["name"] == "drain_queue" and b["content"].startswith("def drain_queue") and b["content"].rstrip().endswith("return flush_queue(held)") for b in got.code)
    text = got.markdown()
    assert "### Entry Points" in text and "drain_queue → flush_queue → write_items" in text and "```python" in text
    assert '"entryPoints"' in got.json()
    assert engine.build_context("zzzz qqqq").markdown() == "No relevant symbols found."


def test_explore_shows_files_and_relations(engine):
    text = engine.explore("drain_queue flush_queue")
    assert "drain_queue → flush_queue (calls)" in text and "#### app/queue.py" in text and "4\tdef drain_queue(lock):" in text
    assert engine.explore("zzzz") == "No symbols found."
    assert "app/store.py" in engine.explore("ends"), "words that no name begins with are looked for in the texts"


def test_lookups_and_one_file(engine):
    assert engine.file("app/queue.py").count() == 1 and engine.list_files("go").count() == 0 and engine.nodes_of_kind("import").count() == 1
    drain = engine.bind("drain_queue")
    assert {r["kind"] for r in engine.edges_of(drain).collect()} == {"calls"}
    assert {r["id"] for r in engine.node_text_search("flush_queue").collect()} == {engine.bind("flush_queue")}
    changed = engine.sync_file("app/store.py", "def write_all(items):\n    return items\n")
    assert {r["name"] for r in changed.nodes.filter("file_path = 'app/store.py'").collect()} == {"write_all"}
    assert engine.sync_file("app/store.py", SOURCES[1][2]) is engine
    gone = engine.sync_file("app/store.py", None)
    assert gone.file("app/store.py").count() == 0 and gone.callers("write_items").count() == 0
    assert {r["reference_name"] for r in gone.pending(path="app/queue.py", name="write_items").collect()} <= {"write_items"}


def test_budgets_slices_and_blocks():
    assert context.budget_of(context.CONTEXT_BUDGET, 499)[0] == 16_000 and context.budget_of(context.CONTEXT_BUDGET, 5_000)[0] == 32_000
    assert context.budget_of(context.EXPLORE_BUDGET, 14_999)[:2] == (35_000, 12)
    rows = ["int f() {", *[f"  a{i} = {i};" for i in range(200)], "}"]
    assert context.block_end(rows, 1, "c") == 202 and context.block_end(["int f(", "  int a);"], 1, "c") == 2
    assert context.block_end(["def f():", "    x", "", "    y", "z"], 1, "python") == 4
    first, text = context.centred_slice(rows, 1, 202, ("a150 ",), [], 150)
    assert "a150 = 150" in text and len(text) <= 150 and first > 140
    assert context.centred_slice(rows, 1, 202, ("nothing",), [], 150)[0] == 1
    assert context.limited("a\nb", 10) == ("a\nb", False) and context.limited("aaaa\nbbbb\ncccc", 11)[1]
    assert context.call_paths(["a", "c"], [("a", "b"), ("b", "c"), ("c", "a")]) == [["a", "b", "c"], ["c", "a", "b"]]
    assert context.call_paths(["a"], [("a", "b"), ("b", "c")]) == [] and context.call_paths([], []) == []


def test_build_database_decides_in_the_c_family(spark, nodes_df):
    nodes = nodes_df(
        [
            {"id": "u", "kind": "function", "name": "open_dev", "qualified_name": "open_dev", "file_path": "unix/dev.c", "language": "c", "start_line": 1},
            {"id": "w", "kind": "function", "name": "open_dev", "qualified_name": "open_dev", "file_path": "win/dev.c", "language": "c", "start_line": 1},
            {"id": "h", "kind": "struct", "name": "dev", "qualified_name": "dev", "file_path": "win/include/dev.h", "language": "c", "start_line": 1},
            {"id": "g", "kind": "struct", "name": "dev", "qualified_name": "dev", "file_path": "old/dev.h", "language": "c", "start_line": 1},
            {"id": "i", "kind": "import", "name": "../include/dev.h", "qualified_name": "i", "file_path": "win/src/main.c", "language": "c", "start_line": 1, "signature": '#include "../include/dev.h"'},
        ]
    )
    refs = spark.createDataFrame(
        [(1, "x", "open_dev", "calls", "win/src/main.c", "c", None), (2, "x", "dev", "references", "win/src/main.c", "c", None)],
        "ref_seq bigint, from_node_id string, reference_name string, reference_kind string, file_path string, language string, resolution_status string",
    )
    units = spark.createDataFrame([("win/dev.c", "", ["win/include"]), ("win/src/main.c", "", ["win/include"])], "file_path string, directory string, include_dirs array<string>")
    got = {r["reference_name"]: (r["node_id"], r["rule"]) for r in resolve.resolve_groups(refs, nodes, units=units).collect()}
    assert got == {"open_dev": ("w", "build"), "dev": ("h", "build")}
    files = spark.createDataFrame([("win/include/dev.h",), ("old/dev.h",)], "path string")
    links = {(r["file_path"], r["target_path"]) for r in resolve.imported_files(nodes, files, units).collect()}
    assert ("win/src/main.c", "win/include/dev.h") in links
    closure = resolve.include_closure(spark.createDataFrame([("a.c", "b.h"), ("b.h", "c.h")], "file_path string, target_path string"))
    assert {tuple(r) for r in closure.collect()} == {("a.c", "b.h", 0), ("b.h", "c.h", 0), ("a.c", "c.h", 1)}


def test_tags_are_one_sorted_file(engine, tmp_path):
    path = str(tmp_path / "tags")
    engine.write_tags(path, one_file=True)
    lines = open(path, encoding="utf-8").read().split("\n")
    names = [x.split("\t")[0] for x in lines if x and not x.startswith("!")]
    assert lines[0].startswith("!_TAG_FILE_FORMAT") and names == sorted(names) and "drain_queue" in names
