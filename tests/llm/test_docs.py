import pytest
from pyspark.sql import functions as F

from sylvan.llm.doc_pairs import code_description_pairs, documented_functions
from sylvan.llm.docs import describe, parse_signature

SIG = "def merge_queue(self, tray: int, lock) -> Widget:"


@pytest.mark.parametrize(
    "doc",
    [
        "", "   ", '"""-"""', "/**\n * \n */", "# ======", "merge queue", "Merge queue!", "Merges the queue.", "The merge queue function.", "merge_queue merges queue.",
        "This function is used to merge the queue.", SIG, "TODO", "TODO(me): write docs", "FIXME slow.", "XXX rename.", "noqa: E501", "type: ignore", "pylint: disable=x", "eslint-disable-next-line y",
        "clang-format off", "@override", "@internal", "{@inheritDoc}", "@deprecated", "see above", "See merge_all().", "ditto", "n/a", "tbd", "...", "Description.", "No description available.",
        "Description à venir.", "Por documentar.", "Beschreibung folgt.", "Copyright 2015 the x contributors. All rights reserved.", "Args:\n    tray: the tray\n    lock: the lock",
        ":param tray: tray\n:param lock: lock\n:returns:", "@param tray\n@param lock\n@return", "Function: merge_queue\nParameters: tray, lock\nReturns: \nNotes: ", "Auto-generated method stub",
        "Unless agreed otherwise in writing, the material is handed out as it is, without conditions of any kind.",
    ],
)
def test_says_nothing(doc):
    assert describe(doc, "merge_queue", SIG, "python")[1] is None


@pytest.mark.parametrize(
    "doc",
    [
        "Merge queue without taking the lock; callers must hold it.", "TODO: cover the empty case.\nCounts the bytes left over.", ":param tray: upper bound, exclusive\n:returns:", "@return how many of them were taken",
        "merge_queue: Returns -1 once it is drained.", "/// Not safe for concurrent use.", "Args:\n    tray: ownership passes to the callee", "Renvoie les 8 derniers éléments.", "Returns:\n    Keeps the 3 most recent entries.",
        "Copyright 2015 x. All rights reserved.\n\nSorts by arrival time.", ":raises ValueError: if the ring is full",
    ],
)
def test_says_something(doc):
    assert describe(doc, "merge_queue", SIG, "python")[1]


def test_signatures():
    f = parse_signature("func (s *Ring) Take(n int, names []string) (int, error)", "Take", "go")
    assert f.params == [("n", "int"), ("names", "[]string")] and f.returns.startswith("(int")
    f = parse_signature("int f(int a, const std::map<int, int> &b)", "f", "cpp")
    assert [p for p, _ in f.params] == ["a", "b"]
    f = parse_signature("pub fn f(&self, a: i64) -> i64", "f", "rust")
    assert ("a", "i64") in f.params
    assert parse_signature("nothing", "f", "c").params == []


def test_operator_takes_current_rows_and_cuts_code(spark, nodes_df):
    doc = "Sorts by arrival time."
    rows = [
        {"id": "a", "kind": "function", "name": "f", "signature": "def f(x):", "docstring": "tbd", "updated_at": 1},
        {"id": "a", "kind": "function", "name": "f", "signature": "def f(x):", "docstring": doc, "updated_at": 2, "file_path": "p", "start_line": 2, "end_line": 3},
        {"id": "a", "kind": "function", "name": "f", "signature": "def f(x):", "docstring": doc, "updated_at": 2, "file_path": "p", "start_line": 2, "end_line": 3},
        {"id": "b", "kind": "method", "name": "g", "signature": "  ", "docstring": doc, "updated_at": 1},
        {"id": "c", "kind": "method", "name": None, "signature": "def g():", "docstring": doc + " x" * 20000, "updated_at": None, "file_path": "gone", "start_line": None},
        {"id": "d", "kind": "class", "name": "g", "signature": "class g", "docstring": doc, "updated_at": 1},
        {"id": "e", "kind": "function", "name": "g", "signature": "def g():", "docstring": None, "updated_at": 1},
        {"id": None, "kind": "function", "name": "g", "signature": "def g():", "docstring": doc, "updated_at": 1},
    ]
    nodes = nodes_df(rows).withColumn("description", F.lit(1)).withColumn("r", F.lit(2))
    contents = spark.createDataFrame([("p", "one\r\ntwo\r\nthree\r\nfour"), ("p", "one\r\ntwo\r\nthree\r\nfour"), (None, "x")], "path string, content string")
    got = {r["node_id"]: r for r in code_description_pairs(nodes, contents).collect()}
    assert set(got) == {"a", "c"}
    assert got["a"]["code"] == "two\nthree" and got["c"]["code"] == "def g():" and got["a"]["description"] == doc
    assert documented_functions(nodes_df([]), contents).count() == 0 and documented_functions(nodes, contents.limit(0)).count() == 2


@pytest.mark.parametrize(
    "doc",
    ["Computes the license fee for a patent holder.", "Licensed content is copied to the shared cache before patent lookup.", "Checks the warranties of a contract for gaps.", "Redistributes the load over all shards."],
)
def test_statements_about_licences_are_statements(doc):
    assert describe(doc, "merge_queue", SIG, "python")[1]


@pytest.mark.parametrize("doc,name", [("Gibt den Wert zurück.", "get_wert"), ("Gets or sets the given value for this object.", "value"), ("Licensed under the MIT license.", "f"), ("This program is distributed without any warranty.", "f")])
def test_echoes_and_notices(doc, name):
    assert describe(doc, name, f"def {name}(self):", "python")[1] is None


SOURCES = [
    ("python", '@deco\ndef load(a: int, *rest) -> str:\n    """Reads it."""\n    def inner():\n        pass\n    return a\n', [("load", 2, 6, ["a : int", "* rest"], '"""Reads it."""'), ("inner", 4, 5, [], None)]),
    ("python", "# far\n\n# near\n# by\n@deco\nasync def go(x): return x\n", [("go", 6, 6, ["x"], "# near\n# by")]),
    ("c", "/* head */\nint a;\n/** Adds.\n * Two.\n */\nstatic int add(int a, int b)\n{\n  return a + b;\n}\n", [("add", 6, 9, ["int a", "int b"], "/** Adds.\n * Two.\n */")]),
    ("cpp", "class A {\n public:\n  // Runs.\n  int run(std::map<int, int> m) { return 1; }\n};\n", [("run", 4, 4, ["std :: map < int , int > m"], "// Runs.")]),
    ("go", "package p\n\n// Take takes.\nfunc (r *Ring) Take(n int, s []string) (int, error) {\n\treturn n, nil\n}\n", [("Take", 4, 6, ["n int", "s [ ] string"], "// Take takes.")]),
    ("rust", "/// Doc.\n#[inline]\npub fn f(a: i64) -> i64 {\n    a\n}\n", [("f", 3, 5, ["a : i64"], "/// Doc.")]),
    ("typescript", "// One.\nexport function f(a: number): number {\n  return a;\n}\nclass C {\n  /* Two. */\n  m(b?: string) { return /x/.test(b); }\n}\n// Three.\nconst g = async (x) => { return x; };\n",
     [("f", 2, 4, ["a : number"], "// One."), ("m", 7, 7, ["b ? : string"], "/* Two. */"), ("g", 10, 10, ["x"], "// Three.")]),
    ("shell", "# Starts.\nstart() {\n  echo 1\n}\nfunction stop {\n  echo 2\n}\n", [("start", 2, 4, [], "# Starts."), ("stop", 5, 7, [], None)]),
]


@pytest.mark.parametrize("language,text,want", SOURCES)
def test_function_nodes(language, text, want):
    from sylvan.llm.syntax import check_source, functions_of

    assert check_source(text, language)[0]
    assert [(f.name, f.line, f.end_line, f.params, f.doc) for f in functions_of(text, language)] == want


def test_pairs_come_from_the_tree(spark, nodes_df):
    text = "int x;\n\n// Sorts by arrival time.\nint order(int a) {\n  return a;\n}\n"
    rows = [
        {"id": "a", "kind": "function", "name": "order", "signature": "int order(int a)", "docstring": "Sorts by arrival time.", "language": "c", "updated_at": 1, "file_path": "r/a.c", "start_line": 4, "end_line": 5},
        {"id": "b", "kind": "function", "name": "gone", "signature": "int gone(int a)", "docstring": "Sorts by arrival time.", "language": "c", "updated_at": 1, "file_path": "r/a.c", "start_line": 9, "end_line": 9},
    ]
    got = {r["node_id"]: r for r in code_description_pairs(nodes_df(rows), spark.createDataFrame([("r/a.c", text)], "path string, content string")).collect()}
    assert (got["a"]["range_from"], got["a"]["doc_from"], got["a"]["end_line"]) == ("tree", "tree", 6) and got["a"]["code"] == "int order(int a) {\n  return a;\n}"
    assert (got["b"]["range_from"], got["b"]["code"]) == ("row", "int gone(int a)")
