"""Small projects and the symbols and relations that must come out of them, as tables."""

import pytest

from sylvan.extract.run import extract_file, extract_rows, links_of, nodes_of

SHAPES = {
    "python chain": ("a.py", "python", "import json\n\n\ndef load(x):\n    return parse(x)\n\n\ndef parse(x):\n    return x\n\n\nclass Box:\n    def put(self, x):\n        return load(x)\n",
        {("import", "json", 1, 1), ("function", "load", 4, 5), ("function", "parse", 8, 9), ("class", "Box", 12, 14), ("method", "put", 13, 14)},
        {("load", "calls", "parse"), ("put", "calls", "load"), ("Box", "contains", "put")}),
    "rust chain": ("a.rs", "rust", "use std::fmt;\n\nfn load(x: i64) -> i64 {\n    parse(x)\n}\n\nfn parse(x: i64) -> i64 {\n    x\n}\n\npub struct Box1;\n\nimpl Box1 {\n    pub fn put(&self) {\n        load(1);\n    }\n}\n",
        {("import", "std", 1, 1), ("function", "load", 3, 5), ("function", "parse", 7, 9), ("struct", "Box1", 11, 11), ("method", "put", 14, 16)},
        {("load", "calls", "parse"), ("put", "calls", "load")}),
    "typescript types": ("a.ts", "typescript", "import { q } from './q';\nexport interface Shape {\n  side: number;\n}\nexport type Name = string;\nfunction area(s: Shape) {\n  return grow(s);\n}\nfunction grow(s: Shape) {\n  return s;\n}\n",
        {("import", "./q", 1, 1), ("interface", "Shape", 2, 4), ("type_alias", "Name", 5, 5), ("function", "area", 6, 8), ("function", "grow", 9, 11)},
        {("area", "calls", "grow")}),
    "tsx component": ("a.tsx", "tsx", "import React from 'react';\nexport function Panel() {\n  return draw();\n}\nfunction draw() {\n  return null;\n}\n",
        {("import", "react", 1, 1), ("function", "Panel", 2, 4), ("function", "draw", 5, 7)}, {("Panel", "calls", "draw")}),
    "go receiver": ("a.go", "go", "package p\n\nimport \"fmt\"\n\ntype Ring struct {\n\tn int\n}\n\nfunc (r *Ring) Take() int {\n\treturn count(r)\n}\n\nfunc count(r *Ring) int {\n\treturn r.n\n}\n",
        {("import", "fmt", 3, 3), ("struct", "Ring", 5, 7), ("method", "Take", 9, 11), ("function", "count", 13, 15)}, {("Take", "calls", "count")}),
    "c include": ("a.c", "c", "#include <stdio.h>\nstruct pair { int a; int b; };\nint twice(int a)\n{\n  return plus(a, a);\n}\nint plus(int a, int b)\n{\n  return a + b;\n}\n",
        {("import", "stdio.h", 1, 1), ("struct", "pair", 2, 2), ("function", "twice", 3, 6), ("function", "plus", 7, 10)}, {("twice", "calls", "plus")}),
    "old style function with branches": ("a.sc", "esqlc", "int scan(a, b)\nint a;\nchar *b;\n{\n#ifdef UNIX\n  if (a) {\n#else\n  if (b) {\n#endif\n    first(a);\n  }\n  second(b);\n  return third(a);\n}\n\nint after(int q)\n{\n  return q;\n}\nEXEC SQL SELECT x INTO :y FROM ledger;\n",
        {("function", "scan", 1, 14), ("function", "after", 16, 19)}, {("scan", "calls", "first"), ("scan", "calls", "second"), ("scan", "calls", "third"), ("a.sc", "references", "ledger")}),
    "struct for the preprocessor": ("b.sc", "esqlc", "## typedef struct {\n##   int amount;\n     char *label;\n## } Entry;\nEXEC SQL COMMIT;\n",
        {("struct", "Entry", 1, 4), ("field", "amount", 2, 2), ("field", "label", 3, 3)}, {("Entry", "contains", "amount"), ("Entry", "contains", "label")}),
    "shell": ("a.sh", "shell", "source ./lib.sh\nstart() {\n  check now\n}\nfunction check {\n  echo 1\n}\n",
        {("import", "./lib.sh", 1, 1), ("function", "start", 2, 4), ("function", "check", 5, 7)}, {("start", "calls", "check")}),
    "initializer names a function": ("a.c", "c", "int run(int a) { return a; }\nstatic int (*table[])(int) = {\n  run,\n};\n", {("function", "run", 1, 1)}, {("a.c", "references", "run")}),
    "functions in a namespace": ("a.cpp", "cpp", "namespace tool {\nclass Box {\npublic:\n  int put(int a) { return a; }\n};\nint twice(int a) { return a; }\n}\n",
        {("namespace", "tool", 1, 7), ("class", "Box", 2, 5), ("method", "put", 4, 4), ("method", "twice", 6, 6)}, {("tool", "contains", "Box"), ("Box", "contains", "put")}),
    "named by typedef": ("a.c", "c", "#include <a.h>\n#include \"b.h\"\ntypedef struct { int x; } Point;\ntypedef enum { ON, OFF } State;\n",
        {("import", "a.h", 1, 1), ("import", "b.h", 2, 2), ("struct", "Point", 3, 3), ("enum", "State", 4, 4), ("enum_member", "ON", 4, 4), ("enum_member", "OFF", 4, 4)}, {("Point", "contains", "x")}),
    "macros": ("a.c", "c", "#define SIZE 8\n#define TWICE(a) ((a) + (a))\n#  define WIDE 1\n", {("constant", "SIZE", 1, 1), ("constant", "TWICE", 2, 2), ("constant", "WIDE", 3, 3)}, set()),
    "members of a c++ class": ("a.cpp", "cpp", "class Box {\npublic:\n  Box();\n  ~Box();\n  int put(int a);\n  bool operator==(const Box &o);\n  int count;\n};\n",
        {("class", "Box", 1, 8), ("method", "Box", 3, 3), ("method", "~Box", 4, 4), ("method", "put", 5, 5), ("field", "count", 7, 7)}, {("Box", "contains", "put"), ("Box", "contains", "count")}),
    "rust traits": ("a.rs", "rust", "pub trait Base {}\npub trait Shape: Base {\n    fn area(&self) -> i64;\n}\nstruct Square;\nimpl Shape for Square {\n    fn area(&self) -> i64 { 1 }\n}\nimpl Square {\n    fn side(&self) {}\n}\n",
        {("trait", "Base", 1, 1), ("trait", "Shape", 2, 4), ("struct", "Square", 5, 5), ("method", "side", 10, 10)}, {("Shape", "extends", "Base"), ("Square", "implements", "Shape")}),
    "script constants": ("a.ts", "typescript", "export const pick = (a: number) => a + 1;\nconst grab = async function (b) {\n  return b;\n};\nexport const LIMIT = 5;\nconst table = { a: 1 };\n",
        {("function", "pick", 1, 1), ("function", "grab", 2, 4), ("constant", "LIMIT", 5, 5)}, set()),
    "extends and implements": ("a.ts", "typescript", "class Box extends Base implements One, Two {\n}\n", {("class", "Box", 1, 2)}, {("Box", "extends", "Base"), ("Box", "implements", "One"), ("Box", "implements", "Two")}),
    "decorators stay with their class": ("a.ts", "typescript", "@One()\nclass A {\n  @Two()\n  run() {\n    return 1;\n  }\n}\n@Three()\nclass B {\n}\n",
        {("class", "A", 2, 7), ("method", "run", 4, 6), ("class", "B", 9, 10)}, {("A", "decorates", "One"), ("run", "decorates", "Two"), ("B", "decorates", "Three")}),
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_shape(name):
    path, language, text, symbols, links = SHAPES[name]
    r = extract_file(path, language, text)
    named = {s.id: s.name for s in r.symbols}
    assert symbols <= {(s.kind, s.name, s.start_line, s.end_line) for s in r.symbols}
    assert links <= {(named.get(e.source, e.source), e.kind, named.get(e.target, e.target)) for e in r.links}


def test_decorators_of_one_class_are_not_of_another():
    r = extract_file(*SHAPES["decorators stay with their class"][:3])
    named = {s.id: s.name for s in r.symbols}
    assert sorted((named[e.source], e.target) for e in r.links if e.kind == "decorates") == [("A", "One"), ("B", "Three"), ("run", "Two")]


def test_the_table_holds_what_single_files_give(spark):
    rows = [(f"{i}/{p}", lang, text) for i, (p, lang, text, _, _) in enumerate(SHAPES.values())]
    got = extract_rows(spark.createDataFrame(rows, "path string, language string, content string")).persist()
    want_nodes = sum(len({s.id for s in extract_file(*r).symbols}) for r in rows)
    want_links = sum(len(extract_file(*r).links) for r in rows)
    assert nodes_of(got).count() == want_nodes and links_of(got).count() == want_links
    got.unpersist()


def test_qualified_names_and_flags():
    r = extract_file("b.sc", "esqlc", SHAPES["struct for the preprocessor"][2])
    assert {s.qualified_name for s in r.symbols if s.kind == "field"} == {"b.sc#Entry::amount", "b.sc#Entry::label"}
    r = extract_file("a.ts", "typescript", SHAPES["script constants"][2])
    flags = {s.name: (s.is_exported, s.is_async) for s in r.symbols if s.kind == "function"}
    assert flags == {"pick": (True, False), "grab": (False, True)}


def test_imported_function_is_resolved_across_files_and_platforms(spark):
    from sylvan.api import Engine

    rows = [
        ("src/lib.py", "python", "def trim(x):\n    return x\n"),
        ("src/use.py", "python", "from lib import trim\n\n\ndef load(x):\n    return trim(x)\n"),
        ("zq_unix_win/zq.c", "c", "int open_queue(int a)\n{\n  return a;\n}\n"),
        ("zq_vms/zq.c", "c", "int open_queue(int a)\n{\n  return a + 1;\n}\n"),
        ("app/main.c", "c", "#define Fold(a) (a)\nint helper(int a)\n{\n  return a;\n}\nint run(int a)\n{\n  printf(\"x\");\n  LIMIT(a);\n  Fold(a);\n  helper(a);\n  return open_queue(a);\n}\n"),
    ]
    engine = Engine.index(spark, spark.createDataFrame(rows, "path string, language string, content string"))
    trim = engine.bind("trim")
    assert {(r["target"], r["provenance"]) for r in engine.edges.filter("kind = 'calls'").join(engine.nodes.filter("name = 'load'").selectExpr("id AS source"), "source").collect()} == {(trim, "tree-sitter+resolved-cross-file")}
    opened = {r["file_path"] for r in engine.callees("run").collect() if r["name"] == "open_queue"}
    assert "zq_unix_win/zq.c" in opened
    target = {r["target"] for r in engine.edges.filter("kind = 'calls' AND provenance = 'tree-sitter+resolved-cross-file'").collect()}
    paths = {r["id"]: r["file_path"] for r in engine.nodes.filter("name = 'open_queue'").collect()}
    assert {paths[t] for t in target if t in paths} == {"zq_unix_win/zq.c"}
    queued = {r["reference_name"] for r in engine.unresolved_refs.collect()}
    assert not queued & {"printf", "LIMIT", "helper"}


def test_long_runs_of_words_are_read_in_linear_time():
    import time

    began = time.perf_counter()
    extract_file("a.c", "c", "int f(a) " + "word " * 40_000 + "\n" + "x, " * 40_000 + "\n")
    extract_file("a.c", "c", "int f(a)\nint a;\nchar b ;\n{\n  g(a);\n}\n" * 300)
    assert time.perf_counter() - began < 20


def test_many_symbols_in_one_file_are_placed_in_linear_time():
    import time

    n = 4000
    began = time.perf_counter()
    r = extract_file("a.js", "javascript", "".join(f"function f{i}(a) {{\n  const q = g{i}(a);\n  return q;\n}}\n" for i in range(n)))
    assert sum(e.kind == "calls" for e in r.links) == n
    r = extract_file("a.c", "c", "".join(f"struct s{i} {{ int a{i}; int b{i}; }};\n" for i in range(n)))
    assert sum(s.kind == "field" for s in r.symbols) == 2 * n and time.perf_counter() - began < 10


def test_the_innermost_body_counts():
    from sylvan.extract.model import Result

    out = Result("a", "c")
    outer = out.add("class", "outer", 1, 9, offset=0, stop=100)
    inner = out.add("function", "inner", 3, 4, offset=30, stop=40)
    late = out.add("function", "late", 2, 6, offset=20, stop=60)
    assert out.around(35) is inner and out.around(45) is late and out.around(70) is outer and out.around(101) is None
    assert out.around(35, ("class",)) is outer and out.around(0) is None and inner.outer is late
