import pytest

from sylvan.extract.run import extract_file


def run(path, language, text):
    r = extract_file(path, language, text)
    names = {s.id: s.name for s in r.symbols}
    kinds = {(s.kind, s.name) for s in r.symbols}
    links = {(names.get(e.source, e.source), e.kind, names.get(e.target, e.target)) for e in r.links}
    return r, kinds, links


def test_python():
    r, kinds, links = run("a.py", "python", "import os\n\ndef load(x):\n    return trim(x)\n\ndef trim(x):\n    return x\n\nclass Box(Base):\n    def put(self):\n        load(1)\n")
    assert {("import", "os"), ("function", "load"), ("function", "trim"), ("class", "Box"), ("method", "put")} <= kinds
    assert {("load", "calls", "trim"), ("put", "calls", "load"), ("Box", "contains", "put"), ("Box", "extends", "Base")} <= links
    assert not any(k == "file" for k, _ in kinds)


def test_python_that_does_not_parse_falls_back_to_lines():
    r, kinds, links = run("a.py", "python", "def load(x):\n    trim(x)\n\ndef broken(:\n")
    assert ("function", "load") in kinds and ("load", "calls", "trim") in links
    assert all(e.provenance.startswith("regex") for e in r.links)


def test_typescript():
    r, kinds, links = run(
        "a.ts", "typescript",
        "import { x } from './y';\nexport const pick = async (a: number) => { run(a); };\n@Deco()\nexport class A extends B implements I, J {\n  static m(a: number): number {\n    return new C(a);\n  }\n}\n"
        "interface I { a: string }\ntype Q = string;\nfunction f() { setTimeout(g, 5); }\nfunction g() {}\nexport const K = 5;\n",
    )
    assert {("import", "./y"), ("function", "pick"), ("class", "A"), ("method", "m"), ("interface", "I"), ("type_alias", "Q"), ("constant", "K"), ("file", "a.ts")} <= kinds
    assert {("A", "extends", "B"), ("A", "implements", "J"), ("A", "decorates", "Deco"), ("m", "instantiates", "C"), ("m", "calls", "C"), ("f", "calls", "g")} <= links
    pick = next(s for s in r.symbols if s.name == "pick")
    assert pick.is_async and pick.is_exported


def test_c_members_fields_macros_and_prototypes():
    _, kinds, links = run(
        "a.c", "c",
        "#include <stdio.h>\n# define MAX 5\ntypedef struct {\n  int a;\n  char *b;\n} Thing;\nenum Color { RED, GREEN = 2 };\nstatic int helper(int x) {\n  return x;\n}\nint main(void)\n{\n  helper(3);\n}\nint proto(int a);\n",
    )
    assert {("import", "stdio.h"), ("constant", "MAX"), ("struct", "Thing"), ("field", "a"), ("field", "b"), ("enum_member", "RED"), ("enum_member", "GREEN"), ("function", "main"), ("function", "proto")} <= kinds
    assert ("main", "calls", "helper") in links


def test_cpp_override():
    r, kinds, links = run("a.cpp", "cpp", "namespace n {\nclass Base {\npublic:\n  virtual int run(int a) { return a; }\n};\nclass D : public Base {\npublic:\n  D();\n  ~D();\n  int run(int a) override { return 2; }\n};\nint helper(int q) { return q; }\n}\n")
    assert ("D", "extends", "Base") in links and ("method", "helper") in kinds and ("method", "~D") in kinds
    assert any(e.provenance == "tree-sitter+cpp-override" for e in r.links)


def test_go_rust_shell():
    _, kinds, links = run("a.go", "go", 'package p\nimport (\n  "fmt"\n  x "a/b"\n)\ntype T struct { a int }\ntype I interface { M() }\nfunc (t *T) Run(a int) int {\n  return helper(a)\n}\nfunc helper(a int) int { return a }\n')
    assert {("import", "fmt"), ("import", "a/b"), ("struct", "T"), ("interface", "I"), ("method", "Run")} <= kinds and ("Run", "calls", "helper") in links
    r, kinds, links = run("a.rs", "rust", "use std::fmt::Debug;\n#[derive(Debug)]\npub struct S { a: i64 }\npub trait Tr: Debug { fn m(&self); }\nimpl Tr for S {\n    fn m(&self) { helper(1); println!(\"x\"); }\n}\nfn helper(a: i64) -> i64 { a }\n")
    assert {("import", "std"), ("struct", "S"), ("trait", "Tr"), ("method", "m")} <= kinds
    assert {("S", "implements", "Tr"), ("Tr", "extends", "Debug"), ("m", "calls", "helper"), ("m", "calls", "println!")} <= links
    assert next(s for s in r.symbols if s.name == "S" and s.kind == "struct").decorators == ["derive(Debug)"]
    _, kinds, links = run("a.sh", "shell", "source ./lib.sh\nfoo() {\n  bar 1\n}\nfunction bar {\n  echo x\n}\n")
    assert {("import", "./lib.sh"), ("function", "foo"), ("function", "bar")} <= kinds and ("foo", "calls", "bar") in links


def test_embedded_sql_tables():
    _, _, links = run("a.sc", "esqlc", "int f(int a)\n{\n  EXEC SQL SELECT x INTO :y FROM orders WHERE id = :a;\n  return a;\n}\n")
    assert ("f", "references", "orders") in links


@pytest.mark.parametrize("language", ["c", "cpp", "esqlc", "javascript", "typescript", "tsx", "jsx", "go", "rust", "shell", "python", "unknown"])
@pytest.mark.parametrize("text", ["", "\n", "{", "}}}", "((((", "\"", "class", "fn", "\x00\x01", "a" * 5000])
def test_odd_texts_do_not_fail(language, text):
    extract_file("p/x", language, text)


CALLBACKS = [
    ("a.js", "javascript", "function g() {}\nfunction f(x) {\n  x.then(g, h);\n  other(g);\n}\n", 1),
    ("a.js", "javascript", "function g() {}\nfunction f(x) {\n  x.on('a', g);\n  then(g);\n}\n", 1),
    ("a.js", "javascript", "function g() {}\nfunction f(x) {\n  // setTimeout(g, 1)\n  y = 'setTimeout(g)';\n}\n", 0),
    ("a.py", "python", "def g(): pass\ndef f(xs):\n    threading.Thread(name='x', target=g).start()\n", 1),
    ("a.py", "python", "def g(): pass\ndef f(xs):\n    return sorted(xs(1, 2), key=g)\n", 1),
    ("a.py", "python", "def g(): pass\ndef f(xs):\n    return sorted(g, xs)\n", 0),
    ("a.go", "go", "package p\nfunc g() {}\nfunc f() {\n\thttp.HandleFunc(path(1, 2), g)\n}\n", 1),
    ("a.rs", "rust", "fn g(a: i64) -> i64 { a }\nfn f(x: Vec<i64>) { x.iter().map(g); }\n", 1),
    ("a.c", "c", "void g(int a) { a = 1; }\nint f(void) {\n  pthread_create(&t, attr(1, 2), g, 0);\n  return 0;\n}\n", 1),
    ("a.c", "c", "void g(int a) { a = 1; }\nint f(void) {\n  signal(2, g);\n  return 0;\n}\n", 1),
]


@pytest.mark.parametrize("path,language,text,n", CALLBACKS)
def test_functions_handed_over(path, language, text, n):
    r = extract_file(path, language, text)
    assert sum(e.provenance == "heuristic" for e in r.links) == n


def test_registrations_make_edges_in_the_table(spark):
    from sylvan.extract.run import extract_rows, links_of

    sources = spark.createDataFrame([(p, lang, t) for p, lang, t, n in CALLBACKS[3:4] + CALLBACKS[6:9]], "path string, language string, content string")
    got = links_of(extract_rows(sources)).filter("provenance = 'heuristic'")
    assert {(r["file_path"], r["metadata"]["synthesizedBy"]) for r in got.collect()} == {(p, "callback") for p in ("a.py", "a.go", "a.rs", "a.c")}
