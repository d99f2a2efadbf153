from hypothesis import given
from hypothesis import strategies as st

from sylvan.functions import terms as T
from sylvan.sources.scan import ignored, include_dirs, split_command


def test_patterns():
    assert T.like_pattern("ab") == "ab%" and T.like_pattern("a*b?") == "a%b_" and T.like_pattern("a_b") == "a_b"
    assert T.rank_term("seal_*") == "seal"


def test_words_of_a_query():
    assert T.split_identifier("HTTPServer_parseURL2x") == ["http", "server", "parse", "url2x"]
    assert T.stem_variants("running") == [] or "runn" in T.stem_variants("running")
    assert "parcel" in T.query_terms("the Parcels") and "parcels" in T.query_terms("the Parcels")
    assert T.query_symbols("call a.b_c in Foo now") == ["Foo", "a.b_c", "b_c"]
    assert T.parse_query("kind:Class file:x.py foo bar") == ("class", "x.py", ["foo", "bar"])
    assert T.term_groups(["queue", "queues", "lock"])[0] == ["queues", "queue"]
    assert T.identifier_at("foo(bar_1)", 5) == "bar_1"


@given(st.text(max_size=40))
def test_splitting_never_fails_and_is_lower_case(text):
    assert all(p == p.lower() and len(p) >= 3 for p in T.split_identifier(text))


def test_build_database_arguments():
    assert split_command(r"""cc -I"a b" -I 'c' d\ e""") == ["cc", "-Ia b", "-I", "c", "d e"]
    assert include_dirs(["cc", "-Iinc", "-isystem", "/usr/x", "/Iw"], "/p/src", "/p") == ["src/inc", "src/w", "/usr/x"]


def test_ignore_rules_last_one_decides():
    rules = [(".", "*.log", False), (".", "out/", False), ("a", "!keep.log", True), (".", "/top.c", False)]
    rules[2] = ("a", "keep.log", True)
    assert ignored("x/y.log", rules) and ignored("out/a.c", rules) and not ignored("a/keep.log", rules)
    assert ignored("top.c", rules) and not ignored("b/top.c", rules)


def test_ignore_rules_as_patterns():
    rules = [(".", "*.log", False), (".", "!keep.log", False), (".", "out/", False), (".", "/top.c", False), ("a", "b/**/x?.py", False), (".", "z[0-9].c", False), (".", "**/gen/*.ts", False)]
    rules[1] = (".", "keep.log", True)
    for path, want in [("q/r.log", True), ("q/keep.log", False), ("out/x", True), ("p/out/x", True), ("out", False), ("p/top.c", False), ("a/b/c/d/x1.py", True), ("a/b/x1.py", True), ("b/x1.py", False),
                       ("m/z7.c", True), ("m/zz.c", False), ("k/gen/a.ts", True), ("k/gen/a/b.ts", False), ("a(b)/x.c", False)]:
        assert ignored(path, rules) is want, path


def test_bytes_that_are_no_utf8_become_the_replacement_character(spark, tmp_path):
    from sylvan.api import Engine
    from sylvan.sources.scan import scan_files

    (tmp_path / "a.py").write_bytes(b"# caf\xe9\ndef load(x):\n    return trim(x)\n")
    (tmp_path / "b.py").write_bytes(b"def trim(x):\n    return x\n")
    (tmp_path / "skip.py").write_bytes(b"def gone(x):\n    return x\n")
    (tmp_path / ".gitignore").write_text("skip*\n")
    found = scan_files(spark, str(tmp_path))
    assert {r["path"]: r["content"][:6] for r in found.collect()} == {"a.py": "# caf\ufffd", "b.py": "def tr"}
    engine = Engine.index(spark, found)
    assert {r["name"] for r in engine.callers("trim").collect()} == {"load"}
