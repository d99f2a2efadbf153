import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.llm.syntax import LANGUAGES, canonical_language, check_source

GOOD = {
    "python": "import os\nfrom . import x as y\n\n@dec(1)\nasync def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    '''doc {'''\n    x = [i for i in range(3) if i]\n    y: dict[str, int] = {**e, 'a': 1}\n    if (n := len(x)) > 1 and not x is None: pass\n    elif x: return lambda q, *r: q\n    with open('a') as f, g(): pass\n    try:\n        del x[0], y\n    except* (A, B) as z:\n        raise E from z\n    finally:\n        print(f'{x!r:>{n}} {'in'}')\n    match x:\n        case [1, *_] if y: return 1\n    return x if y else await z\n",
    "c": "#include <a.h>\n#define M(x) {{ (x\ntypedef struct { int a : 3; char *b[4]; void (*cb)(int, ...); } T;\nenum E { A = 1 << 2, B, };\nstatic const char *s = \"<<<<<<< (\" \"x\";\nint f(a, b) int a; char *b; { return a; }\nint g(int x, const char *y) {\n  T t = { .a = 1, .b = { 0 } };\n  for (int i = 0; i < 3; i++) { if (x > 2) continue; else break; }\n  do { x--; } while (x);\n  switch (x) { case 1: case 2: x = (int)y[0]; break; default: goto out; }\n  x = x ? y ? 1 : 2 : sizeof(int *);\nout:\n  return (T *)0 == 0 ? x : -x;\n}\n",
    "cpp": "#include <v>\nnamespace a::b {\ntemplate <typename T, int N = 3> class X : public Y<T>, private Z {\npublic:\n  X(int a) : a_(a), b_{1} {}\n  virtual ~X() noexcept override = default;\n  bool operator==(const X &o) const { return a_ == o.a_; }\n  std::vector<std::vector<int>> v() const;\nprivate:\n  int a_ = 1, b_;\n};\n}\nint main() {\n  auto f = [&](int q) mutable -> int { return q; };\n  for (const auto &x : v) std::cout << x << std::endl;\n  std::map<int, std::string> m{{1, \"a\"}};\n  try { throw E(1); } catch (const E &e) {}\n  return static_cast<int>(f(2)) + new int[3][0];\n}\n",
    "esqlc": "int f(int a)\n{\n  EXEC SQL BEGIN DECLARE SECTION;\n  int b;\n  EXEC SQL END DECLARE SECTION;\n  EXEC SQL SELECT x INTO :b FROM t WHERE id = :a;\n  return b;\n}\n",
    "go": "package p\n\nimport (\n\t\"a\"\n\tx \"b/c\"\n)\n\nconst (\n\tA = iota\n\tB\n)\n\ntype T struct {\n\ta, b int `json:\"a\"`\n\t*U\n}\n\ntype I interface {\n\tM(a int) (int, error)\n\t~int | string\n}\n\nfunc (t *T) F(a, b int, c ...string) (r int, err error) {\n\tm := map[string][]int{\"a\": {1, 2}}\n\tif v, ok := m[\"a\"]; ok && len(v) > 0 {\n\t\treturn v[0], nil\n\t} else if x := (T{a: 1}); x.a > 1 {\n\t}\n\tfor i := range m {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch y := z.(type) {\n\tcase int, *T:\n\t\tfallthrough\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\treturn\n}\n\nfunc G[K comparable, V any](m map[K]V) []V { return nil }\n",
    "javascript": "#!/usr/bin/env node\nimport a, { b as c } from './x';\nexport default class A extends B {\n  #p = 1;\n  static { init(); }\n  static async *gen() { yield* x; }\n  get v() { return this.#p }\n}\nconst { q = 1, ...rest } = o, f = async (x, [y]) => ({ ...x, y }), g = z => z ** 2\nlet r = /[/\\]]+/gi.test(s) ? `a${b ? `c${d}` : ''}` : a?.b?.[0] ?? 1\nlabel: for (const k of ks) { if (!k) continue label; else break }\nfor (var i = 0, n = 3; i < n; i++);\ntry { throw new E } catch { } finally { }\nswitch (x) { case 1: default: }\nexport { a as default }\n",
    "jsx": "export const A = ({ x }) => <div className=\"a\" {...x}>it's {x.map((y) => <B key={y} />)} <></></div>;\n",
    "typescript": "import type { T } from './t';\nexport abstract class A<T extends object = {}> implements I, J<T> {\n  private readonly x?: string;\n  constructor(public a: number, private b?: T) { super(); }\n  abstract m(): void;\n  get<K extends keyof T>(k: K): T[K] | undefined { return this.b![k] as T[K]; }\n}\ninterface I { (a: string): number; [k: string]: unknown; readonly m?: () => Promise<Array<Map<string, number>>> }\ntype C<T> = T extends (infer U)[] ? { [K in keyof U]?: U[K] } : never;\nenum E { A = 1, B }\ndeclare module 'x' { export function f(a: string): asserts a is 'b'; }\nlet v = <const>['a'], w = f<string>(1), u = x satisfies Y;\nfunction g(this: Window, a: string, ...r: number[]): a is string;\n",
    "tsx": "const A = <T,>(p: { x: T }): JSX.Element => <B<T> x={p.x as T}>a {'b'}</B>;\n",
    "rust": "//! doc\nuse std::{fmt::{self, Debug as D}, io::*};\n#[derive(Debug)]\npub(crate) struct S<'a, T: D + 'a> where T: Copy { pub a: &'a [T; 3], b: Option<Box<dyn Fn(i64) -> i64 + Send>> }\nenum E { A, B(i32, String), C { x: u8 } = 3 }\nimpl<'a, T> fmt::Display for S<'a, T> {\n    fn fmt(&self, f: &mut fmt::Formatter<'_>) -> fmt::Result { write!(f, \"{}\", self.a[0])?; Ok(()) }\n}\nfn f<const N: usize>(x: impl Into<String>, mut y: i64) -> Result<(), Box<dyn E>> {\n    let v: Vec<i64> = (0..10).map(|i| i * 2).filter(|&i| i != 4).collect::<Vec<_>>();\n    if let Some(z) = v.first() && y > 1 { y += *z as i64; } else { return Err(\"a\".into()); }\n    'outer: loop { while y < 3 { break 'outer; } }\n    match y { 0 | 1 => {}, n @ 2..=9 if n > 3 => y = n, E::C { x, .. } => (), _ => unreachable!() }\n    let c = 'x'; let r = r#\"a\"b\"#; let s = S { a: &[1], ..d };\n    unsafe { *p = 1 };\n    v.iter().for_each(move |q| println!(\"{q}\"));\n    Ok(())\n}\nmacro_rules! m { ($a:expr) => { $a } }\n",
    "shell": "#!/bin/bash\nset -e\nsource ./a.sh\nf() {\n  local x=\"$(echo \"${1:-a b}\" | tr a b)\" y='it'\n  if [ \"$1\" -gt 2 ] && [[ $x == *.c ]]; then echo \"a\" > /dev/null 2>&1; elif true; then :; else return 1; fi\n}\nfunction g { for i in 1 2; do echo $i; done; while read -r l; do echo \"$l\"; done < f; }\ncase \"$1\" in\n  a|b) echo x ;;\n  *) echo y\nesac\ncat <<EOF | grep a\nif then ((( \" '\nEOF\na=(1 2) ; (( i++ )) ; ( cd x && ls ) & wait\n",
}
BAD = {
    "python": ["def f(:\n  pass\n", "x = (1,\n", "if x:\ny\n", "  x = 1\n", "a = '''never\n", "try:\n    a\nb\n", "print 'x'\n", "def f():\n\ta\n        b\n", "f() = 1\n", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n"],
    "c": ["int f(int a) {\n  return a;\n", "int f() { ) ] }\n", "/* never\nint a;\n", "int f() { char *s = \"a; }\n", "# Title\n\n* some words here.\n", "int f() { return }\n}\n", "int f() {\n<<<<<<< HEAD\n}\n"],
    "cpp": ["class A {\npublic:\n  int f() {\n};\n", "import x\ndef f(a):\n    return 1\n"],
    "esqlc": ["int f() { EXEC SQL SELECT a }\n"],
    "go": ["package p\nfunc f() {\n\tx := \n}\n", "package p\nfunc f() {\n]]\n}\n", "package p\nfunc f() int {\n\treturn 1\n", "func f() {}\nx = 1\n"],
    "javascript": ["function f( {", "const a = ;", "a b c", "f(() => {", "`never ${a", "{\n  \"a\": 1\n  \"b\": 2\n}\n", "let a: number = 1", "<p>x</p>"],
    "jsx": ["const a = <div>x</span>;", "return <div"],
    "typescript": ["interface A { x: }", "class A { m(): void {", "let x = 1 +;"],
    "tsx": ["const a = <div>{x</div>;"],
    "rust": ["fn f() { let x = ; }", "fn f() -> i64 {\n    1\n", "Traceback of run 7 follows:\n", "fn f() { } } )\n", "/* /* */\nfn f() {}\n"],
    "shell": ["if true; then\n  echo\n", "f() {\n  echo\n", "echo 'never\n", "fi\n", "for x in 1; do echo\n", "<<<<<<< HEAD\necho\n", "echo $(ls\n", "<p>a b</p>\n"],
}


@pytest.mark.parametrize("language", sorted(LANGUAGES))
def test_valid_source_is_accepted(language):
    assert check_source(GOOD[language], language) == (True, None, [])


@pytest.mark.parametrize("language,text", [(k, t) for k, ts in BAD.items() for t in ts])
def test_broken_source_is_rejected(language, text):
    ok, cause, errors = check_source(text, language)
    assert not ok and cause and errors and errors == sorted(errors)


def test_causes_spellings_and_what_counts_as_valid():
    assert check_source("def f():\n    return (1", "python")[1] in ("truncated", "unexpected token")
    assert check_source("int f() {\n", "c")[1] == "truncated"
    assert check_source("int a;\n<<<<<<< HEAD\nint b;\n", "c")[1] == "unresolved merge"
    assert check_source("/* x", "go")[1] == "unterminated"
    assert canonical_language(" C++ ") == "cpp" and canonical_language("Py") == "python" and canonical_language(None) is None
    for nothing in (None, "", "  \n", "\n\n"):
        assert check_source(nothing, "rust")[0]
    assert check_source("}}}", "cobol")[0] and check_source("}}}", None)[0]
    assert check_source("int f() {\r\n  return 1;\r\n}\r\n", "c")[0]


def test_all_errors_are_kept_after_recovery():
    text = "int a() { return ; ; x 5 z; }\nint b() { (; }\nint ok() { return 1; }\nint c( { }\nint d() { 7 7; }\n"
    assert len(check_source(text, "c")[2]) >= 3


@pytest.mark.parametrize("language", sorted(LANGUAGES))
@settings(max_examples=15, deadline=None)
@given(data=st.data())
def test_cut_or_doubled_texts_never_fail_to_finish(language, data):
    text = GOOD[language]
    at = data.draw(st.integers(0, len(text)))
    extra = data.draw(st.sampled_from(["", "(", ")", "{", "}", "\"", "'", "`", "<", "/*", "\\", "\x00"]))
    check_source(text[:at] + extra, language)
    check_source(text[:at] + extra + text[at:], language)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, len(GOOD["python"])), st.sampled_from(["", "(", ")", ":", "=", "\n", "  "]), st.booleans())
def test_python_agrees_with_the_interpreter(at, extra, cut):
    text = GOOD["python"].replace("f'{x!r:>{n}} {'in'}'", "x")
    text = text[:at] + extra + ("" if cut else text[at:])
    try:
        ast.parse(text)
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    assert check_source(text, "python")[0] == valid


def test_deep_nesting_and_long_texts():
    assert check_source("x = " + "(" * 3000 + "1" + ")" * 3000, "python")[0]
    assert check_source("int a[] = {" + "1," * 50_000 + "};", "c")[0]
