import pytest

from sylvan.llm.syntax import check_source
from sylvan.llm.syntax.brackets import faults, script_tokens

N = 30_000
DEEP = {
    "python": "x = " + "[" * N + "1" + "]" * N + "\n",
    "c": "int f() { return " + "(" * N + "1" + ")" * N + "; }\n",
    "cpp": "int f() { return " + "(" * N + "1" + ")" * N + "; }\n",
    "go": "package p\nvar x = " + "(" * N + "1" + ")" * N + "\n",
    "rust": "fn f() -> i64 { " + "(" * N + "1" + ")" * N + " }\n",
    "javascript": "const x = " + "[" * N + "`a${b}`" + "]" * N + ";\n",
    "typescript": "const x = " + "[" * N + "/[(]/" + "]" * N + ";\n",
}


@pytest.mark.parametrize("language", sorted(DEEP))
def test_deep_text_is_judged_by_its_brackets(language):
    text = DEEP[language]
    assert check_source(text, language)[0]
    valid, cause, errors = check_source(text[: len(text) * 3 // 4], language)
    assert not valid and errors, language
    middle = len(text) * 3 // 4
    assert not check_source(text[:middle] + "}" + text[middle + 1 :], language)[0]


def test_errors_before_the_deep_part_are_kept():
    assert not check_source("int a = ;\n" + DEEP["c"], "c")[0]


def test_script_scanner():
    fine = "const a = `x${ {b: `}${c}` }.b }(`, r = /[/(]/g.test(s) ? {q: 'it('} : \"[\"; // (\n/* { */ f(a / 2, b / (c));\n"
    assert faults(script_tokens(fine)) == []
    assert faults(script_tokens("f(`a${b")) and faults(script_tokens("a = 'x")) and faults(script_tokens("(]"))[0] == (1, "unexpected ']'")
