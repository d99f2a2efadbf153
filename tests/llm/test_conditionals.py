import pytest

from sylvan.llm.syntax import check_source

GOOD = [
    "#ifndef A_H\n#define A_H\nint f(void);\n#endif /* A_H */\n",
    "#if A\nint a;\n# elif defined(B) && \\\n  C\nint b;\n#else\nint c;\n#endif\n",
    "/*\n#if 0\n*/\nint a;\n// #endif\nconst char *s = \"/*\";\n#ifdef X\nint b;\n#endif\n",
    "#if 0\nint a; // don't /*\n#endif\n",
]


@pytest.mark.parametrize("language", ["c", "cpp", "esqlc"])
def test_balance_of_conditional_directives(language):
    for text in GOOD:
        assert check_source(text, language) == (True, None, [])
        assert check_source(text.replace("\n", "\r\n"), language) == (True, None, [])
    assert check_source("#ifndef A_H\n#define A_H\nint f(void);\n", language) == (False, "truncated", [(4, "unexpected end of file")])
    assert check_source("int a;\n#endif\n", language) == (False, "unexpected token", [(2, "unexpected '#endif'")])
    assert check_source("#else\nint a;\n", language)[2] == [(1, "unexpected '#else'")]
    assert check_source("#if A\n#else\n#else\n#endif\n", language)[2] == [(3, "unexpected '#else'")]


def test_raw_strings_hide_directives():
    assert check_source('auto s = R"x(\n#if 0\n)x";\n', "cpp")[0]
