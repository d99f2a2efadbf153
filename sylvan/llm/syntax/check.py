"""One call per source text: all errors of the language's parser and the first cause."""

from __future__ import annotations

import sys

from sylvan.llm.syntax.base import MERGE, Parser
from sylvan.llm.syntax.brackets import too_deep_faults
from sylvan.llm.syntax.clike import CParser, CppParser, EsqlParser
from sylvan.llm.syntax.functions import FunctionSource, function_sources
from sylvan.llm.syntax.go import GoParser
from sylvan.llm.syntax.javascript import JsParser, JsxParser, TsParser, TsxParser
from sylvan.llm.syntax.python import PythonParser
from sylvan.llm.syntax.rust import RustParser
from sylvan.llm.syntax.shell import ShellParser

LANGUAGES: dict[str, type[Parser]] = {
    "c": CParser,
    "cpp": CppParser,
    "esqlc": EsqlParser,
    "go": GoParser,
    "javascript": JsParser,
    "jsx": JsxParser,
    "python": PythonParser,
    "rust": RustParser,
    "shell": ShellParser,
    "tsx": TsxParser,
    "typescript": TsParser,
}
#: other spellings, compared in lower case
SPELLINGS = {
    "c++": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cplusplus": "cpp", "h": "c", "golang": "go", "js": "javascript", "mjs": "javascript",
    "node": "javascript", "ecmascript": "javascript", "javascriptreact": "jsx", "py": "python", "py3": "python", "python3": "python", "pyi": "python",
    "rs": "rust", "bash": "shell", "sh": "shell", "zsh": "shell", "shellscript": "shell", "shell script": "shell", "typescriptreact": "tsx",
    "ts": "typescript", "esql/c": "esqlc", "esql-c": "esqlc", "esql": "esqlc", "pro*c": "esqlc", "sc": "esqlc", "qsc": "esqlc",
}
DEPTH = 20_000


def canonical_language(name: str | None) -> str | None:
    """The one name of a language however it is spelled; unknown names in lower case."""
    if name is None or not name.strip():
        return None
    low = name.strip().lower()
    return low if low in LANGUAGES else SPELLINGS.get(low, low)


def cause(text: str, errors: list[tuple[int, str]]) -> str:
    """First cause: unresolved merge, truncated, unterminated, stray text or unexpected token."""
    line, message = errors[0]
    if MERGE.search(text.replace("\r\n", "\n")):
        return "unresolved merge"
    if message == "unexpected end of file":
        return "truncated"
    if message.startswith("unterminated"):
        return "unterminated"
    return "stray text" if message.startswith("stray") else "unexpected token"


def functions_of(text: str | None, language: str | None) -> list[FunctionSource]:
    """The function nodes of a text; none where the language is unknown or the text nests deeper than the parser follows."""
    parser = LANGUAGES.get(language or "")
    if parser is None or not text or not text.strip():
        return []
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    try:
        found = parser(text)
        found.parse()
    except RecursionError:
        return []
    return function_sources(found, text)


def check_source(text: str | None, language: str | None) -> tuple[bool, str | None, list[tuple[int, str]]]:
    """(accepted, first cause, all errors). Null text, empty text and unknown languages are accepted;
    a text nested deeper than the parser follows is judged by the errors up to there, its brackets, strings and end."""
    parser = LANGUAGES.get(language or "")
    if parser is None or not text or not text.strip():
        return True, None, []
    if sys.getrecursionlimit() < DEPTH:
        sys.setrecursionlimit(DEPTH)
    found = None
    try:
        found = parser(text)
        errors = found.parse()
    except RecursionError:
        errors = too_deep_faults(found, text, language)
        if not errors:
            return True, "too deep", []
    if not errors:
        return True, None, []
    errors = sorted(errors)
    return False, cause(text, errors), errors
