"""Texts nested deeper than the parsers follow: brackets, strings and end of file, without recursion."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

from sylvan.llm.syntax.base import CLOSERS, OPENERS, Parser

#: their brackets cannot be told without the grammar: case patterns, words of commands, text between tags
BY_GRAMMAR = frozenset(("shell", "jsx", "tsx"))
SCRIPT = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<bad_comment>/\*)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<bad_str>["'])|(?P<word>[\w$]+)|(?P<op>.)""", re.S
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new do else instanceof yield await".split())


def script_tokens(text: str) -> Iterator[tuple[str, str, int]]:
    """Brackets and unterminated pieces of JavaScript or TypeScript; braces of templates are left out."""
    pos, line, before, n = 0, 1, "", len(text)
    depth: list[int] = []  # per template that is open: braces open in its current ${ }
    inside = False  # in the text of a template
    while pos < n:
        start = pos
        if inside:
            pos = TEMPLATE.match(text, pos).end()
            line += text.count("\n", start, pos)
            if pos >= n:
                break
            inside, before = False, "`"
            if text[pos] == "`":
                depth.pop()
                pos += 1
            elif text.startswith("${", pos):
                before, pos = "{", pos + 2
            else:
                pos = n  # a lone backslash at the end
            continue
        m = REGEX.match(text, pos) if text[pos] == "/" and not text.startswith(("//", "/*"), pos) and _begins(before) else None
        kind = "regex" if m else ""
        if m is None:
            m = SCRIPT.match(text, pos)
            kind = m.lastgroup
        t, pos = m.group(), m.end()
        if kind.startswith("bad"):
            yield "bad", {"bad_comment": "unterminated comment"}.get(kind, "unterminated string"), line
            return
        if t == "`":
            depth.append(0)
            inside = True
        elif depth and t == "{":
            depth[-1] += 1
        elif depth and t == "}" and depth[-1] == 0:
            inside = True
        elif depth and t == "}":
            depth[-1] -= 1
        elif kind == "op" and (t in OPENERS or t in CLOSERS):
            yield "op", t, line
        if kind != "skip":
            before = t
        line += t.count("\n")
    if depth:
        yield "bad", "unterminated string", line
    yield "eof", "", line


def _begins(before: str) -> bool:
    """Whether a slash after this token begins a pattern."""
    return before in BEFORE_REGEX or not (before and (before[-1] in ")]}`\"'$" or before[-1].isalnum() or before[-1] == "_"))


def faults(tokens: Iterable[tuple[str, str, int]]) -> list[tuple[int, str]]:
    """The first bracket that does not fit, every unterminated piece, or the end of the text inside brackets."""
    stack: list[str] = []
    out: list[tuple[int, str]] = []
    for kind, t, line in tokens:
        if kind == "bad":
            out.append((line, t))
        elif t in OPENERS:
            stack.append(OPENERS[t])
        elif t in CLOSERS and (not stack or stack.pop() != t):
            return [*out, (line, f"unexpected {t!r}")]
        elif kind == "eof" and stack and not out:
            out.append((line, "unexpected end of file"))
    return out


def too_deep_faults(parser: Parser | None, text: str, language: str | None) -> list[tuple[int, str]]:
    """Errors found before the parser gave up, and what the tokens show by themselves."""
    if parser is None:
        return []
    if language in BY_GRAMMAR:
        more = [(n, t) for k, t, n in zip(parser.kind, parser.tok, parser.line) if k == "bad"] if language == "shell" else []
    elif language in ("javascript", "typescript"):
        more = faults(script_tokens(text))
    else:
        more = faults((k, t if k == "bad" else v, n) for k, t, v, n in zip(parser.kind, parser.tok, parser.view, parser.line))
    return list(dict.fromkeys([*parser.errors, *more]))
