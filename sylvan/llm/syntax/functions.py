"""The function nodes of a syntax tree as source: names, parameters, exact ranges, attached documentation."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sylvan.llm.syntax.base import CLOSERS, OPENERS, FunctionNode, Parser

MARK = re.compile(r"\s*(?:@[\w.$]|#!?\[|\[\[|template\b)")  # decorators, attributes, template heads: between comment and function


@dataclass
class FunctionSource:
    """A function as it stands in its file; lines count from 1."""

    name: str
    line: int
    end_line: int
    head: str  # what stands before the name
    params: list[str]
    returns: str
    doc: str | None
    code: str


def _join(parser: Parser, start: int, stop: int) -> str:
    return " ".join(parser.tok[max(start, 0) : max(stop, 0)])


def _params(parser: Parser, node: FunctionNode) -> list[str]:
    if node.opening < 0 or node.closing <= node.opening:
        return []
    out, depth, start = [], 0, node.opening + 1
    for i in range(node.opening + 1, node.closing):
        tok = parser.tok[i] if parser.kind[i] == "op" else ""
        depth += (tok in OPENERS or tok == "<") - (tok in CLOSERS or tok == ">") - 2 * (tok == ">>")
        if tok == "," and depth <= 0:
            out.append(_join(parser, start, i))
            start = i + 1
    out.append(_join(parser, start, node.closing))
    return [p for p in out if p]


def comment_lines(parser: Parser, rows: list[str]) -> dict[int, tuple[int, str]]:
    """last line -> (first line, text) of the comments that stand alone on their lines."""
    out: dict[int, tuple[int, str]] = {}
    gaps = getattr(parser, "gaps", None)
    found = list(parser.comments)
    if gaps:
        for line, gap in gaps.values():
            for m in re.finditer(r"//[^\n]*|/\*.*?\*/", gap, re.S):
                found.append((line + gap.count("\n", 0, m.start()), m.group()))
    for line, text in found:
        if line <= len(rows) and rows[line - 1].lstrip()[:2] == text[:2]:
            out[line + text.count("\n")] = (line, text)
    return out


def attached(first: int, comments: dict[int, tuple[int, str]], rows: list[str]) -> str | None:
    """The comment that ends on the line above ``first`` (or above its decorators), with all line comments
    that stand directly on top of it."""
    line, parts = first - 1, []
    while line > 0:
        hit = comments.get(line)
        if hit is not None:
            if parts and hit[1].startswith("/*") != parts[0].startswith("/*"):
                break
            parts.insert(0, hit[1])
            line = hit[0] - 1
            if hit[1].startswith("/*"):
                break
        elif not parts and MARK.match(rows[line - 1]):
            line -= 1
        else:
            break
    return "\n".join(parts) if parts else None


def function_sources(parser: Parser, text: str) -> list[FunctionSource]:
    """All functions of a parsed text in order of their place, each once."""
    if not parser.functions:
        return []
    rows = text.split("\n")
    comments = comment_lines(parser, rows)
    out, seen = [], set()
    for node in sorted(parser.functions):
        if node.name in seen or not 0 <= node.name < len(parser.tok):
            continue
        seen.add(node.name)
        line, last = parser.line[node.first], parser.line[max(node.last, node.name)]
        last += parser.tok[max(node.last, node.name)].count("\n")
        doc = parser.tok[node.doc] if node.doc >= 0 else attached(line, comments, rows)
        after = node.closing + 1 if node.closing >= node.opening >= 0 else node.name + 1
        out.append(
            FunctionSource(
                parser.tok[node.name], line, last, _join(parser, node.first, node.name), _params(parser, node),
                _join(parser, after, node.body), doc, "\n".join(rows[line - 1 : last]).replace("\r", ""),
            )
        )
    return out
