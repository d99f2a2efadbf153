"""Rows that extractors emit."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field


def node_id(path: str, kind: str, name: str, line: int) -> str:
    return hashlib.sha256(f"{path}:{kind}:{name}:{line}".encode()).hexdigest()[:16]


@dataclass
class Symbol:
    id: str
    kind: str
    name: str
    qualified_name: str
    start_line: int
    end_line: int
    start_column: int = 0
    end_column: int = 0
    signature: str | None = None
    is_exported: bool = False
    is_async: bool = False
    is_static: bool = False
    is_abstract: bool = False
    decorators: list[str] | None = None
    offset: int = 0
    stop: int = 0
    outer: Symbol | None = field(default=None, repr=False, compare=False)


@dataclass
class Link:
    source: str
    target: str
    kind: str
    line: int | None = None
    col: int | None = None
    provenance: str = "tree-sitter"
    metadata: dict[str, str] | None = None


@dataclass
class Result:
    path: str
    language: str
    symbols: list[Symbol] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)  # offsets of the symbols with a body, in order
    bodies: list[Symbol] = field(default_factory=list)

    def nest(self, s: Symbol) -> None:
        """Takes a symbol with a body into the order of bodies; those inside it that were there before become its own."""
        s.outer = self.around(s.offset)
        at = bisect_right(self.starts, s.offset)
        self.starts.insert(at, s.offset)
        self.bodies.insert(at, s)
        for inner in self.bodies[at + 1 :]:
            if inner.offset >= s.stop:
                break
            if inner.outer is s.outer and inner.stop <= s.stop:
                inner.outer = s

    def around(self, at: int, kinds: tuple[str, ...] | None = None) -> Symbol | None:
        """The symbol with the latest start whose body holds an offset."""
        i = bisect_left(self.starts, at) - 1
        if i < 0:
            return None
        while i > 0 and self.starts[i - 1] == self.starts[i] and self.bodies[i - 1].stop > at:
            i -= 1
        s: Symbol | None = self.bodies[i]
        while s is not None and not (s.stop > at and (kinds is None or s.kind in kinds)):
            s = s.outer
        return s

    def add(self, kind: str, name: str, start: int, end: int, container: Symbol | None = None, **extra) -> Symbol:
        qualified = f"{container.qualified_name}::{name}" if container is not None and container.kind != "file" else f"{self.path}#{name}"
        s = Symbol(node_id(self.path, kind, name, start), kind, name, qualified, start, end, **extra)
        self.symbols.append(s)
        if s.stop:
            self.nest(s)
        return s

    def link(self, source: Symbol | str, target: str, kind: str, line: int | None = None, col: int | None = None, **extra) -> None:
        self.links.append(Link(source if isinstance(source, str) else source.id, target, kind, line, col, **extra))

    def file_symbol(self, n_lines: int) -> Symbol:
        name = re.split(r"[/\\]", self.path)[-1]
        s = Symbol(node_id(self.path, "file", name, 1), "file", name, self.path, 1, max(1, n_lines), is_exported=True)
        self.symbols.insert(0, s)
        return s

    def innermost(self, line: int, kinds: tuple[str, ...] = ("function", "method")) -> Symbol | None:
        best = None
        for s in self.symbols:
            if s.kind in kinds and s.start_line <= line <= s.end_line and (best is None or s.end_line - s.start_line <= best.end_line - best.start_line):
                best = s
        return best


class Lines:
    """Line and column of offsets."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.count = len(self.starts) - (1 if text.endswith("\n") and len(self.starts) > 1 else 0)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1]


MASKED = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S
)
MASKED_RUST = re.compile(r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'", re.S)


def mask(text: str, rust: bool = False) -> str:
    """The text with comments and strings blanked, every offset unchanged."""

    def blank(m: re.Match) -> str:
        s = m.group()
        inner = re.sub(r"[^\n]", " ", s)
        return inner if s[0] == "/" else s[0] + inner[1:-1] + s[-1] if len(s) > 1 else inner

    return (MASKED_RUST if rust else MASKED).sub(blank, text)


def closing(text: str, at: int) -> int:
    """Offset of the bracket that closes the one at ``at`` in a masked text; its last offset if none does."""
    pairs = {"{": "}", "(": ")", "[": "]"}
    opener, closer, depth = text[at], pairs[text[at]], 0
    for i in range(at, len(text)):
        c = text[i]
        if c == opener:
            depth += 1
        elif c == closer:
            depth -= 1
            if depth == 0:
                return i
    return len(text) - 1
