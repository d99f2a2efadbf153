"""What the parsers share: a token cursor, precedence climbing and panic-mode recovery."""

from __future__ import annotations

import re
from typing import NamedTuple


class Fault(Exception):
    """A place where the source cannot be continued by the grammar."""

    def __init__(self, line: int, message: str):
        super().__init__(message)
        self.line, self.message = line, message


OPENERS = {"(": ")", "[": "]", "{": "}"}
CLOSERS = {v: k for k, v in OPENERS.items()}
MERGE = re.compile(r"^(<{7}|>{7}|\|{7})( |$)|^={7}$", re.M)


class FunctionNode(NamedTuple):
    """A function in the tree, by token positions; -1 for what it lacks."""

    first: int
    name: int
    opening: int  # brackets of the parameters
    closing: int
    body: int
    last: int
    doc: int = -1  # a documentation string inside the body


class Parser:
    """Token cursor over parallel lists of kinds, texts and lines; the last token is ``eof``."""

    #: binary operator -> (precedence, right associative)
    BINARY: dict[str, tuple[int, bool]] = {}

    def __init__(self, text: str):
        self.errors: list[tuple[int, str]] = []
        self.kind: list[str] = []
        self.tok: list[str] = []
        self.line: list[int] = []
        self.view: list[str] = []  # what the rules compare: the text, or a mark for strings
        self.comments: list[tuple[int, str]] = []  # (line, text)
        self.functions: list[FunctionNode] = []
        self.bracket = (-1, -1)  # the parameters last read
        self.i = 0
        self.tokenize(text)

    # -- tokens ---------------------------------------------------------
    def tokenize(self, text: str) -> None:
        raise NotImplementedError

    def push(self, kind: str, tok: str, line: int) -> None:
        self.kind.append(kind)
        self.tok.append(tok)
        self.line.append(line)
        self.view.append(tok if kind != "str" else "\0str")

    @property
    def t(self) -> str:
        return self.view[self.i]

    @property
    def k(self) -> str:
        return self.kind[self.i]

    def peek(self, n: int = 1) -> str:
        return self.view[min(self.i + n, len(self.view) - 1)]

    def peek_kind(self, n: int = 1) -> str:
        return self.kind[min(self.i + n, len(self.tok) - 1)]

    def next(self) -> str:
        tok = self.t
        if self.k != "eof":
            self.i += 1
        return tok

    def fault(self, wanted: str = "") -> Fault:
        if self.k == "eof":
            return Fault(self.line[self.i], "unexpected end of file")
        if self.k == "bad":
            return Fault(self.line[self.i], self.tok[self.i])
        shown = self.tok[self.i][:20].replace("\n", "\\n")
        return Fault(self.line[self.i], f"unexpected {shown!r}" + (f", wanted {wanted}" if wanted else ""))

    def expect(self, tok: str) -> None:
        if self.view[self.i] != tok:
            raise self.fault(repr(tok))
        self.i += 1

    def accept(self, tok: str) -> bool:
        if self.view[self.i] == tok:
            self.i += 1
            return True
        return False

    def name(self) -> str:
        if self.k != "id":
            raise self.fault("a name")
        return self.next()

    def attempt(self, rule, *args):
        """Runs a rule; on a fault the cursor goes back and the fault is returned in the second place."""
        at, seen, built = self.i, len(self.errors), len(self.functions)
        try:
            return rule(*args), None
        except Fault as fault:
            reached, self.i = self.i, at
            del self.errors[seen:], self.functions[built:]
            fault.reached = reached
            return None, fault
        except RecursionError:  # what a trial has stored is no error of the text
            del self.errors[seen:]
            raise

    def matching(self, opening: int) -> int:
        """Position of the bracket that closes the one at ``opening`` in a text that was read without fault."""
        depth = 0
        for i in range(opening, self.i):
            if self.kind[i] == "op":
                depth += (self.tok[i] in OPENERS) - (self.tok[i] in CLOSERS)
                if depth == 0:
                    return i
        return -1

    def skip_balanced(self) -> None:
        """Over a bracketed group of any tokens."""
        stack = []
        while True:
            if self.k in ("eof", "bad"):
                raise self.fault()
            t = self.next()
            if t in OPENERS:
                stack.append(OPENERS[t])
            elif t in CLOSERS:
                if not stack or stack.pop() != t:
                    self.i -= 1
                    raise self.fault()
                if not stack:
                    return

    # -- expressions ----------------------------------------------------
    def binary(self, least: int = 0) -> None:
        """Precedence climbing."""
        self.unary()
        rules = self.BINARY
        while True:
            op = self.operator()
            rule = rules.get(op)
            if rule is None or rule[0] < least:
                return
            self.take_operator(op)
            self.binary(rule[0] if rule[1] else rule[0] + 1)

    def operator(self) -> str:
        return self.t if self.k != "str" else ""

    def take_operator(self, op: str) -> None:
        self.i += 1

    def unary(self) -> None:
        raise NotImplementedError

    # -- recovery -------------------------------------------------------
    def guarded(self, rule, *args) -> None:
        """Runs a statement rule; a fault is stored and the cursor moved to where a statement may begin."""
        at = self.i
        try:
            rule(*args)
        except Fault as fault:
            self.errors.append((fault.line, fault.message))
            self.recover(at)

    def recover(self, at: int) -> None:
        """Panic mode: skip to just after the next ``;`` or to the closing brace of the block."""
        if self.i == at and self.k != "eof":
            self.i += 1
        depth = 0
        while self.k != "eof":
            t = self.t
            if t == "{":
                depth += 1
            elif t == "}":
                if depth == 0:
                    return
                depth -= 1
                if depth == 0:
                    self.i += 1
                    return
            elif t in (";", "\n") and depth == 0:
                self.i += 1
                return
            self.i += 1

    def parse(self) -> list[tuple[int, str]]:
        self.program()
        return self.errors

    def program(self) -> None:
        raise NotImplementedError


def lex(parser: Parser, text: str, master: re.Pattern, newline_token: bool = False) -> None:
    """Tokenizes by a pattern whose groups name the kinds; ``ws``, ``comment`` and ``nl`` only count lines."""
    line, pos = 1, 0
    kinds, toks, lines, views = parser.kind, parser.tok, parser.line, parser.view

    def bad(message: str) -> None:
        kinds.append("bad")
        toks.append(message)
        lines.append(line)
        views.append(message)

    for m in master.finditer(text):
        start, end = m.span()
        while pos < start:
            bad(f"stray character {text[pos]!r}")
            pos += 1
        kind, pos = m.lastgroup, end
        if kind == "ws":
            line += text.count("\n", start, end)
        elif kind in ("id", "op", "num"):
            s = m.group()
            kinds.append(kind)
            toks.append(s)
            lines.append(line)
            views.append(s)
        elif kind == "nl":
            if newline_token:
                kinds.append("nl")
                toks.append("\n")
                lines.append(line)
                views.append("\n")
            line += 1
        else:
            s = m.group()
            if kind == "comment":
                parser.comments.append((line, s))
            elif kind.startswith("bad"):
                bad({"bad_comment": "unterminated comment", "bad_str": "unterminated string"}.get(kind, "stray text"))
            else:
                kinds.append(kind)
                toks.append(s)
                lines.append(line)
                views.append("\0str" if kind == "str" else s)
            line += s.count("\n")
    while pos < len(text):
        bad(f"stray character {text[pos]!r}")
        pos += 1
    parser.push("eof", "", line)
