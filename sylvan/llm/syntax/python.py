"""Python."""

from __future__ import annotations

import re

from sylvan.llm.syntax.base import Fault, FunctionNode, Parser

MASTER = re.compile(
    r"""(?P<ws>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<nl>\r?\n|\r)
    |(?P<str>(?i:[rbuft]|br|rb|fr|rf|tr|rt)?(?:'''(?:\\.|[^\\])*?'''|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\(?:\r\n|.)|[^'\\\n])*'|"(?:\\(?:\r\n|.)|[^"\\\n])*"))
    |(?P<bad_str>(?:'''|\"\"\").*|['"][^\n]*)
    |(?P<num>0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)
    |(?P<id>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|!=|->|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|==|<=|>=|<<|>>|\*\*|//|[-+*/%@&|^~<>()\[\]{},:.;=!])""",
    re.X | re.S,
)
LEAD = re.compile(r"[ \t\f]*")
REST = re.compile(r"(?:#[^\n]*)?(?:\r?\n|\r)?")
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield".split()
)
AUGMENTED = frozenset("+= -= *= /= %= &= |= ^= <<= >>= **= //= @=".split())


FORMATTED = re.compile(r"([rR]?[fFtT][rR]?)(\'\'\'|\"\"\"|'|\")")
PLAIN = re.compile(r"(?i:[rbu]|br|rb)?(?:\'\'\'(?:\\.|[^\\])*?\'\'\'|\"\"\"(?:\\.|[^\\])*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")", re.S)


def formatted_end(text: str, pos: int, quote: str, raw: bool) -> int:
    """End of a formatted string whose body begins at ``pos``; its fields may hold any strings. -1 if it has none."""
    n = len(text)
    while pos < n:
        c = text[pos]
        if text.startswith(quote, pos):
            return pos + len(quote)
        if c == "\\":
            pos += 2
        elif c == "\n" and len(quote) == 1:
            return -1
        elif c == "{" and not text.startswith("{{", pos):
            depth, pos = 1, pos + 1
            while pos < n and depth:
                c = text[pos]
                m = FORMATTED.match(text, pos)
                inner = formatted_end(text, m.end(), m[2], "r" in m[1].lower()) if m else -1
                if inner > 0:
                    pos = inner
                    continue
                m = PLAIN.match(text, pos) if c in "'\"rRbBuU" else None
                if m and not (c in "rRbBuU" and text[pos - 1].isalnum()):
                    pos = m.end()
                    continue
                if c in "'\"" and text.startswith(quote, pos):
                    return -1
                depth += (c in "{[(") - (c in "}])")
                pos += 1
        else:
            pos += 2 if text.startswith(("{{", "}}"), pos) else 1
    return -1


class PythonParser(Parser):
    BINARY = {
        "or": (1, False), "and": (2, False), "in": (4, False), "not in": (4, False), "is": (4, False), "is not": (4, False), "<": (4, False),
        ">": (4, False), "<=": (4, False), ">=": (4, False), "==": (4, False), "!=": (4, False), "|": (5, False), "^": (6, False), "&": (7, False),
        "<<": (8, False), ">>": (8, False), "+": (9, False), "-": (9, False), "*": (10, False), "/": (10, False), "//": (10, False), "%": (10, False),
        "@": (10, False), "**": (12, True),
    }

    def tokenize(self, text: str) -> None:
        """Tokens with ``nl``, ``indent`` and ``dedent``; none of these inside brackets."""
        if text.startswith("\ufeff"):
            text = text[1:]
        line, pos, n = 1, 0, len(text)
        indents, brackets, fresh = [(0, 0)], [], True
        push, match = self.push, MASTER.match
        kinds, toks, lines, views = self.kind, self.tok, self.line, self.view
        while pos < n:
            if fresh and not brackets:
                m = LEAD.match(text, pos)
                lead, at = m.group(), m.end()
                if at >= n or text[at] in "#\r\n":
                    m2 = REST.match(text, at)
                    if at < n and text[at] == "#":
                        self.comments.append((line, m2.group().rstrip("\r\n")))
                    line += m2.group().count("\n") or m2.group().count("\r")
                    pos = m2.end() if m2.end() > pos else n
                    continue
                width = (len(lead.expandtabs(8)), len(lead.expandtabs(1)))
                if width > indents[-1]:
                    if width[1] <= indents[-1][1]:
                        push("bad", "inconsistent use of tabs", line)
                    indents.append(width)
                    push("indent", "", line)
                while width < indents[-1]:
                    indents.pop()
                    push("dedent", "", line)
                    if width > indents[-1]:
                        push("bad", "unindent does not match", line)
                        indents.append(width)
                        break
                pos, fresh = at, False
                continue
            m = FORMATTED.match(text, pos) if text[pos] in "rRfFtT" else None
            if m:
                end = formatted_end(text, m.end(), m[2], "r" in m[1].lower())
                push("str" if end > 0 else "bad", text[pos:end] if end > 0 else "unterminated string", line)
                line += text.count("\n", pos, end if end > 0 else n)
                pos = end if end > 0 else n
                continue
            m = match(text, pos)
            if m is None:
                push("bad", f"stray character {text[pos]!r}", line)
                pos += 1
                continue
            kind, s = m.lastgroup, m.group()
            if kind == "id":
                kinds.append(kind)
                toks.append(s)
                lines.append(line)
                views.append(s)
                pos = m.end()
                continue
            if kind == "ws" and s[0] != "\\":
                pos = m.end()
                continue
            if kind == "nl":
                if not brackets:
                    push("nl", "\n", line)
                    fresh = True
            elif kind == "bad_str":
                push("bad", "unterminated string", line)
            elif kind not in ("ws", "comment"):
                if kind == "op":
                    if s in "([{":
                        brackets.append(s)
                    elif s in ")]}" and brackets:
                        brackets.pop()
                if kind == "num" and m.end() < n and (text[m.end()].isalnum() or text[m.end()] == "_"):
                    rest = re.compile(r"\w+").match(text, m.end()).group()
                    if rest not in KEYWORDS:
                        push("bad", "invalid number", line)
                push(kind, s, line)
            line += s.count("\n")
            pos = m.end()
        if self.kind and self.kind[-1] not in ("nl", "dedent"):
            push("nl", "\n", line)
        for _ in indents[1:]:
            push("dedent", "", line)
        push("eof", "", line)

    def push(self, kind: str, tok: str, line: int) -> None:
        self.kind.append(kind)
        self.tok.append(tok)
        self.line.append(line)
        self.view.append(tok if kind in ("id", "op", "num") else "\0" + kind)

    def fault(self, wanted: str = "") -> Fault:
        if self.k in ("indent", "dedent"):
            return Fault(self.line[self.i], f"unexpected {self.k}")
        return super().fault(wanted)

    def ident(self) -> None:
        if self.k != "id" or self.t in KEYWORDS:
            raise self.fault("a name")
        self.i += 1

    def recover(self, at: int) -> None:
        """To the start of the next logical line, over deeper blocks."""
        if self.i == at and self.k != "eof":
            self.i += 1
        depth = 0
        while self.k != "eof":
            if self.k == "indent":
                depth += 1
            elif self.k == "dedent":
                if depth == 0:
                    return
                depth -= 1
            elif self.k == "nl" and depth == 0 and self.kind[min(self.i + 1, len(self.kind) - 1)] != "indent":
                self.i += 1
                return
            self.i += 1

    def program(self) -> None:
        while self.k != "eof":
            if self.k in ("nl",):
                self.i += 1
            elif self.k in ("indent", "dedent"):
                if self.k == "indent":
                    self.errors.append((self.line[self.i], "unexpected indent"))
                self.i += 1
            else:
                self.guarded(self.statement)

    # -- statements -----------------------------------------------------
    def suite(self) -> None:
        self.expect(":")
        if self.k != "nl":
            return self.simple_line()
        self.i += 1
        if self.k != "indent":
            if self.k == "eof":
                raise self.fault()
            raise Fault(self.line[self.i], "expected an indented block")
        self.i += 1
        while self.k not in ("dedent", "eof"):
            if self.k == "indent":
                raise self.fault()
            self.guarded(self.statement)
        if self.k == "dedent":
            self.i += 1
        return None

    def statement(self) -> None:
        t = self.t
        if t == "async" and self.peek() in ("def", "for", "with"):
            self.i += 1
            t = self.t
        if t == "if":
            self.i += 1
            self.named()
            self.suite()
            while self.t == "elif":
                self.i += 1
                self.named()
                self.suite()
            if self.accept("else"):
                self.suite()
        elif t == "while":
            self.i += 1
            self.named()
            self.suite()
            if self.accept("else"):
                self.suite()
        elif t == "for":
            self.i += 1
            self.targets()
            self.expect("in")
            self.star_list()
            self.suite()
            if self.accept("else"):
                self.suite()
        elif t == "try":
            self.i += 1
            self.suite()
            caught = False
            while self.t == "except":
                caught = True
                self.i += 1
                self.accept("*")
                if self.t != ":":
                    self.star_list()
                    if self.accept("as"):
                        self.ident()
                self.suite()
            if caught and self.accept("else"):
                self.suite()
            if self.accept("finally"):
                self.suite()
            elif not caught:
                raise self.fault("'except'")
        elif t == "with":
            self.i += 1
            _, fault = self.attempt(self.with_items, True)
            if fault:
                self.with_items(False)
            self.suite()
        elif t == "def":
            first = self.i - (self.i > 0 and self.tok[self.i - 1] == "async")
            self.i += 1
            name = self.i
            self.ident()
            self.type_params()
            opening = self.i
            self.expect("(")
            self.params(")", True)
            closing = self.i
            self.expect(")")
            if self.accept("->"):
                self.star_list()
            body = self.i
            self.suite()
            inside = body + 1 + 2 * (self.kind[body + 1] == "nl")
            last = self.i - 1
            while self.kind[last] in ("nl", "indent", "dedent"):
                last -= 1
            doc = inside if self.kind[inside] == "str" and self.kind[inside + 1] == "nl" else -1
            self.functions.append(FunctionNode(first, name, opening, closing, body, last, doc))
        elif t == "class":
            self.i += 1
            self.ident()
            self.type_params()
            if self.t == "(":
                self.arguments()
            self.suite()
        elif t == "@":
            self.i += 1
            self.named()
            self.line_end()
            if self.t not in ("def", "class", "@", "async"):
                raise self.fault("a definition")
            self.statement()
        elif t == "match" and self.soft_match():
            pass
        else:
            self.simple_line()

    def soft_match(self) -> bool:
        _, fault = self.attempt(self.match_header)
        if fault:
            return False
        while self.t == "case":
            self.i += 1
            self.patterns()
            if self.accept("if"):
                self.named()
            self.suite()
        if self.k == "dedent":
            self.i += 1
        return True

    def patterns(self) -> None:
        while True:
            self.accept("*")
            self.binary(0)
            if self.accept("as"):
                self.ident()
            if not self.accept(",") or self.t in (":", "if"):
                return

    def match_header(self) -> None:
        self.i += 1
        self.star_list()
        self.expect(":")
        self.line_end()
        if self.k != "indent":
            raise self.fault()
        self.i += 1
        if self.t != "case":
            raise self.fault()

    def type_params(self) -> None:
        if self.t == "[":
            self.skip_balanced()

    def with_items(self, grouped: bool) -> None:
        if grouped:
            self.expect("(")
        while True:
            self.test()
            if self.accept("as"):
                self.target()
            if not self.accept(",") or grouped and self.t == ")":
                break
        if grouped:
            self.expect(")")
        if self.t != ":":
            raise self.fault("':'")

    def line_end(self) -> None:
        if self.k == "nl":
            self.i += 1
        elif self.k != "eof":
            raise self.fault("the end of the line")

    def simple_line(self) -> None:
        while True:
            self.simple()
            if not self.accept(";") or self.k in ("nl", "eof"):
                break
        self.line_end()

    def simple(self) -> None:
        t = self.t
        if t in ("pass", "break", "continue"):
            self.i += 1
        elif t == "return":
            self.i += 1
            if self.k not in ("nl", "eof") and self.t != ";":
                self.star_list()
        elif t == "raise":
            self.i += 1
            if self.k not in ("nl", "eof") and self.t != ";":
                self.test()
                if self.accept("from"):
                    self.test()
        elif t in ("global", "nonlocal"):
            self.i += 1
            self.ident()
            while self.accept(","):
                self.ident()
        elif t == "del":
            self.i += 1
            self.targets()
        elif t == "assert":
            self.i += 1
            self.test()
            if self.accept(","):
                self.test()
        elif t == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.accept("as"):
                    self.ident()
                if not self.accept(","):
                    break
        elif t == "from":
            self.i += 1
            dots = 0
            while self.t in (".", "..."):
                self.i += 1
                dots = 1
            if not dots or self.t != "import":
                self.dotted()
            self.expect("import")
            if self.accept("*"):
                return
            group = self.accept("(")
            while True:
                self.ident()
                if self.accept("as"):
                    self.ident()
                if not self.accept(",") or group and self.t == ")":
                    break
            if group:
                self.expect(")")
        elif t == "type" and self.peek_kind() == "id" and self.peek() not in KEYWORDS:
            self.i += 2
            self.type_params()
            self.expect("=")
            self.test()
        else:
            start = self.i
            self.star_list(yields=True)
            if self.t in AUGMENTED:
                self.assignable(start, self.i, single=True)
                self.i += 1
                self.star_list(yields=True)
            elif self.t == ":":
                self.assignable(start, self.i, single=True)
                self.i += 1
                self.test()
                if self.accept("="):
                    self.star_list(yields=True)
            else:
                while self.t == "=":
                    self.assignable(start, self.i)
                    self.i += 1
                    start = self.i
                    self.star_list(yields=True)

    def assignable(self, start: int, end: int, single: bool = False) -> None:
        """A target is a name, attribute, subscript, or a (bracketed) list of those."""
        if end - start == 1:
            if self.kind[start] != "id" or self.tok[start] in KEYWORDS:
                raise Fault(self.line[start], "cannot assign to a literal")
        elif self.tok[end - 1] == ")" and self.kind[end - 1] == "op" and self.tok[start] not in ("(", "[", "*"):
            # a call, unless a list of targets ends in a parenthesized one
            depth, comma = 0, False
            for j in range(start, end):
                if self.kind[j] == "op":
                    depth += (self.tok[j] in "([{") - (self.tok[j] in ")]}")
                    comma = comma or depth == 0 and self.tok[j] == ","
            if not comma:
                raise Fault(self.line[start], "cannot assign to a call")
        else:
            depth = 0
            for j in range(start, end):
                tok = self.tok[j]
                if self.kind[j] == "op":
                    if depth == 0 and tok not in ".,()[]{}*" :
                        raise Fault(self.line[j], "cannot assign to an expression")
                    depth += (tok in "([{") - (tok in ")]}")
                elif depth == 0 and (tok in KEYWORDS or self.kind[j] in ("num", "str") and self.tok[j - 1] != "."):
                    raise Fault(self.line[j], "cannot assign to an expression")

    def dotted(self) -> None:
        self.ident()
        while self.accept("."):
            self.ident()

    # -- expressions ----------------------------------------------------
    def named(self) -> None:
        self.test()
        if self.accept(":="):
            self.test()

    def star_list(self, yields: bool = False) -> None:
        if yields and self.t == "yield":
            return self.yield_expr()
        if not self.starts():
            raise self.fault("an expression")
        while self.starts():
            if self.accept("*"):
                self.binary(5)
            else:
                self.named()
            if not self.accept(","):
                break
        return None

    def yield_expr(self) -> None:
        self.expect("yield")
        if self.accept("from"):
            self.test()
        elif self.starts():
            self.star_list()

    def starts(self) -> bool:
        if self.k in ("num", "str"):
            return True
        if self.k == "id":
            return self.t not in KEYWORDS or self.t in ("None", "True", "False", "not", "lambda", "await", "yield")
        return self.k == "op" and self.t in ("(", "[", "{", "-", "+", "~", "...", "*")

    def test(self) -> None:
        if self.t == "lambda":
            self.i += 1
            self.params(":", False)
            self.expect(":")
            return self.test()
        self.binary(0)
        if self.accept("if"):
            self.binary(0)
            self.expect("else")
            self.test()
        return None

    def operator(self) -> str:
        t = self.t
        if t == "not" and self.peek() == "in":
            return "not in"
        if t == "is" and self.peek() == "not":
            return "is not"
        return t if t not in ("not",) else ""

    def take_operator(self, op: str) -> None:
        self.i += 2 if " " in op else 1

    def unary(self) -> None:
        t = self.t
        if t == "not":
            self.i += 1
            self.binary(3)
            return
        if t in ("-", "+", "~"):
            self.i += 1
            self.unary()
            return
        self.accept("await")
        self.atom()
        while True:
            t = self.t
            if t == "(":
                self.arguments()
            elif t == "[":
                self.i += 1
                self.subscript()
                self.expect("]")
            elif t == ".":
                self.i += 1
                self.ident()
            else:
                return

    def atom(self) -> None:
        k, t = self.k, self.t
        if k == "num" or t == "...":
            self.i += 1
        elif k == "str":
            while self.k == "str":
                self.i += 1
        elif k == "id" and (t not in KEYWORDS or t in ("None", "True", "False")):
            self.i += 1
        elif t == "(":
            self.i += 1
            if self.t == "yield":
                self.yield_expr()
            elif self.t != ")":
                self.elements(False)
            self.expect(")")
        elif t == "[":
            self.i += 1
            if self.t != "]":
                self.elements(False)
            self.expect("]")
        elif t == "{":
            self.i += 1
            if self.t != "}":
                self.elements(True)
            self.expect("}")
        else:
            raise self.fault("an expression")

    def elements(self, braces: bool) -> None:
        first = True
        while self.starts() or self.t == "**":
            if self.accept("**"):
                self.binary(5)
            elif self.accept("*"):
                self.binary(5)
            else:
                self.named()
                if braces and self.accept(":"):
                    self.test()
            if first and self.t in ("for", "async"):
                return self.comprehension()
            first = False
            if not self.accept(","):
                break
        return None

    def comprehension(self) -> None:
        while self.t in ("for", "async"):
            self.accept("async")
            self.expect("for")
            self.targets()
            self.expect("in")
            self.binary(0)
            if self.accept("if"):
                self.binary(0)
                if self.t == "else":
                    self.i += 1
                    self.test()
            while self.accept("if"):
                self.binary(0)

    def targets(self) -> None:
        while True:
            self.accept("*")
            self.target()
            if not self.accept(",") or self.t in ("in", "=") or self.k == "nl":
                return

    def target(self) -> None:
        self.binary(5)

    def subscript(self) -> None:
        while self.t != "]":
            if self.accept("*"):
                self.binary(5)
            elif self.t != ":":
                self.named()
            while self.accept(":"):
                if self.t not in (":", ",", "]"):
                    self.test()
            if not self.accept(","):
                break

    def arguments(self) -> None:
        self.expect("(")
        while self.t != ")":
            if self.accept("**") or self.accept("*"):
                self.test()
            else:
                start = self.i
                self.named()
                if self.t == "=":
                    if self.i - start != 1 or self.kind[start] != "id":
                        raise self.fault()
                    self.i += 1
                    self.test()
                elif self.t in ("for", "async"):
                    self.comprehension()
            if not self.accept(","):
                break
        self.expect(")")

    def params(self, end: str, typed: bool) -> None:
        while self.t != end:
            if self.accept("/"):
                pass
            elif self.accept("*"):
                if self.t != ",":
                    self.ident()
                    if typed and self.accept(":"):
                        self.accept("*")
                        self.test()
            elif self.accept("**"):
                self.ident()
                if typed and self.accept(":"):
                    self.test()
            else:
                self.ident()
                if typed and self.accept(":"):
                    self.test()
                if self.accept("="):
                    self.test()
            if not self.accept(","):
                break
