"""Go."""

from __future__ import annotations

import re

from sylvan.llm.syntax.base import FunctionNode, Parser, lex

MASTER = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)
    |(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<bad_comment>/\*.*)
    |(?P<str>"(?:\\.|[^"\\\n])*"|`[^`]*`|'(?:\\(?:x..|u....|U........|[0-7]{3}|.)|[^'\\\n])')
    |(?P<bad_str>["'`].*?(?=\n|$))
    |(?P<num>0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?i?|0[bBoO][0-7_]+i?|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?i?|\.\d[\d_]*(?:[eE][+-]?\d+)?i?)
    |(?P<id>[^\W\d]\w*)
    |(?P<op>&\^=|<<=|>>=|\.\.\.|:=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|<<|>>|&\^|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[-+*/%&|^~!<>=:;,.(){}\[\]])""",
    re.X | re.S,
)
KEYWORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return "
    "select struct switch type var".split()
)
ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


class GoParser(Parser):
    BINARY = {
        "||": (1, False), "&&": (2, False), "==": (3, False), "!=": (3, False), "<": (3, False), "<=": (3, False), ">": (3, False), ">=": (3, False),
        "+": (4, False), "-": (4, False), "|": (4, False), "^": (4, False), "*": (5, False), "/": (5, False), "%": (5, False), "<<": (5, False),
        ">>": (5, False), "&": (5, False), "&^": (5, False),
    }

    def tokenize(self, text: str) -> None:
        self.level = 0  # below 0: a brace opens the body of a control clause
        lex(self, text, MASTER, newline_token=True)
        rows = list(zip(self.kind, self.tok, self.line, self.view))
        out: list[tuple[str, str, int, str]] = []
        for row in rows:
            if row[0] in ("nl", "eof"):
                if out:
                    kind, tok = out[-1][:2]
                    if kind in ("num", "str") or kind == "id" and tok not in KEYWORDS or tok in ENDS and kind != "str":
                        out.append(("op", ";", row[2], ";"))
                if row[0] == "nl":
                    continue
            out.append(row)
        self.kind, self.tok, self.line, self.view = map(list, zip(*out))

    def ident(self) -> None:
        if self.k != "id" or self.t in KEYWORDS:
            raise self.fault("a name")
        self.i += 1

    def end(self) -> None:
        if self.t not in (")", "}"):
            self.expect(";")

    def program(self) -> None:
        while self.accept(";"):
            pass
        if self.k == "eof":
            return
        self.guarded(self.package)
        while self.k != "eof":
            if self.t in ("}", ")", "]"):
                self.errors.append((self.line[self.i], f"unexpected {self.t!r}"))
                self.i += 1
            else:
                self.guarded(self.top)

    def package(self) -> None:
        self.expect("package")
        self.ident()
        self.expect(";")

    def top(self) -> None:
        self.level = 0
        if self.t == "func":
            first = self.i
            self.i += 1
            if self.t == "(":
                self.params()
            name = self.i
            self.ident()
            if self.t == "[":
                self.type_params()
            opening = self.i
            self.signature()
            body = self.i
            if self.t == "{":
                self.block()
            closing = self.matching(opening)
            self.functions.append(FunctionNode(first, name, opening, closing, body, self.i - 1))
            self.expect(";")
        elif self.t in ("import", "const", "var", "type"):
            self.declaration()
            self.expect(";")
        else:
            raise self.fault("a declaration")

    def declaration(self) -> None:
        rule = {"import": self.import_spec, "const": self.value_spec, "var": self.value_spec, "type": self.type_spec}[self.next()]
        if self.accept("("):
            while self.t != ")":
                rule()
                self.end()
            self.i += 1
        else:
            rule()

    def import_spec(self) -> None:
        if self.t == "." or self.k == "id":
            self.i += 1
        if self.k != "str":
            raise self.fault("a path")
        self.i += 1

    def value_spec(self) -> None:
        self.ident()
        while self.accept(","):
            self.ident()
        if self.t not in ("=", ";", ")"):
            self.type()
        if self.accept("="):
            self.exprs()

    def type_spec(self) -> None:
        self.ident()
        if self.t == "[" and self.peek_kind() == "id" and self.peek() not in KEYWORDS and self.peek(2) != "]":
            _, fault = self.attempt(self.type_params)
            del fault
        self.accept("=")
        self.type()

    def type_params(self) -> None:
        self.expect("[")
        while self.t != "]":
            self.ident()
            while self.accept(","):
                self.ident()
            self.constraint()
            if not self.accept(","):
                break
        self.expect("]")

    def constraint(self) -> None:
        while True:
            self.accept("~")
            self.type()
            if not self.accept("|"):
                return

    def type(self) -> None:
        t = self.t
        if t == "*" or t == "<-":
            self.i += 1
            self.type()
        elif t == "(":
            self.i += 1
            self.type()
            self.expect(")")
        elif t == "[":
            self.i += 1
            if self.t != "]":
                if not self.accept("..."):
                    self.nested(self.expr)
            self.expect("]")
            self.type()
        elif t == "map":
            self.i += 1
            self.expect("[")
            self.type()
            self.expect("]")
            self.type()
        elif t == "chan":
            self.i += 1
            self.accept("<-")
            self.type()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.expect("{")
            while self.t != "}":
                if self.t == "*" or self.peek() in (";", "}", ".") or self.peek_kind() == "str":
                    self.accept("*")
                    self.type()
                else:
                    self.ident()
                    while self.accept(","):
                        self.ident()
                    self.type()
                if self.k == "str":
                    self.i += 1
                self.end()
            self.i += 1
        elif t == "interface":
            self.i += 1
            self.expect("{")
            while self.t != "}":
                if self.k == "id" and self.peek() == "(":
                    self.ident()
                    self.signature()
                else:
                    self.constraint()
                self.end()
            self.i += 1
        else:
            self.ident()
            if self.accept("."):
                self.ident()
            if self.t == "[" and self.peek() != "]":
                self.attempt(self.type_args)

    def type_args(self) -> None:
        self.expect("[")
        self.type()
        while self.accept(","):
            self.type()
        self.expect("]")

    def params(self) -> None:
        self.expect("(")
        while self.t != ")":
            self.accept("...")
            self.type()
            if self.t not in (",", ")"):
                self.accept("...")
                self.type()
            if not self.accept(","):
                break
        self.expect(")")

    def signature(self) -> None:
        self.params()
        if self.t == "(":
            self.params()
        elif self.t not in ("{", ";", ",", ")", "}", "]", ":", "=", ":=") and self.k != "str" and self.k != "eof":
            self.type()

    # -- statements -----------------------------------------------------
    def block(self) -> None:
        self.expect("{")
        level, self.level = self.level, 0
        while self.t != "}":
            if self.k == "eof":
                raise self.fault("'}'")
            self.guarded(self.statement_end)
        self.i += 1
        self.level = level

    def statement_end(self) -> None:
        self.statement()
        if self.t != "}":
            self.expect(";")

    def statement(self) -> None:
        t = self.t
        if t in ("const", "var", "type"):
            self.declaration()
        elif t == "{":
            self.block()
        elif t in (";", "}"):
            return
        elif t == "if":
            self.i += 1
            self.header()
            self.block()
            if self.accept("else"):
                if self.t == "if":
                    self.statement()
                else:
                    self.block()
        elif t == "for":
            self.i += 1
            self.header(loop=True)
            self.block()
        elif t in ("switch", "select"):
            self.i += 1
            if t == "switch":
                self.header(optional=True)
            self.expect("{")
            while self.t != "}":
                if self.accept("default"):
                    pass
                else:
                    self.expect("case")
                    if t == "select":
                        self.simple()
                    else:
                        self.type_or_expr()
                        while self.accept(","):
                            self.type_or_expr()
                self.expect(":")
                while self.t not in ("case", "default", "}"):
                    if self.k == "eof":
                        raise self.fault("'}'")
                    self.statement()
                    if self.t != "}":
                        self.expect(";")
            self.i += 1
        elif t in ("go", "defer"):
            self.i += 1
            self.expr()
        elif t == "return":
            self.i += 1
            if self.t not in (";", "}"):
                self.exprs()
        elif t in ("break", "continue", "goto", "fallthrough"):
            self.i += 1
            if self.k == "id":
                self.ident()
        elif self.k == "id" and t not in KEYWORDS and self.peek() == ":" :
            self.i += 2
            self.accept(";")
            self.statement()
        else:
            self.simple()

    def header(self, loop: bool = False, optional: bool = False) -> None:
        level, self.level = self.level, -1
        if self.t != "{":
            if self.t != ";":
                if loop and self.accept("range"):
                    self.expr()
                else:
                    self.simple()
            if self.accept(";"):
                if self.t not in (";", "{"):
                    self.simple()
                if loop:
                    self.expect(";")
                    if self.t != "{":
                        self.simple()
        elif not loop and not optional:
            raise self.fault("a condition")
        self.level = level

    def simple(self) -> None:
        self.exprs()
        if self.t in ASSIGN and self.k == "op":
            self.i += 1
            if self.accept("range"):
                self.expr()
            else:
                self.exprs()
        elif self.t in ("++", "--"):
            self.i += 1
        elif self.accept("<-"):
            self.expr()

    # -- expressions ----------------------------------------------------
    def exprs(self) -> None:
        self.expr()
        while self.accept(","):
            self.expr()

    def expr(self) -> None:
        self.binary(0)

    def type_or_expr(self) -> None:
        _, fault = self.attempt(self.expr)
        if fault:
            self.type()

    def nested(self, rule) -> None:
        level, self.level = self.level, 0
        rule()
        self.level = level

    def unary(self) -> None:
        while self.t in ("+", "-", "!", "^", "*", "&", "<-") and self.k == "op":
            self.i += 1
        self.primary()

    def primary(self) -> None:
        t, k = self.t, self.k
        literal_type = False
        if k in ("num", "str"):
            self.i += 1
        elif t == "(":
            self.i += 1
            self.nested(self.type_or_expr)
            self.expect(")")
        elif t == "func":
            self.i += 1
            self.signature()
            if self.t == "{":
                self.block()
        elif t in ("[", "map", "struct", "chan", "interface"):
            self.type()
            literal_type = True
        elif k == "id" and t not in KEYWORDS:
            self.i += 1
            literal_type = True
        else:
            raise self.fault("an expression")
        while True:
            t = self.t
            if t == "(":
                self.nested(self.arguments)
                literal_type = False
            elif t == "[":
                self.nested(self.index)
            elif t == ".":
                self.i += 1
                if self.accept("("):
                    if not self.accept("type"):
                        self.type()
                    self.expect(")")
                else:
                    self.ident()
            elif t == "{" and literal_type and (self.level >= 0 or self.tok[self.i - 1] == "]"):
                self.nested(self.composite)
                literal_type = False
            else:
                return

    def index(self) -> None:
        self.expect("[")
        while self.t != "]":
            if self.t in (":", ","):
                self.i += 1
            else:
                self.type_or_expr()
                if self.t not in (":", ",", "]"):
                    raise self.fault("']'")
        self.i += 1

    def arguments(self) -> None:
        self.expect("(")
        while self.t != ")":
            self.type_or_expr()
            self.accept("...")
            if not self.accept(","):
                break
        self.expect(")")

    def composite(self) -> None:
        self.expect("{")
        while self.t != "}":
            self.element()
            if self.accept(":"):
                self.element()
            if not self.accept(","):
                break
        self.expect("}")

    def element(self) -> None:
        if self.t == "{":
            self.composite()
        else:
            self.expr()
