"""Rust."""

from __future__ import annotations

import re

from sylvan.llm.syntax.base import FunctionNode, Parser

MASTER = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<comment>//[^\n]*)
    |(?P<str>(?:br|cr|r)(?P<hash>\#*)".*?"(?P=hash)|(?:b|c)?"(?:\\.|[^"\\])*"|b?'(?:\\(?:x[\da-fA-F]{2}|u\{[\da-fA-F_]+\}|.)|[^'\\\n])')
    |(?P<life>'[^\W\d]\w*)
    |(?P<bad_str>["'].*)
    |(?P<num>0[xob][\da-fA-F_]+\w*|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?(?:[eE][+-]?[\d_]+)?\w*)
    |(?P<id>(?:r\#)?[^\W\d]\w*)
    |(?P<op><<=|>>=|\.\.\.|\.\.=|::|->|=>|\.\.|&&|\|\||==|!=|<=|>=|<<|>>|\+=|-=|\*=|/=|%=|\^=|&=|\|=|[-+*/%&|^~!<>=:;,.(){}\[\]\#$?@])""",
    re.X | re.S,
)
KEYWORDS = frozenset(
    "as break const continue else enum extern fn for if impl in let loop match mod move mut pub ref return static struct trait type "
    "unsafe use where while".split()
)
ASSIGN = "= += -= *= /= %= &= |= ^= <<= >>=".split()


class RustParser(Parser):
    BINARY = {op: (1, True) for op in ASSIGN} | {
        "..": (2, False), "..=": (2, False), "||": (3, False), "&&": (4, False), "==": (5, False), "!=": (5, False), "<": (5, False), ">": (5, False),
        "<=": (5, False), ">=": (5, False), "|": (6, False), "^": (7, False), "&": (8, False), "<<": (9, False), ">>": (9, False), "+": (10, False),
        "-": (10, False), "*": (11, False), "/": (11, False), "%": (11, False), "as": (12, False),
    }

    def tokenize(self, text: str) -> None:
        self.literals = True  # a brace after a path opens a struct literal
        line, pos, n = 1, 0, len(text)
        if text.startswith("#!") and not text.startswith("#!["):
            pos = text.find("\n") if "\n" in text else n
        kinds, toks, lines, views, match = self.kind, self.tok, self.line, self.view, MASTER.match
        while pos < n:
            if text[pos] == "/" and text.startswith("/*", pos):  # nested comments
                depth, at = 0, pos
                for m in re.finditer(r"/\*|\*/", text[pos:]):
                    depth += 1 if m.group() == "/*" else -1
                    if not depth:
                        at = pos + m.end()
                        break
                if depth:
                    self.push("bad", "unterminated comment", line)
                    break
                self.comments.append((line, text[pos:at]))
                line += text.count("\n", pos, at)
                pos = at
                continue
            m = match(text, pos)
            if m is None:
                self.push("bad", f"stray character {text[pos]!r}", line)
                pos += 1
                continue
            kind, s = m.lastgroup, m.group()
            pos = m.end()
            if kind in ("id", "op", "num", "life"):
                kinds.append(kind)
                toks.append(s)
                lines.append(line)
                views.append(s)
                continue
            if kind == "bad_str":
                self.push("bad", "unterminated string", line)
            elif kind == "comment":
                self.comments.append((line, s))
            elif kind not in ("ws", "nl"):
                self.push(kind, s, line)
            line += s.count("\n")
        self.push("eof", "", line)

    def ident(self) -> None:
        if self.k != "id" or self.t in KEYWORDS:
            raise self.fault("a name")
        self.i += 1

    def split(self, tok: str) -> bool:
        """Accepts the first character of a compound operator such as ``>>`` or ``&&``."""
        t = self.t
        if self.k == "op" and len(t) > 1 and t[0] == tok and t in (">>", ">=", ">>=", "&&", "||", "<<"):
            self.tok[self.i] = self.view[self.i] = t[1:]
            return True
        return False

    def close(self) -> None:
        if not self.accept(">") and not self.split(">"):
            raise self.fault("'>'")

    # -- items ----------------------------------------------------------
    def program(self) -> None:
        while self.k != "eof":
            if self.t in ("}", ")", "]"):
                self.errors.append((self.line[self.i], f"unexpected {self.t!r}"))
                self.i += 1
            else:
                self.guarded(self.item)

    def attributes(self) -> None:
        while self.t == "#":
            self.i += 1
            self.accept("!")
            if self.t != "[":
                raise self.fault("'['")
            self.skip_balanced()

    def visibility(self) -> None:
        if self.accept("pub") and self.t == "(" and self.peek() in ("crate", "self", "super", "in"):
            self.skip_balanced()

    def is_item(self) -> bool:
        t = self.t
        if self.k == "op":
            return t == "#"
        if t in ("pub", "fn", "use", "mod", "struct", "enum", "trait", "impl", "static", "type", "extern", "macro_rules"):
            return t != "macro_rules" or self.peek() == "!"
        if t in ("const", "unsafe", "async"):
            return self.peek() in ("fn", "unsafe", "extern", "impl", "trait", "async") or t == "const" and self.peek_kind() == "id"
        return t == "union" and self.peek_kind() == "id"

    def item(self) -> None:
        self.attributes()
        if self.k == "eof":
            return
        self.visibility()
        while self.t in ("const", "unsafe", "async", "default") and self.peek() in ("fn", "unsafe", "extern", "impl", "trait", "async", "const") or (
            self.t == "extern" and (self.peek() == "fn" or self.peek_kind() == "str" and self.peek(2) == "fn")
        ):
            if self.next() == "extern" and self.k == "str":
                self.i += 1
        t = self.t
        if t == "use":
            self.i += 1
            self.use_tree()
            self.expect(";")
        elif t == "mod":
            self.i += 1
            self.ident()
            if not self.accept(";"):
                self.body(self.item)
        elif t == "fn":
            self.function()
        elif t in ("struct", "union"):
            self.i += 1
            self.ident()
            self.generics()
            self.where()
            if self.t == "{":
                self.fields()
            else:
                if self.t == "(":
                    self.tuple_fields()
                self.where()
                self.expect(";")
        elif t == "enum":
            self.i += 1
            self.ident()
            self.generics()
            self.where()
            self.expect("{")
            while self.t != "}":
                self.attributes()
                self.visibility()
                self.ident()
                if self.t == "{":
                    self.fields()
                elif self.t == "(":
                    self.tuple_fields()
                if self.accept("="):
                    self.expr()
                if not self.accept(","):
                    break
            self.expect("}")
        elif t == "impl":
            self.i += 1
            if self.t == "<":
                self.generics()
            self.accept("!")
            self.type()
            if self.accept("for"):
                self.type()
            self.where()
            self.body(self.item)
        elif t == "trait":
            self.i += 1
            self.ident()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            self.body(self.item)
        elif t in ("const", "static"):
            self.i += 1
            self.accept("mut")
            self.ident()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.expr()
            self.expect(";")
        elif t == "type":
            self.i += 1
            self.ident()
            self.generics()
            if self.accept(":"):
                self.bounds()
            self.where()
            if self.accept("="):
                self.type()
            self.where()
            self.expect(";")
        elif t == "extern":
            self.i += 1
            if self.accept("crate"):
                self.ident()
                if self.accept("as"):
                    self.ident()
                self.expect(";")
            else:
                if self.k == "str":
                    self.i += 1
                self.body(self.item)
        elif self.k == "id" and t not in KEYWORDS and (self.peek() == "!" or self.peek() == "::"):
            self.path()
            self.expect("!")
            if self.k == "id":
                self.i += 1
            brace = self.t == "{"
            if self.t not in ("{", "(", "["):
                raise self.fault()
            self.skip_balanced()
            if not brace:
                self.expect(";")
        else:
            raise self.fault("an item")

    def body(self, rule) -> None:
        self.expect("{")
        while self.t != "}":
            if self.k == "eof":
                raise self.fault("'}'")
            self.guarded(rule)
        self.i += 1

    def use_tree(self) -> None:
        self.accept("::")
        while True:
            if self.accept("*"):
                return
            if self.accept("{"):
                while self.t != "}":
                    self.use_tree()
                    if not self.accept(","):
                        break
                return self.expect("}")
            self.ident()
            if not self.accept("::"):
                break
        if self.accept("as"):
            self.ident()

    def function(self) -> None:
        first = self.i
        self.expect("fn")
        name = self.i
        self.ident()
        self.generics()
        opening = self.i
        self.expect("(")
        while self.t != ")":
            self.attributes()
            at = self.i
            while self.t in ("&", "mut") or self.k == "life":
                self.i += 1
            if self.t == "self":
                self.i += 1
                if self.accept(":"):
                    self.type()
            else:
                self.i = at
                if not self.accept("..."):
                    self.pattern()
                    self.expect(":")
                    self.type()
            if not self.accept(","):
                break
        closing = self.i
        self.expect(")")
        if self.accept("->"):
            self.type()
        self.where()
        body = self.i
        if not self.accept(";"):
            self.block()
        self.functions.append(FunctionNode(first, name, opening, closing, body, self.i - 1))

    def generics(self) -> None:
        if not self.accept("<"):
            return
        while self.t != ">":
            self.attributes()
            if self.k == "life":
                self.i += 1
                if self.accept(":"):
                    while self.k == "life":
                        self.i += 1
                        self.accept("+")
            elif self.accept("const"):
                self.ident()
                self.expect(":")
                self.type()
                if self.accept("="):
                    self.primary()
            else:
                self.ident()
                if self.accept(":"):
                    self.bounds()
                if self.accept("="):
                    self.type()
            if not self.accept(","):
                break
        self.close()

    def bounds(self) -> None:
        while self.t not in ("{", ";", ",", "=", ">", "where", ">>", ")"):
            if self.k == "life":
                self.i += 1
            else:
                self.accept("?")
                self.accept("~")
                self.type_no_sum()
            if not self.accept("+"):
                break

    def where(self) -> None:
        if self.accept("where"):
            while self.t not in ("{", ";", "="):
                if self.k == "life":
                    self.i += 1
                else:
                    self.type()
                self.expect(":")
                self.bounds()
                if not self.accept(","):
                    break

    def fields(self) -> None:
        self.expect("{")
        while self.t != "}":
            self.attributes()
            self.visibility()
            self.ident()
            self.expect(":")
            self.type()
            if not self.accept(","):
                break
        self.expect("}")

    def tuple_fields(self) -> None:
        self.expect("(")
        while self.t != ")":
            self.attributes()
            self.visibility()
            self.type()
            if not self.accept(","):
                break
        self.expect(")")

    # -- types and patterns ----------------------------------------------
    def type(self) -> None:
        self.type_no_sum()
        while self.accept("+"):
            if self.k == "life":
                self.i += 1
            else:
                self.type_no_sum()

    def type_no_sum(self) -> None:
        t = self.t
        if t == "&" or t == "&&":
            self.i += 1
            if self.k == "life":
                self.i += 1
            self.accept("mut")
            self.type_no_sum()
        elif t == "*":
            self.i += 1
            if self.t not in ("const", "mut"):
                raise self.fault()
            self.i += 1
            self.type_no_sum()
        elif t == "(":
            self.i += 1
            while self.t != ")":
                self.type()
                if not self.accept(","):
                    break
            self.expect(")")
        elif t == "[":
            self.i += 1
            self.type()
            if self.accept(";"):
                self.expr()
            self.expect("]")
        elif t in ("!", "_"):
            self.i += 1
        elif t in ("dyn", "impl"):
            self.i += 1
            self.bounds()
        elif t == "for":
            self.i += 1
            self.generics()
            self.type_no_sum()
        elif t in ("fn", "unsafe", "extern"):
            while self.t in ("unsafe", "extern") or self.k == "str":
                self.i += 1
            self.expect("fn")
            self.expect("(")
            while self.t != ")":
                if self.k == "id" and self.peek() == ":":
                    self.i += 2
                self.type()
                if not self.accept(","):
                    break
            self.expect(")")
            if self.accept("->"):
                self.type_no_sum()
        else:
            self.path(types=True)
            if self.t == "!" and self.peek() in ("(", "[", "{"):
                self.i += 1
                self.skip_balanced()

    def type_args(self) -> None:
        if not self.accept("<"):
            self.split("<")
            self.expect("<")
        while self.t not in (">", ">>", ">=", ">>="):
            if self.k == "life":
                self.i += 1
            elif self.k in ("num", "str") or self.t in ("{", "-"):
                self.unary()
            elif self.k == "id" and self.peek() in ("=", ":") and self.peek(1) != "::":
                self.i += 2
                self.bounds() if self.tok[self.i - 1] == ":" else self.type()
            else:
                self.type()
            if not self.accept(","):
                break
        self.close()

    def path(self, types: bool = False) -> None:
        if self.t in ("<", "<<"):
            if not self.accept("<"):
                self.split("<")
                self.expect("<")
            self.type()
            if self.accept("as"):
                self.type()
            self.close()
            self.expect("::")
        else:
            self.accept("::")
        while True:
            self.accept("$")
            self.ident()
            if types and self.t in ("<", "<<"):
                self.type_args()
            elif types and self.t == "(" :
                self.skip_balanced()
                if self.accept("->"):
                    self.type_no_sum()
            if not self.accept("::"):
                return
            if self.t in ("<", "<<"):
                self.type_args()
                if not self.accept("::"):
                    return

    def pattern(self) -> None:
        self.accept("|")
        self.pattern_one()
        while self.accept("|"):
            self.pattern_one()

    def pattern_one(self) -> None:
        t = self.t
        if t in ("&", "&&"):
            self.i += 1
            self.accept("mut")
            self.pattern_one()
        elif t in ("(", "["):
            self.i += 1
            end = ")" if t == "(" else "]"
            while self.t != end:
                self.pattern()
                if not self.accept(","):
                    break
            self.expect(end)
        elif t in ("_", "..", "..="):
            self.i += 1
            if t != "_" and (self.k in ("num", "str")):
                self.i += 1
        elif self.k in ("num", "str") or t == "-":
            self.accept("-")
            self.i += 1
            self.range_end()
        else:
            while self.t in ("ref", "mut", "box"):
                self.i += 1
            self.path()
            if self.accept("@"):
                self.pattern_one()
            elif self.t == "(":
                self.pattern_one()
            elif self.t == "{":
                self.i += 1
                while self.t != "}":
                    if not self.accept(".."):
                        while self.t in ("ref", "mut"):
                            self.i += 1
                        if self.k not in ("id", "num"):
                            raise self.fault()
                        self.i += 1
                        if self.accept(":"):
                            self.pattern()
                    if not self.accept(","):
                        break
                self.expect("}")
            elif self.t == "!":
                self.i += 1
                self.skip_balanced()
            else:
                self.range_end()

    def range_end(self) -> None:
        if self.t in ("..=", "..", "..."):
            self.i += 1
            if self.k in ("num", "str") or self.t == "-" or self.k == "id" and self.t not in ("if",):
                self.accept("-")
                self.i += 1

    # -- statements and expressions --------------------------------------
    def block(self) -> None:
        literals, self.literals = self.literals, True
        self.body(self.statement)
        self.literals = literals

    def statement(self) -> None:
        if self.accept(";"):
            return
        if self.t == "#":
            self.attributes()
        if self.accept("let"):
            self.pattern()
            if self.accept(":"):
                self.type()
            if self.accept("="):
                self.expr()
                if self.accept("else"):
                    self.block()
            self.expect(";")
            return
        if self.is_item():
            self.item()
            return
        start = self.i
        if self.k == "life" and self.peek() == ":":
            self.i += 2
            start = self.i
        blocky = self.t in ("if", "match", "loop", "while", "for", "unsafe", "{")
        if blocky:
            self.primary()
            if self.t in (".", "?"):
                self.postfix()
                self.tail()
            elif self.t == "}" or self.accept(";"):
                pass
            return
        self.expr()
        if self.t != "}":
            if self.tok[self.i - 1] == "}" and self.kind[start] == "id" and self.tok[start + 1] == "!" and self.t != ";":
                return
            self.expect(";")

    def tail(self) -> None:
        while self.BINARY.get(self.operator()):
            self.take_operator(self.t)
            self.binary(1)
        if self.t != "}":
            self.expect(";")

    def expr(self) -> None:
        self.binary(0)

    def free(self, rule) -> None:
        literals, self.literals = self.literals, True
        rule()
        self.literals = literals

    def strict(self, rule) -> None:
        literals, self.literals = self.literals, False
        rule()
        self.literals = literals

    def operator(self) -> str:
        return self.t if self.k == "op" or self.t == "as" else ""

    def take_operator(self, op: str) -> None:
        self.i += 1

    def binary(self, least: int = 0) -> None:
        self.unary()
        while True:
            op = self.operator()
            rule = self.BINARY.get(op)
            if rule is None or rule[0] < least:
                return
            self.i += 1
            if op == "as":
                self.type_no_sum()
            elif op in ("..", "..=") and not self.starts():
                return
            else:
                self.binary(rule[0] if rule[1] else rule[0] + 1)

    def starts(self) -> bool:
        if self.k in ("num", "str", "life"):
            return True
        if self.k == "id":
            return self.t not in ("else", "in", "as", "where")
        return self.t in ("(", "[", "-", "*", "!", "&", "&&", "|", "||", "<", "::") or self.t == "{" and self.literals

    def unary(self) -> None:
        while True:
            t = self.t
            if self.k == "op" and t in ("-", "!", "*", "&", "&&"):
                self.i += 1
                if t[0] == "&":
                    self.accept("raw")
                    self.accept("mut")
                continue
            if t in ("..", "..="):
                self.i += 1
                if not self.starts():
                    return
                continue
            break
        if self.t in ("return", "break", "continue", "yield"):
            self.i += 1
            if self.k == "life":
                self.i += 1
            if self.tok[self.i - 1] != "continue" and self.starts():
                self.expr()
            return
        self.primary()
        self.postfix()

    def postfix(self) -> None:
        while True:
            t = self.t
            if t == "?":
                self.i += 1
            elif t == "(":
                self.free(self.arguments)
            elif t == "[":
                self.i += 1
                self.free(self.expr)
                self.expect("]")
            elif t == ".":
                self.i += 1
                if self.k == "num":
                    self.i += 1
                else:
                    self.accept("await") or self.ident()
                    if self.t == "::":
                        self.i += 1
                        self.type_args()
            else:
                return

    def arguments(self) -> None:
        self.expect("(")
        while self.t != ")":
            self.expr()
            if not self.accept(","):
                break
        self.expect(")")

    def condition(self) -> None:
        while True:
            if self.accept("let"):
                self.pattern()
                self.expect("=")
                self.binary(5)
            else:
                self.binary(4 if self.t != "let" else 0)
            if not self.accept("&&") and not self.accept("||"):
                break

    def primary(self) -> None:
        t, k = self.t, self.k
        if k in ("num", "str"):
            self.i += 1
        elif k == "life":
            self.i += 1
            self.expect(":")
            self.primary()
        elif t == "(":
            self.free(self.arguments)
        elif t == "[":
            self.i += 1
            self.free(self.array)
        elif t == "{":
            self.block()
        elif t in ("unsafe", "async", "const", "try") and self.peek() in ("{", "move"):
            self.i += 1
            self.accept("move")
            self.block()
        elif t == "if":
            self.i += 1
            self.strict(self.condition)
            self.block()
            if self.accept("else"):
                if self.t == "if":
                    self.primary()
                else:
                    self.block()
        elif t == "match":
            self.i += 1
            self.strict(self.expr)
            self.expect("{")
            self.free(self.arms)
        elif t == "loop":
            self.i += 1
            self.block()
        elif t == "while":
            self.i += 1
            self.strict(self.condition)
            self.block()
        elif t == "for":
            self.i += 1
            self.pattern()
            self.expect("in")
            self.strict(self.expr)
            self.block()
        elif t in ("|", "||", "move") or t in ("static", "async") and self.peek() in ("|", "||", "move"):
            while self.t in ("move", "static", "async"):
                self.i += 1
            if not self.accept("||"):
                self.expect("|")
                while self.t != "|":
                    self.pattern_one()
                    if self.accept(":"):
                        self.type()
                    if not self.accept(","):
                        break
                self.expect("|")
            if self.accept("->"):
                self.type_no_sum()
                self.block()
            else:
                self.expr()
        elif k == "id" and t not in KEYWORDS or t in ("<", "<<", "::", "$"):
            self.path()
            if self.t == "!" and self.peek() in ("(", "[", "{"):
                self.i += 1
                self.macro(self.t)
            elif self.t == "{" and self.literals:
                self.i += 1
                while self.t != "}":
                    self.attributes()
                    if self.accept(".."):
                        self.expr()
                        break
                    if self.k not in ("id", "num"):
                        raise self.fault("a field")
                    self.i += 1
                    if self.accept(":"):
                        self.expr()
                    if not self.accept(","):
                        break
                self.expect("}")
        else:
            raise self.fault("an expression")

    def macro(self, opener: str) -> None:
        """Arguments of a macro: expressions where they parse as such, else any balanced tokens."""
        if opener in ("(", "["):
            _, fault = self.attempt(self.free, self.macro_list)
            if fault is None:
                return
        self.skip_balanced()

    def macro_list(self) -> None:
        end = {"(": ")", "[": "]"}[self.next()]
        while self.t != end:
            self.expr()
            if not self.accept(",") and not self.accept(";"):
                break
        self.expect(end)

    def array(self) -> None:
        while self.t != "]":
            self.expr()
            if not self.accept(",") and not self.accept(";"):
                break
        self.expect("]")

    def arms(self) -> None:
        while self.t != "}":
            if self.k == "eof":
                raise self.fault("'}'")
            self.attributes()
            self.pattern()
            if self.accept("if"):
                self.condition()
            self.expect("=>")
            block = self.t == "{"
            self.expr()
            if not self.accept(",") and not (block or self.tok[self.i - 1] == "}"):
                break
        self.expect("}")
