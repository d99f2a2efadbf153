"""JavaScript, TypeScript, JSX and TSX.

Tokens are read on demand, since whether ``/`` begins a pattern and ``<`` an element depends on the grammar.
"""

from __future__ import annotations

import re

from sylvan.llm.syntax.base import Fault, FunctionNode, Parser

_TOKEN = r"""(?:(?P<id>\#?[^\W\d][\w$]*|\#?\$[\w$]*|\#?[^\W\d]?(?:\\u[\da-fA-F]{4}|\\u\{[\da-fA-F]+\})[\w$]*)
    |(?P<num>0[xX][\da-fA-F_]+n?|0[bB][01_]+n?|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?)
    |(?P<str>"(?:\\(?:\r\n|.)|[^"\\\n])*"|'(?:\\(?:\r\n|.)|[^'\\\n])*')
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*
      |[-+*/%&|^~!<>=?:;,.(){}\[\]@]))"""
TOKEN = re.compile(_TOKEN, re.X | re.S)
#: blanks and comments (read once, never given back), then a token if there is one
NEXT = re.compile(r"(?P<gap>(?:[ \t\r\f\v\xa0\ufeff\n]++|//[^\n]*+|/\*.*?\*/)*+)" + _TOKEN + "?", re.X | re.S)
AHEAD = 32  # tokens read at once; those behind a pattern or an element's text are read again
REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof "
    "new null return super switch this throw true try typeof var void while with enum".split()
)
ASSIGN = "= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split()
PREFIXES = frozenset("! ~ + - ++ -- typeof void delete await <".split())
TRAILERS = frozenset((".", "?.", "[", "(", "!", "<", "\0str"))
MODIFIERS = frozenset("public private protected static readonly abstract override declare async get set accessor".split())


class JsParser(Parser):
    BINARY = {
        "??": (3, False), "||": (4, False), "&&": (5, False), "|": (6, False), "^": (7, False), "&": (8, False), "==": (9, False), "!=": (9, False),
        "===": (9, False), "!==": (9, False), "<": (10, False), ">": (10, False), "<=": (10, False), ">=": (10, False), "instanceof": (10, False),
        "in": (10, False), "as": (10, False), "satisfies": (10, False), "<<": (11, False), ">>": (11, False), ">>>": (11, False), "+": (12, False),
        "-": (12, False), "*": (13, False), "/": (13, False), "%": (13, False), "**": (14, True),
    }
    ts = False
    jsx = False

    # -- tokens on demand -------------------------------------------------
    def tokenize(self, text: str) -> None:
        self.text = text
        self.starts_at: list[int] = []
        self.ends: list[int] = []
        self.after_line: list[bool] = []
        self.no_in = False
        self.gaps: dict[int, tuple[int, str]] = {}  # blanks with comments by their offset
        self.reread = 0  # how often tokens were read in another way than ahead
        self.arrow_at = -1
        self.at = text.find("\n") if text.startswith("#!") and "\n" in text else len(text) if text.startswith("#!") else 0
        self.now = 1
        self.fill()

    def push_at(self, kind: str, tok: str, start: int, end: int, after: bool) -> None:
        self.kind.append(kind)
        self.tok.append(tok)
        self.view.append(tok if kind != "str" else "\0str")
        self.line.append(self.now)
        self.starts_at.append(start)
        self.ends.append(end)
        self.after_line.append(after)
        self.now += self.text.count("\n", start, end)
        self.at = end

    def fill(self) -> None:
        """Reads some more tokens."""
        text, at, now, match = self.text, self.at, self.now, NEXT.match
        kinds, toks, views, lines, starts, ends, breaks = self.kind, self.tok, self.view, self.line, self.starts_at, self.ends, self.after_line
        for _ in range(AHEAD):
            m = match(text, at)
            start, after = m.end("gap"), False
            if start > at:
                if start - at > 1:
                    gap = m["gap"]
                    if "/" in gap:
                        self.gaps[at] = (now, gap)
                    fresh = gap.count("\n")
                    if fresh:
                        now += fresh
                        after = True
                elif text[at] == "\n":
                    now += 1
                    after = True
            kind = m.lastgroup
            if kind == "gap":
                self.now = now
                if self.odd(start, after):
                    return
                at, now = self.at, self.now
                continue
            s = m[kind]
            kinds.append(kind)
            toks.append(s)
            views.append(s if kind != "str" else "\0str")
            lines.append(now)
            starts.append(start)
            ends.append(at := m.end())
            breaks.append(after)
            if kind == "str":
                now += s.count("\n")
        self.at, self.now = at, now

    def odd(self, start: int, after: bool) -> bool:
        """Reads what no token pattern covers; true at the end of the text."""
        text = self.text
        if start >= len(text):
            self.push_at("eof", "", len(text), len(text), after)
            return True
        if text[start] == "`":
            end = self.template(start)
            if end < 0:
                self.push_at("bad", "unterminated string", start, len(text), after)
            else:
                self.push_at("str", text[start:end], start, end, after)
        else:
            self.push_at("bad", "unterminated string" if text[start] in "'\"" else f"stray character {text[start]!r}", start, start + 1, after)
        return False

    def template(self, start: int) -> int:
        """End of a template literal, nested ones included; -1 if it has none."""
        text, i, stack = self.text, start + 1, ["`"]
        while i < len(text):
            c = text[i]
            if stack[-1] == "`":
                if c == "\\":
                    i += 1
                elif c == "`":
                    stack.pop()
                    if not stack:
                        return i + 1
                elif text.startswith("${", i):
                    stack.append("{")
                    i += 1
            elif c == "`":
                stack.append("`")
            elif c == "{":
                stack.append("{")
            elif c == "}":
                stack.pop()
            elif c in "'\"":
                m = TOKEN.match(text, i)
                i = m.end() - 1 if m else i
            i += 1
        return -1

    def ensure(self, j: int) -> None:
        while j >= len(self.tok):
            if self.kind[-1] == "eof":
                return
            self.fill()

    def cut(self, j: int) -> None:
        """Forgets the tokens from j on; they are read again when asked for."""
        self.reread += 1
        if j < len(self.tok):
            self.now, self.at = self.line[j], self.starts_at[j]
            if j:
                self.at, self.now = self.ends[j - 1], self.line[j - 1] + self.text.count("\n", self.starts_at[j - 1], self.ends[j - 1])
            else:
                self.at, self.now = 0, 1
            for part in (self.kind, self.tok, self.view, self.line, self.starts_at, self.ends, self.after_line):
                del part[j:]

    @property
    def t(self) -> str:
        try:
            return self.view[self.i]
        except IndexError:
            self.ensure(self.i)
            return self.view[min(self.i, len(self.view) - 1)]

    @property
    def k(self) -> str:
        try:
            return self.kind[self.i]
        except IndexError:
            self.ensure(self.i)
            return self.kind[min(self.i, len(self.kind) - 1)]

    def expect(self, tok: str) -> None:
        if self.t != tok:
            raise self.fault(repr(tok))
        self.i += 1

    def accept(self, tok: str) -> bool:
        if self.t == tok:
            self.i += 1
            return True
        return False

    @property
    def fresh(self) -> bool:
        """The current token begins a line."""
        self.ensure(self.i)
        return self.after_line[self.i]

    def peek(self, n: int = 1) -> str:
        try:
            return self.view[self.i + n]
        except IndexError:
            self.ensure(self.i + n)
            return super().peek(n)

    def peek_kind(self, n: int = 1) -> str:
        try:
            return self.kind[self.i + n]
        except IndexError:
            self.ensure(self.i + n)
            return super().peek_kind(n)

    def fault(self, wanted: str = "") -> Fault:
        self.ensure(self.i)
        self.i = min(self.i, len(self.tok) - 1)
        return super().fault(wanted)

    def attempt(self, rule, *args):
        at, reread = self.i, self.reread
        found, fault = super().attempt(rule, *args)
        if fault and self.reread != reread:
            self.cut(at + 1)
        return found, fault

    def semicolon(self) -> None:
        if self.accept(";") or self.t == "}" or self.k == "eof" or self.fresh:
            return
        raise self.fault("';'")

    def ident(self) -> None:
        if self.k != "id" or self.t in RESERVED:
            raise self.fault("a name")
        self.i += 1

    # -- statements -----------------------------------------------------
    def program(self) -> None:
        while self.k != "eof":
            if self.t in ("}", ")", "]"):
                self.errors.append((self.line[self.i], f"unexpected {self.t!r}"))
                self.i += 1
            else:
                self.guarded(self.statement)

    def block(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.expect("{")
        while self.t != "}":
            if self.k == "eof":
                raise self.fault("'}'")
            self.guarded(self.statement)
        self.i += 1
        self.no_in = no_in

    def condition(self) -> None:
        self.expect("(")
        self.expression()
        self.expect(")")

    def statement(self) -> None:
        t = self.t
        if t == "{":
            return self.block()
        if t == ";":
            self.i += 1
            return None
        if self.k != "id":
            if t == "@":
                self.decorators()
                return self.statement()
            self.expression()
            return self.semicolon()
        if t in ("var", "const") or t == "let" and (self.peek_kind() == "id" or self.peek() in ("[", "{")):
            if t == "const" and self.peek() == "enum" and self.ts:
                self.i += 1
                return self.enum()
            self.i += 1
            self.bindings()
            return self.semicolon()
        if t == "function" or t == "async" and self.peek() == "function":
            return self.function(named=True)
        if t == "class" or t == "abstract" and self.peek() == "class" and self.ts:
            self.accept("abstract")
            return self.klass(named=True)
        if t == "if":
            self.i += 1
            self.condition()
            self.statement()
            if self.accept("else"):
                self.statement()
            return None
        if t == "for":
            self.i += 1
            self.accept("await")
            self.expect("(")
            self.for_head()
            self.expect(")")
            return self.statement()
        if t in ("while", "with"):
            self.i += 1
            self.condition()
            return self.statement()
        if t == "do":
            self.i += 1
            self.statement()
            self.expect("while")
            self.condition()
            self.accept(";")
            return None
        if t in ("return", "throw"):
            self.i += 1
            if self.t not in (";", "}") and self.k != "eof" and not self.fresh:
                self.expression()
            elif t == "throw":
                raise self.fault("an expression")
            return self.semicolon()
        if t in ("break", "continue"):
            self.i += 1
            if self.k == "id" and not self.fresh:
                self.ident()
            return self.semicolon()
        if t == "switch":
            self.i += 1
            self.condition()
            self.expect("{")
            while self.t != "}":
                if self.accept("default"):
                    pass
                else:
                    self.expect("case")
                    self.expression()
                self.expect(":")
                while self.t not in ("case", "default", "}"):
                    if self.k == "eof":
                        raise self.fault("'}'")
                    self.guarded(self.statement)
            self.i += 1
            return None
        if t == "try":
            self.i += 1
            self.block()
            caught = False
            if self.accept("catch"):
                caught = True
                if self.accept("("):
                    self.binding()
                    self.annotation()
                    self.expect(")")
                self.block()
            if self.accept("finally"):
                self.block()
            elif not caught:
                raise self.fault("'catch'")
            return None
        if t == "import" and self.peek() not in ("(", "."):
            return self.imports()
        if t == "export":
            return self.exports()
        if t == "debugger":
            self.i += 1
            return self.semicolon()
        if self.ts and not self.after_line_next():
            if t == "interface" and self.peek_kind() == "id":
                self.i += 1
                self.ident()
                self.type_params()
                if self.accept("extends"):
                    self.type()
                    while self.accept(","):
                        self.type()
                return self.object_type()
            if t == "type" and self.peek_kind() == "id":
                self.i += 1
                self.ident()
                self.type_params()
                self.expect("=")
                self.type()
                return self.semicolon()
            if t == "enum":
                return self.enum()
            if t in ("namespace", "module") and (self.peek_kind() in ("id", "str")):
                self.i += 2
                while self.accept("."):
                    self.ident()
                return self.block()
            if t == "declare" and self.peek_kind() == "id":
                self.i += 1
                if self.accept("global"):
                    return self.block()
                return self.statement()
        if self.peek() == ":" and t not in RESERVED:
            self.i += 2
            return self.statement()
        self.expression()
        return self.semicolon()

    def after_line_next(self) -> bool:
        self.ensure(self.i + 1)
        return self.after_line[min(self.i + 1, len(self.after_line) - 1)]

    def for_head(self) -> None:
        self.no_in = True
        if self.t in ("var", "let", "const"):
            self.i += 1
            self.bindings(loop=True)
        elif self.t != ";":
            self.expression()
        self.no_in = False
        if self.t in ("of", "in"):
            self.i += 1
            return self.expression()
        self.expect(";")
        if self.t != ";":
            self.expression()
        self.expect(";")
        if self.t != ")":
            self.expression()
        return None

    def bindings(self, loop: bool = False) -> None:
        while True:
            name = self.i
            self.binding()
            if self.ts:
                self.accept("!")
            self.annotation()
            if self.accept("="):
                at = self.i
                self.assignment()
                if self.arrow_at == at:
                    self.functions.append(FunctionNode(name, name, *self.bracket_of_arrow, self.i - 1))
            if not self.accept(","):
                return

    def binding(self) -> None:
        t = self.t
        if t == "[":
            self.i += 1
            while self.t != "]":
                if self.accept(","):
                    continue
                self.accept("...")
                self.binding()
                if self.accept("="):
                    self.assignment()
                if not self.accept(","):
                    break
            self.expect("]")
        elif t == "{":
            self.i += 1
            while self.t != "}":
                if self.accept("..."):
                    self.binding()
                else:
                    name = self.k
                    self.property_name()
                    if self.accept(":"):
                        self.binding()
                    elif name != "id":
                        raise self.fault("':'")
                    if self.accept("="):
                        self.assignment()
                if not self.accept(","):
                    break
            self.expect("}")
        else:
            self.ident()

    def property_name(self) -> None:
        if self.k in ("id", "num", "str"):
            self.i += 1
        elif self.accept("["):
            self.assignment()
            self.expect("]")
        else:
            raise self.fault("a name")

    def imports(self) -> None:
        self.i += 1
        if self.k != "str":
            if self.t == "type" and self.ts and self.peek() != "from" and self.peek() != ",":
                self.i += 1
            if self.k == "id":
                self.ident()
                if self.ts and self.accept("="):
                    self.expression()
                    return self.semicolon()
                if self.accept(","):
                    self.import_names()
            else:
                self.import_names()
            self.expect("from")
        self.source()
        return self.semicolon()

    def import_names(self) -> None:
        if self.accept("*"):
            self.expect("as")
            self.ident()
        else:
            self.specifiers()

    def specifiers(self) -> None:
        self.expect("{")
        while self.t != "}":
            if self.ts and self.t == "type" and self.peek_kind() == "id" and self.peek() != "as":
                self.i += 1
            if self.k not in ("id", "str"):
                raise self.fault("a name")
            self.i += 1
            if self.accept("as"):
                if self.k not in ("id", "str"):
                    raise self.fault("a name")
                self.i += 1
            if not self.accept(","):
                break
        self.expect("}")

    def source(self) -> None:
        if self.k != "str":
            raise self.fault("a path")
        self.i += 1
        if self.t in ("with", "assert") and self.peek() == "{":
            self.i += 1
            self.skip_balanced()

    def exports(self) -> None:
        self.i += 1
        if self.ts and self.t == "type" and self.peek() in ("{", "*"):
            self.i += 1
        if self.accept("default"):
            if self.t in ("function", "class", "abstract") or self.t == "async" and self.peek() == "function":
                self.accept("abstract")
                return self.klass() if self.t == "class" else self.function()
            if self.t == "@":
                self.decorators()
                return self.klass()
            self.assignment()
            return self.semicolon()
        if self.accept("*"):
            if self.accept("as"):
                self.i += 1
            self.expect("from")
            self.source()
            return self.semicolon()
        if self.t == "{":
            self.specifiers()
            if self.accept("from"):
                self.source()
            return self.semicolon()
        if self.ts and self.accept("="):
            self.expression()
            return self.semicolon()
        if self.t in ("var", "let", "const", "function", "class", "async", "@") or self.ts and self.t in (
            "interface", "type", "enum", "namespace", "module", "declare", "abstract", "import",
        ):
            return self.statement()
        raise self.fault("a declaration")

    def enum(self) -> None:
        self.expect("enum")
        self.ident()
        self.expect("{")
        while self.t != "}":
            self.property_name()
            if self.accept("="):
                self.assignment()
            if not self.accept(","):
                break
        self.expect("}")

    def decorators(self) -> None:
        while self.accept("@"):
            if self.t == "(":
                self.group()
            else:
                self.ident()
                while self.accept("."):
                    self.i += 1
            if self.t == "(":
                self.arguments()

    # -- functions and classes --------------------------------------------
    def function(self, named: bool = False) -> None:
        first = self.i
        self.accept("async")
        self.expect("function")
        self.accept("*")
        name = self.i
        if self.t != "(" and self.t != "<":
            self.ident()
        elif named:
            raise self.fault("a name")
        self.signature()
        bracket, body = self.bracket, self.i
        if self.ts and self.t != "{":
            self.semicolon()
        else:
            self.block()
        if self.kind[name] == "id":
            self.functions.append(FunctionNode(first, name, *bracket, body, self.i - 1))
        else:
            self.arrow_at, self.bracket_of_arrow = first, (*bracket, body)

    def signature(self) -> None:
        self.type_params()
        self.params()
        if self.ts and self.accept(":"):
            self.return_type()

    def params(self) -> None:
        no_in, self.no_in = self.no_in, False
        opening = self.i
        self.expect("(")
        while self.t != ")":
            if self.t == "@":
                self.decorators()
            if self.ts:
                while self.t in ("public", "private", "protected", "readonly", "override") and (self.peek_kind() == "id" or self.peek() in ("{", "[")):
                    self.i += 1
            self.accept("...")
            if self.ts and self.t == "this":
                self.i += 1
            else:
                self.binding()
            if self.ts:
                self.accept("?")
            self.annotation()
            if self.accept("="):
                self.assignment()
            if not self.accept(","):
                break
        self.expect(")")
        self.bracket = (opening, self.i - 1)
        self.no_in = no_in

    def annotation(self) -> None:
        if self.ts and self.accept(":"):
            self.type()

    def klass(self, named: bool = False) -> None:
        self.expect("class")
        if self.k == "id" and self.t not in ("extends", "implements"):
            self.ident()
        elif named:
            raise self.fault("a name")
        self.type_params()
        if self.accept("extends"):
            self.left_side()
            if self.t == "<" and self.ts:
                self.type_args()
        if self.ts and self.accept("implements"):
            self.type()
            while self.accept(","):
                self.type()
        self.expect("{")
        while self.t != "}":
            if self.k == "eof":
                raise self.fault("'}'")
            self.guarded(self.member)
        self.i += 1

    def member(self) -> None:
        if self.accept(";"):
            return
        if self.t == "@":
            self.decorators()
        first = self.i
        if self.t == "static" and self.peek() == "{":
            self.i += 1
            return self.block()
        while self.t in MODIFIERS and self.peek() not in ("(", "=", ";", "}", ":", "?", "!", "<", ",") and self.peek_kind() != "eof":
            if not self.ts and self.t not in ("static", "async", "get", "set", "accessor"):
                raise self.fault()
            if self.after_line_next() and self.t not in ("static",):
                break
            self.i += 1
        self.accept("*")
        if self.ts and self.t == "[":  # an index signature
            _, fault = self.attempt(self.index_signature)
            if fault is None:
                return self.semicolon()
        name = self.i
        self.property_name()
        if self.ts:
            self.accept("?") or self.accept("!")
        if self.t in ("(", "<"):
            self.signature()
            bracket, body = self.bracket, self.i
            if self.t == "{":
                self.block()
            elif self.ts:
                self.semicolon()
            else:
                raise self.fault("'{'")
            self.functions.append(FunctionNode(first, name, *bracket, body, self.i - 1))
            return
        self.annotation()
        if self.accept("="):
            at = self.i
            self.assignment()
            if self.arrow_at == at:
                self.functions.append(FunctionNode(first, name, *self.bracket_of_arrow, self.i - 1))
        return self.semicolon()

    def index_signature(self) -> None:
        self.expect("[")
        self.ident()
        self.expect(":")
        self.type()
        self.expect("]")
        self.annotation()

    # -- types ------------------------------------------------------------
    def type_params(self) -> None:
        if not self.ts or not self.accept("<"):
            return
        while self.t != ">":
            while self.t in ("const", "in", "out") and self.peek_kind() == "id":
                self.i += 1
            self.ident()
            if self.accept("extends"):
                self.type()
            if self.accept("="):
                self.type()
            if not self.accept(","):
                break
        self.expect(">")

    def type_args(self) -> None:
        self.expect("<")
        while True:
            self.type()
            if not self.accept(","):
                break
        self.close()

    def close(self) -> None:
        t = self.t
        if len(t) > 1 and t[0] == ">" and self.k == "op":
            self.ensure(self.i)
            at = self.starts_at[self.i]
            after = self.after_line[self.i]
            self.cut(self.i)
            self.push_at("op", ">", at, at + 1, after)
        self.expect(">")

    def return_type(self) -> None:
        if self.t == "asserts" and self.peek_kind() == "id":
            self.i += 1
        if (self.k == "id") and self.peek() == "is":
            self.i += 2
        self.type()

    def type(self) -> None:
        self.union()
        if self.t == "extends" and not self.fresh:
            self.i += 1
            self.union()
            self.expect("?")
            self.type()
            self.expect(":")
            self.type()

    def union(self) -> None:
        self.accept("|") or self.accept("&")
        self.type_operand()
        while self.t in ("|", "&"):
            self.i += 1
            self.type_operand()

    def type_operand(self) -> None:
        while self.t in ("keyof", "readonly", "unique", "infer") and (self.peek_kind() in ("id", "str") or self.peek() in ("{", "(", "[")):
            self.i += 1
        self.type_primary()
        while not self.fresh:
            if self.accept("["):
                if self.t != "]":
                    self.type()
                self.expect("]")
            else:
                break

    def type_primary(self) -> None:
        t, k = self.t, self.k
        if t == "new" or t == "abstract" and self.peek() == "new":
            self.accept("abstract")
            self.i += 1
            return self.function_type()
        if t == "(" or t == "<":
            _, fault = self.attempt(self.function_type)
            if fault:
                self.expect("(")
                self.type()
                self.expect(")")
        elif t == "{":
            self.object_type()
        elif t == "[":
            self.i += 1
            while self.t != "]":
                self.accept("...")
                if self.k == "id" and (self.peek() == ":" or self.peek() == "?" and self.peek(2) == ":"):
                    self.i += 1
                    self.accept("?")
                    self.i += 1
                self.type()
                self.accept("?")
                if not self.accept(","):
                    break
            self.expect("]")
        elif k in ("str", "num"):
            self.i += 1
        elif t == "-" and self.peek_kind() == "num":
            self.i += 2
        elif t == "typeof":
            self.i += 1
            self.i += 1
            while self.accept("."):
                self.i += 1
        elif t == "import":
            self.i += 1
            self.arguments()
            while self.accept("."):
                self.i += 1
            if self.t == "<":
                self.type_args()
        elif k == "id" and (t not in RESERVED or t in ("this", "void", "null", "true", "false")):
            self.i += 1
            while self.accept("."):
                if self.k != "id":
                    raise self.fault("a name")
                self.i += 1
            if self.t == "<" and not self.fresh:
                self.type_args()
        else:
            raise self.fault("a type")
        return None

    def function_type(self) -> None:
        self.type_params()
        self.params()
        self.expect("=>")
        self.return_type()

    def object_type(self) -> None:
        self.expect("{")
        while self.t != "}":
            while self.t in ("readonly", "+", "-", "get", "set") and self.peek() not in (":", "?", "(", ";", ",", "}"):
                self.i += 1
            if self.t in ("(", "<"):
                self.signature()
            elif self.t == "new" and self.peek() in ("(", "<"):
                self.i += 1
                self.signature()
            else:
                if self.t == "[":
                    self.i += 1
                    if self.k == "id" and self.peek() == ":":
                        self.i += 2
                        self.type()
                    elif self.k == "id" and self.peek() == "in":
                        self.i += 2
                        self.type()
                        if self.accept("as"):
                            self.type()
                    else:
                        self.assignment()
                    self.expect("]")
                else:
                    self.property_name()
                self.accept("-") or self.accept("+")
                self.accept("?")
                if self.t in ("(", "<"):
                    self.signature()
                else:
                    self.annotation()
            if not self.accept(",") and not self.accept(";") and self.t != "}" and not self.fresh:
                raise self.fault("'}'")
        self.i += 1

    # -- expressions ----------------------------------------------------
    def expression(self) -> None:
        self.assignment()
        while self.accept(","):
            self.assignment()

    def assignment(self) -> None:
        t = self.t
        if t == "yield" and self.k == "id":
            self.i += 1
            self.accept("*")
            if self.t not in (")", "]", "}", ",", ";", ":") and self.k != "eof" and not self.fresh:
                self.assignment()
            return
        if t == "async" and not self.after_line_next() and self.peek() != "function" and (self.peek_kind() == "id" and self.peek(2) == "=>" or self.peek() in ("(", "<")):
            _, fault = self.attempt(self.arrow)
            if fault is None:
                return
            if getattr(fault, "sure", False):
                raise fault
        elif t in ("(", "<") and (t == "(" or self.ts) or self.k == "id" and self.peek() == "=>":
            _, fault = self.attempt(self.arrow)
            if fault is None:
                return
            if getattr(fault, "sure", False):
                raise fault
        start = self.i
        self.binary(3)
        if self.accept("?"):
            no_in, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = no_in
            self.expect(":")
            self.assignment()
        elif self.k == "op" and self.t in ASSIGN:
            if self.kind[self.i - 1] in ("num",) or self.kind[self.i - 1] == "str" or self.i - start == 1 and self.tok[start] in RESERVED:
                raise self.fault("an assignable expression")
            self.i += 1
            self.assignment()

    def arrow(self) -> None:
        first = self.i
        self.accept("async")
        if self.k == "id" and self.peek() == "=>":
            bracket = (self.i - 1, self.i + 1)  # the one parameter stands bare
            self.ident()
        else:
            self.signature()
            bracket = self.bracket
        if self.fresh:
            raise self.fault()
        body = self.i
        self.expect("=>")
        try:
            if self.t == "{":
                self.block()
            else:
                self.assignment()
        except Fault as fault:
            fault.sure = True  # the arrow was there, so nothing else can be meant
            raise
        self.arrow_at, self.bracket_of_arrow = first, (*bracket, body)

    def operator(self) -> str:
        t = self.t
        if self.k == "op":
            return t
        if t == "in":
            return "" if self.no_in else t
        if t == "instanceof" or t in ("as", "satisfies") and self.ts and not self.fresh:
            return t
        return ""

    def binary(self, least: int = 0) -> None:
        self.unary()
        rules = self.BINARY
        while True:
            if self.t not in rules:
                return
            op = self.operator()
            rule = rules.get(op)
            if rule is None or rule[0] < least:
                return
            self.i += 1
            if op in ("as", "satisfies"):
                self.accept("const") or self.type()
            else:
                self.binary(rule[0] if rule[1] else rule[0] + 1)

    def unary(self) -> None:
        while True:
            t = self.t
            if t not in PREFIXES:
                break
            k = self.k
            if k == "op" and t in ("!", "~", "+", "-", "++", "--") or k == "id" and t in ("typeof", "void", "delete"):
                self.i += 1
            elif t == "await" and k == "id" and (self.peek_kind() in ("id", "num", "str") or self.peek() in ("(", "[", "{", "`")):
                self.i += 1
            elif t == "<" and self.ts and not self.jsx:
                if self.peek() == "const" and self.peek(2) == ">":
                    self.i += 3
                else:
                    self.type_args()
            else:
                break
        self.left_side()
        if self.t in ("++", "--") and not self.fresh:
            self.i += 1

    def left_side(self) -> None:
        if self.t == "new":
            self.i += 1
            if self.accept("."):
                self.ident()
            else:
                self.new_target()
        else:
            self.primary()
        if self.t in TRAILERS:
            self.trailers(True)

    def new_target(self) -> None:
        if self.t == "new":
            self.i += 1
            self.new_target()
        else:
            self.primary()
        self.trailers(False)
        if self.t == "<" and self.ts:
            self.attempt(self.type_args)
        if self.t == "(":
            self.arguments()

    def trailers(self, calls: bool) -> None:
        while True:
            t = self.t
            if t not in TRAILERS:
                return
            if t == ".":
                self.i += 1
                if self.k != "id":
                    raise self.fault("a name")
                self.i += 1
            elif t == "?.":
                self.i += 1
                if self.t == "(":
                    self.arguments()
                elif self.t == "[":
                    self.index()
                else:
                    if self.k != "id":
                        raise self.fault("a name")
                    self.i += 1
            elif t == "[":
                self.index()
            elif t == "(" and calls:
                self.arguments()
            elif self.k == "str" and self.tok[self.i][0] == "`":
                self.i += 1
            elif t == "!" and self.ts and not self.fresh and self.peek() != "=":
                self.i += 1
            elif t == "<" and self.ts and calls:
                _, fault = self.attempt(self.call_types)
                if fault:
                    return
            else:
                return

    def call_types(self) -> None:
        self.type_args()
        if self.t != "(" and not (self.k == "str" and self.tok[self.i][0] == "`"):
            raise self.fault("'('")

    def index(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.expect("[")
        self.expression()
        self.expect("]")
        self.no_in = no_in

    def arguments(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.expect("(")
        while self.t != ")":
            self.accept("...")
            self.assignment()
            if not self.accept(","):
                break
        self.expect(")")
        self.no_in = no_in

    def group(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.expect("(")
        self.expression()
        self.expect(")")
        self.no_in = no_in

    def primary(self) -> None:
        t, k = self.t, self.k
        if k == "id" and t not in RESERVED and t != "async" and t != "import":
            self.i += 1
        elif k in ("num", "str"):
            if k == "num" and self.peek_kind() in ("id", "num") and self.starts_at[self.i + 1] == self.ends[self.i]:
                self.i += 1
                raise self.fault()
            self.i += 1
        elif t == "(":
            self.group()
        elif t == "[":
            no_in, self.no_in = self.no_in, False
            self.i += 1
            while self.t != "]":
                if self.accept(","):
                    continue
                self.accept("...")
                self.assignment()
                if not self.accept(","):
                    break
            self.expect("]")
            self.no_in = no_in
        elif t == "{":
            self.object()
        elif t in ("/", "/="):
            at, after = self.starts_at[self.i], self.after_line[self.i]
            m = REGEX.match(self.text, at)
            if not m:
                raise self.fault("an expression")
            self.cut(self.i)
            self.push_at("str", m.group(), at, m.end(), after)
            self.i += 1
        elif t == "function" or t == "async" and self.peek() == "function":
            self.function()
        elif t == "class":
            self.klass()
        elif t == "@":
            self.decorators()
            self.klass()
        elif t == "<" and self.jsx:
            self.element()
        elif t == "import" and self.peek() in ("(", "."):
            self.i += 1
            if self.accept("."):
                self.ident()
        elif k == "id" and (t not in RESERVED or t in ("this", "super", "null", "true", "false")):
            self.i += 1
        else:
            raise self.fault("an expression")

    def object(self) -> None:
        no_in, self.no_in = self.no_in, False
        self.expect("{")
        while self.t != "}":
            if self.accept("..."):
                self.assignment()
            else:
                while self.t in ("async", "get", "set") and self.peek() not in (",", ":", "(", "}", "=", "<"):
                    self.i += 1
                self.accept("*")
                kind, word = self.k, self.t
                self.property_name()
                if self.t in ("(", "<"):
                    self.signature()
                    self.block()
                elif self.accept(":"):
                    self.assignment()
                elif kind != "id" or word in RESERVED:
                    raise self.fault("':'")
                elif self.accept("="):
                    self.assignment()
            if not self.accept(","):
                break
        self.expect("}")
        self.no_in = no_in

    # -- elements -----------------------------------------------------------
    def element(self) -> None:
        self.expect("<")
        tag = self.tag_name() if self.t != ">" else ""
        if self.ts and self.t == "<":
            self.type_args()
        while self.t not in (">", "/"):
            if self.accept("{"):
                self.expect("...")
                self.assignment()
                self.expect("}")
                continue
            if self.k != "id":
                raise self.fault("an attribute")
            self.i += 1
            while self.t in ("-", ":"):
                self.i += 2
            if self.accept("="):
                if self.t == "{":
                    self.i += 1
                    self.assignment()
                    self.expect("}")
                elif self.t == "<":
                    self.element()
                elif self.k == "str":
                    self.i += 1
                else:
                    raise self.fault("a value")
        if self.accept("/"):
            return self.expect(">")
        while True:  # children: the text up to the next brace or tag is read raw
            self.ensure(self.i)
            self.cut(self.i + 1)
            end = self.at
            while end < len(self.text) and self.text[end] not in "<{}>":
                end += 1
            if end >= len(self.text):
                self.i += 1
                raise self.fault("a closing tag")
            if self.text[end] in "}>":
                self.now += self.text.count("\n", self.at, end)
                raise Fault(self.now, f"unexpected {self.text[end]!r} in an element")
            self.now += self.text.count("\n", self.at, end)
            self.at = end
            self.i += 1
            if self.t == "{":
                self.i += 1
                if self.t == "...":
                    self.i += 1
                if self.t != "}":
                    self.expression()
                if self.t != "}":
                    raise self.fault("'}'")
                continue
            if self.peek() == "/":
                self.i += 2
                closing = self.tag_name() if self.t != ">" else ""
                if closing != tag:
                    raise self.fault(f"</{tag}>")
                return self.expect(">")
            self.element_child()

    def element_child(self) -> None:
        self.element()
        self.i -= 1  # stands on '>' again, from where the raw text goes on

    def tag_name(self) -> str:
        if self.k != "id":
            raise self.fault("a tag")
        name = self.next()
        while self.t in (".", "-", ":"):
            name += self.next()
            name += self.next()
        return name


class JsxParser(JsParser):
    jsx = True


class TsParser(JsParser):
    ts = True


class TsxParser(TsParser):
    jsx = True
