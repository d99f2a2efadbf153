"""C, C++ and C with embedded SQL."""

from __future__ import annotations

import re

from sylvan.llm.syntax.base import Fault, FunctionNode, Parser, lex

MASTER = re.compile(
    r"""(?P<ws>[ \t\r\n\f\v]+|\\\r?\n)
    |(?P<comment>//(?:\\\r?\n|[^\n])*|/\*.*?\*/)
    |(?P<bad_comment>/\*.*)
    |(?P<str>(?:u8|[LuU])?R"(?P<mark>[^()\s\\]{0,16})\(.*?\)(?P=mark)"|(?:u8|[LuU])?"(?:\\.|[^"\\\n])*"|(?:u8|[LuU])?'(?:\\.|[^'\\\n])+')
    |(?P<bad_str>["'][^\n]*)
    |(?P<num>\.?\d(?:'?[\w.]|[eEpP][+-])*)
    |(?P<id>[A-Za-z_$][\w$]*)
    |(?P<op>\#\#|\#|\.\.\.|<<=|>>=|->\*|<=>|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|::|[-+*/%&|^~!<>=?:;,.(){}\[\]])""",
    re.X | re.S | re.ASCII,
)
DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(?:[a-z]+\b|$)(?:\\\r?\n|//[^\n]*|/\*.*?\*/|[^\n\\/]|\\|/)*", re.M | re.S)
#: what comments and strings hide, and the directives whose balance counts
CONDITIONAL = re.compile(
    r"""^(?:[ \t]|/\*(?:[^*]|\*(?!/))*\*/)*\#(?:[ \t]|/\*(?:[^*]|\*(?!/))*\*/)*(?P<word>ifdef|ifndef|if|elifdef|elifndef|elif|else|endif)\b
    |//(?:\\\r?\n|[^\n])*|/\*.*?(?:\*/|\Z)
    |\bR"(?P<mark>[^()\s\\]{0,16})\(.*?\)(?P=mark)"|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""",
    re.X | re.M | re.S,
)

QUALIFIERS = frozenset(
    "const static extern inline register volatile typedef constexpr consteval constinit virtual explicit mutable friend "
    "thread_local restrict __restrict __inline __inline__ __extension__ _Noreturn _Thread_local _Atomic typename".split()
)
BUILTIN = frozenset(
    "void char short int long float double signed unsigned bool _Bool auto wchar_t char8_t char16_t char32_t size_t".split()
)
CALL_LIKE = frozenset("__attribute__ __declspec alignas decltype typeof __typeof__ _Alignas noexcept".split())
TAGS = frozenset("struct class union enum".split())
AFTER_PARAMS = frozenset("const noexcept override final volatile & && throw mutable".split())
WORDS = (
    QUALIFIERS
    | BUILTIN
    | TAGS
    | frozenset("if else for while do switch case default return break continue goto sizeof namespace using template".split())
)
#: names that by custom only macros have
MACRO = re.compile(r"^(?:_*[A-Z][A-Z0-9_]*|[A-Z][A-Za-z]*_[A-Z0-9_]+|__\w+)$")
ASSIGN = "= += -= *= /= %= &= |= ^= <<= >>=".split()


class CParser(Parser):
    BINARY = {op: (1, True) for op in ASSIGN} | {
        "||": (4, False), "&&": (5, False), "|": (6, False), "^": (7, False), "&": (8, False), "==": (9, False), "!=": (9, False),
        "<": (10, False), ">": (10, False), "<=": (10, False), ">=": (10, False), "<=>": (10, False), "<<": (11, False), ">>": (11, False),
        "+": (12, False), "-": (12, False), "*": (13, False), "/": (13, False), "%": (13, False), "->*": (14, False),
    }
    cpp = False

    def tokenize(self, text: str) -> None:
        if "#" in text:
            self.conditionals(text)
        # directives become blank lines, so that later tokens keep their line numbers
        text = DIRECTIVE.sub(lambda m: re.sub(r"[^\n]+", "", m.group()), text)
        lex(self, text, MASTER)

    def conditionals(self, text: str) -> None:
        """Errors for #else, #elif and #endif without their #if, and for an #if that the file does not close."""
        open_: list[bool] = []  # per open #if: whether its #else has been seen
        line, at = 1, 0
        for m in CONDITIONAL.finditer(text):
            word = m["word"]
            if word is None:
                continue
            line, at = line + text.count("\n", at, m.start("word")), m.start("word")
            if word.startswith("if"):
                open_.append(False)
            elif not open_ or word != "endif" and open_[-1]:
                self.errors.append((line, f"unexpected '#{word}'"))
            elif word == "endif":
                open_.pop()
            elif word == "else":
                open_[-1] = True
        if open_:
            self.errors.append((line + text.count("\n", at), "unexpected end of file"))

    # -- declarations ---------------------------------------------------
    def program(self) -> None:
        while self.k != "eof":
            if self.t == "}":
                self.errors.append((self.line[self.i], "unexpected '}'"))
                self.i += 1
            else:
                self.guarded(self.external)

    def body(self, rule) -> None:
        self.expect("{")
        while self.t != "}":
            if self.k == "eof":
                raise self.fault("'}'")
            self.guarded(rule)
        self.i += 1

    def external(self) -> None:
        t = self.t
        if t == ";":
            self.i += 1
        elif t == "EXEC" and self.peek() == "SQL":
            self.embedded_sql()
        elif t == "template" and self.cpp:
            self.i += 1
            if self.t == "<":
                self.angles()
            self.external()
        elif (t == "namespace" or t == "inline" and self.peek() == "namespace") and self.cpp:
            self.i += 1 + (t == "inline")
            while self.k == "id" or self.t == "::":
                self.i += 1
            if self.t == "(" and MACRO.match(self.tok[self.i - 1]):
                self.skip_balanced()
            if self.accept("="):
                self.qualified()
                self.expect(";")
            else:
                self.body(self.external)
        elif t == "using" and self.cpp:
            self.i += 1
            self.accept("namespace")
            self.accept("typename")
            self.qualified()
            if self.accept("="):
                self.specifiers()
                self.declarator()
            self.expect(";")
        elif t == "extern" and self.peek_kind() == "str":
            self.i += 2
            if self.t == "{":
                self.body(self.external)
            else:
                self.external()
        elif t in ("static_assert", "_Static_assert", "asm", "__asm__") and self.peek() == "(":
            self.i += 1
            self.arguments()
            self.expect(";")
        elif self.cpp and t in ("public", "private", "protected", "signals", "slots") and self.peek() == ":":
            self.i += 2
        else:
            self.declaration(scope=True)

    def embedded_sql(self) -> None:
        while self.t != ";":
            if self.k in ("eof", "bad") or self.t in ("{", "}"):
                raise self.fault("';'")
            self.i += 1
        self.i += 1

    def angles(self) -> None:
        """Template parameters or arguments: types or expressions between angle brackets."""
        self.expect("<")
        depth = 1
        while depth:
            t = self.t
            if self.k in ("eof", "bad") or t in (";", "{", "}"):
                raise self.fault("'>'")
            if t in ("(", "["):
                self.skip_balanced()
                continue
            depth += (t == "<") - (t == ">") - 2 * (t == ">>")
            self.i += 1

    def qualified(self) -> None:
        self.accept("::")
        while True:
            if self.t == "operator":
                self.operator_name()
                return
            self.accept("~")
            self.name()
            if self.cpp and self.t == "<":
                self.attempt(self.angles)
            if self.t == "::" and (self.peek_kind() == "id" or self.peek() == "~"):
                self.i += 1
                self.accept("template")
                continue
            return

    def operator_name(self) -> None:
        self.i += 1
        if self.t in ("(", "["):
            self.i += 1
            self.i += 1
        elif self.k == "op":
            self.i += 1
        else:
            self.specifiers()
            while self.t in ("*", "&"):
                self.i += 1

    def specifiers(self) -> bool:
        """Storage, qualifiers and one type; false if none was there."""
        typed = fixed = False
        start = self.i
        while True:
            t = self.t
            if t in QUALIFIERS:
                self.i += 1
            elif t in BUILTIN:
                typed = fixed = True
                self.i += 1
            elif t in TAGS:
                self.tagged()
                typed = fixed = True
            elif t in CALL_LIKE and self.peek() == "(":
                self.i += 1
                self.skip_balanced()
                typed = typed or t in ("decltype", "typeof", "__typeof__")
            elif t == "[" and self.peek() == "[" and self.cpp:
                self.skip_balanced()
            elif self.k == "id" and self.peek() == "(" and MACRO.match(t) and self.macro_call():
                typed = True
            elif (self.k == "id" or t == "::" and self.peek_kind() == "id") and t not in WORDS and t != "operator":
                if typed:
                    # one more type word only where yet another name must follow (an unknown macro came first)
                    pointer = self.peek() in ("*", "&") and MACRO.match(self.tok[self.i - 1])
                    if fixed or not (pointer or self.peek_kind() == "id" and self.peek() not in WORDS or self.peek() in BUILTIN):
                        break
                elif self.peek() == "(" and self.i > start and not self.cpp:
                    break
                elif self.peek() == "(":
                    break
                at = self.i
                self.qualified()
                if self.t == "(" and self.tok[self.i - 2] == "::" or self.tok[self.i - 2] == "~":
                    self.i = at
                    break
                typed = True
            else:
                break
        return self.i > start

    def macro_call(self) -> bool:
        """Over a macro call that stands before a declaration: another name or a pointer must follow."""
        at = self.i
        self.i += 1
        _, fault = self.attempt(self.skip_balanced)
        if fault is None and (self.k == "id" and self.t not in ("else", "while") or self.t == "*"):
            return True
        self.i = at
        return False

    def tagged(self) -> None:
        tag = self.next()
        if tag == "enum" and self.t in ("class", "struct"):
            self.i += 1
        if self.k == "id" and self.peek_kind() == "id" and MACRO.match(self.t) and self.peek() != "final" and self.peek(2) in ("{", ":", "final", ";"):
            self.i += 1
        while self.t in CALL_LIKE and self.peek() == "(":
            self.i += 1
            self.skip_balanced()
        if self.k == "id":
            self.qualified()
            if self.t == "final":
                self.i += 1
        elif self.t != "{":
            raise self.fault("a name or '{'")
        if self.t == ":" and (self.cpp or tag == "enum") and self.i + 1 < len(self.tok) and self.peek_kind() == "id":
            at = self.i
            while self.t != "{":
                if self.k in ("eof", "bad") or self.t in (";", ")", "}"):
                    self.i = at  # a bit field
                    return
                self.i += 1
        if self.t == "{":
            if tag == "enum":
                self.i += 1
                while self.t != "}":
                    self.name()
                    if self.accept("="):
                        self.binary(2)
                        self.conditional_rest()
                    if not self.accept(","):
                        break
                self.expect("}")
            else:
                self.body(self.external)

    def declaration(self, scope: bool = False) -> None:
        first = self.i
        had = self.specifiers()
        if self.t == ";":
            if not had:
                raise self.fault()
            self.i += 1
            return
        if self.t == "[" and self.cpp and self.peek_kind() == "id":  # structured binding
            self.skip_balanced()
            function = False
        else:
            function = self.declarator(named=True)
        while True:
            if self.accept(":") and not (function and scope):
                self.binary(2)
            elif self.tok[self.i - 1] == ":" and function and scope:
                self.i -= 1
            if function and scope and self.t in ("{", ":", "try") or function and scope and self.k == "id" and self.t not in AFTER_PARAMS:
                self.accept("try")
                if self.accept(":"):
                    while True:
                        self.qualified()
                        if self.t not in ("(", "{"):
                            raise self.fault()
                        self.skip_balanced()
                        self.accept("...")
                        if not self.accept(","):
                            break
                while self.t != "{":  # parameters declared in the old style
                    if self.k != "id":
                        raise self.fault("'{'")
                    self.declaration()
                (opening, closing), body = self.bracket, self.i
                self.block()
                self.functions.append(FunctionNode(first, opening - 1, opening, closing, body, self.i - 1))
                while self.t == "catch":
                    self.i += 1
                    self.skip_balanced()
                    self.block()
                return
            if self.accept("="):
                if self.t in ("default", "delete"):
                    self.i += 1
                else:
                    self.initializer()
            elif self.t == "{" and self.cpp and not function:
                self.initializer()
            if self.accept(","):
                function = self.declarator(named=True)
                continue
            if not had and not function:
                raise self.fault()
            self.expect(";")
            return

    def declarator(self, named: bool = False) -> bool:
        """Pointers, a name, and suffixes; true if it declares a function."""
        while self.t in ("*", "&", "&&", "^") or self.t in QUALIFIERS or self.t == "...":
            self.i += 1
        if self.t in CALL_LIKE and self.peek() == "(":
            self.i += 1
            self.skip_balanced()
        if self.k == "id" and self.peek_kind() == "id" and MACRO.match(self.t) and self.peek() not in WORDS:
            self.i += 1
        function = False
        if self.t == "(" and self.peek() in ("*", "&", "^", "&&", "("):
            self.i += 1
            self.declarator(named)
            self.expect(")")
        elif self.k == "id" and self.t not in WORDS or self.t in ("~", "::", "operator"):
            self.qualified()
            if self.t == "::" and self.peek() == "*":
                self.i += 2
                if self.k == "id":
                    self.qualified()
        elif named:
            if not (self.t == ":" or self.t == "("):
                raise self.fault("a name")
        while True:
            if self.t == "[":
                self.i += 1
                while self.t in ("static", "const", "restrict"):
                    self.i += 1
                if self.t != "]":
                    self.expression()
                self.expect("]")
            elif self.t == "(":
                self.parameters()
                function = True
                while self.t in AFTER_PARAMS or self.t in CALL_LIKE or self.t == "->":
                    word = self.next()
                    if word in ("throw", "noexcept", *CALL_LIKE) and self.t == "(":
                        self.skip_balanced()
                    elif word == "->":
                        self.specifiers()
                        self.declarator()
            else:
                return function

    def parameters(self) -> None:
        opening = self.i
        self.expect("(")
        while self.t != ")":
            if self.accept("..."):
                break
            _, first = self.attempt(self.parameter)
            if first:
                _, second = self.attempt(self.item)
                if second:
                    worst = max(first, second, key=lambda f: f.reached)
                    self.i = worst.reached
                    raise worst
            if not self.accept(","):
                break
        self.expect(")")
        self.bracket = (opening, self.i - 1)

    def parameter(self) -> None:
        if not self.specifiers():
            raise self.fault("a type")
        self.declarator()
        if self.accept("="):
            self.initializer()
        if self.t not in (",", ")"):
            raise self.fault()

    # -- statements -----------------------------------------------------
    def block(self) -> None:
        self.body(self.statement)

    def parenthesized(self) -> None:
        self.expect("(")
        if self.starts_declaration():
            _, fault = self.attempt(self.condition_declaration)
            if fault is None:
                self.expect(")")
                return
        self.expression()
        if self.cpp and self.accept(";"):
            self.expression()
        self.expect(")")

    def condition_declaration(self) -> None:
        self.specifiers()
        self.declarator(named=True)
        if not self.accept("="):
            raise self.fault()
        self.initializer()
        if self.accept(";"):
            self.expression()
        if self.t != ")":
            raise self.fault()

    def statement(self) -> None:
        t = self.t
        if self.k == "id":
            if t == "if":
                self.i += 1
                self.accept("constexpr")
                self.parenthesized()
                self.statement()
                if self.accept("else"):
                    self.statement()
                return
            if t in ("while", "switch"):
                self.i += 1
                self.parenthesized()
                return self.statement()
            if t == "for":
                self.i += 1
                self.expect("(")
                if not self.accept(";"):
                    if self.starts_declaration():
                        self.for_declaration()
                    else:
                        self.expression()
                        self.expect(";")
                    if self.tok[self.i - 1] == ")":
                        return self.statement()
                if self.t != ";":
                    self.expression()
                self.expect(";")
                if self.t != ")":
                    self.expression()
                self.expect(")")
                return self.statement()
            if t == "do":
                self.i += 1
                self.statement()
                self.expect("while")
                self.parenthesized()
                self.expect(";")
                return None
            if t == "return":
                self.i += 1
                if self.t != ";":
                    self.item()
                return self.expect(";")
            if t in ("break", "continue"):
                self.i += 1
                return self.expect(";")
            if t == "goto":
                self.i += 1
                self.accept("*")
                self.name()
                return self.expect(";")
            if t == "case":
                self.i += 1
                self.conditional()
                if self.accept("..."):
                    self.conditional()
                return self.expect(":")
            if t == "default" and self.peek() == ":":
                self.i += 2
                return None
            if t == "else":
                raise self.fault()
            if t == "EXEC" and self.peek() == "SQL":
                return self.embedded_sql()
            if self.cpp and t == "try":
                self.i += 1
                self.block()
                if self.t != "catch":
                    raise self.fault("'catch'")
                while self.accept("catch"):
                    self.skip_balanced()
                    self.block()
                return None
            if self.cpp and t == "throw" and self.peek() == ";":
                self.i += 2
                return None
            if t in ("static_assert", "using", "namespace", "typedef") or t in TAGS:
                return self.external()
            if self.peek() == ":" and self.peek(2) != ":" and t not in WORDS:
                self.i += 2
                return None
        elif t == "{":
            return self.block()
        elif t == ";":
            self.i += 1
            return None
        if self.starts_declaration():
            _, first = self.attempt(self.declaration)
            if first is None:
                return None
            if t in BUILTIN or t in QUALIFIERS:
                self.i = first.reached
                raise first
            _, second = self.attempt(self.expression_statement)
            if second:
                worst = max(first, second, key=lambda f: f.reached)
                self.i = worst.reached
                raise worst
            return None
        return self.expression_statement()

    def for_declaration(self) -> None:
        self.specifiers()
        if self.t == "[":
            self.skip_balanced()
        else:
            self.declarator(named=True)
        if self.cpp and self.accept(":"):
            self.item()
            self.expect(")")
            return
        while True:
            if self.accept("=") or self.t == "{":
                self.initializer()
            if not self.accept(","):
                break
            self.declarator(named=True)
        self.expect(";")

    def expression_statement(self) -> None:
        self.expression()
        self.expect(";")

    def starts_declaration(self) -> bool:
        t = self.t
        if t in BUILTIN or t in QUALIFIERS or t in TAGS:
            return not (t in BUILTIN and self.peek() in ("(", "{"))
        if self.k != "id" and t != "::" or t in WORDS:
            return False
        j, n, word = self.i, len(self.tok), False
        while j < n:  # a qualified name, then pointers, then a name
            if self.kind[j] == "id" and not word:
                word = True
            elif self.tok[j] == "::" :
                word = False
            else:
                break
            j += 1
        if self.cpp and self.tok[j] == "<":
            depth = 0
            while j < n and self.tok[j] not in (";", "{", "}", "(", ")") and self.kind[j] != "eof":
                depth += (self.tok[j] == "<") - (self.tok[j] == ">") - 2 * (self.tok[j] == ">>")
                j += 1
                if depth <= 0:
                    break
        while self.tok[j] in ("*", "&", "&&", "const"):
            j += 1
        return self.kind[j] == "id" and j > self.i and self.tok[j] not in WORDS

    # -- expressions ----------------------------------------------------
    def expression(self) -> None:
        self.assignment()
        while self.accept(","):
            self.assignment()

    def assignment(self) -> None:
        self.binary(1)
        self.conditional_rest()

    def conditional(self) -> None:
        self.binary(2)
        self.conditional_rest()

    def conditional_rest(self) -> None:
        if self.accept("?"):
            if self.t != ":":
                self.expression()
            self.expect(":")
            self.assignment()

    def item(self) -> None:
        if self.t == "{":
            self.initializer()
        else:
            self.assignment()
        self.accept("...")

    def initializer(self) -> None:
        if self.t != "{":
            return self.assignment()
        self.i += 1
        while self.t != "}":
            while self.t in (".", "[") and not (self.t == "[" and self.cpp):
                if self.accept("."):
                    self.name()
                else:
                    self.i += 1
                    self.conditional()
                    self.expect("]")
            self.accept("=")
            self.initializer()
            self.accept("...")
            if not self.accept(","):
                break
        self.expect("}")
        return None

    def arguments(self) -> None:
        self.expect("(")
        while self.t != ")":
            if self.t in BUILTIN or self.t in TAGS or self.t in QUALIFIERS:  # a type as in va_arg or sizeof-like macros
                self.specifiers()
                self.declarator()
            else:
                self.item()
            if not self.accept(","):
                break
        self.expect(")")

    def unary(self) -> None:
        while True:
            t = self.t
            if t in ("+", "-", "!", "~", "*", "&", "++", "--", "&&") and self.k == "op":
                self.i += 1
                continue
            if t in ("sizeof", "_Alignof", "alignof"):
                self.i += 1
                self.accept("...")
                if self.t == "(":
                    return self.postfix_of(self.type_or_group)
                continue
            if self.cpp and t in ("co_await", "co_yield", "throw"):
                self.i += 1
                continue
            if self.cpp and t in ("new", "delete"):
                self.i += 1
                if t == "delete":
                    if self.t == "[":
                        self.i += 1
                        self.expect("]")
                    continue
                if self.t == "(":
                    self.skip_balanced()
                self.specifiers()
                while self.t == "*":
                    self.i += 1
                while self.t == "[":
                    self.skip_balanced()
                if self.t == "(":
                    self.arguments()
                elif self.t == "{":
                    self.initializer()
                return self.postfix()
            break
        if self.t == "(":
            return self.group()
        return self.postfix_of(self.primary)

    def type_or_group(self) -> None:
        _, fault = self.attempt(self.type_group)
        if fault:
            self.i += 1
            self.expression()
            self.expect(")")

    def type_group(self) -> None:
        self.expect("(")
        if not self.specifiers():
            raise self.fault("a type")
        self.declarator()
        self.expect(")")

    def group(self) -> None:
        """A parenthesized expression, a cast, a compound literal or a statement expression."""
        if self.peek() == "{":
            self.i += 1
            self.block()
            self.expect(")")
            return self.postfix()
        word = self.peek()
        if word in BUILTIN or word in QUALIFIERS or word in TAGS:
            self.type_group()
            if self.t == "{":
                self.initializer()
                return self.postfix()
            return self.unary()
        at = self.i
        _, fault = self.attempt(self.plain_group)
        if fault:
            _, other = self.attempt(self.type_group)
            if other:
                self.i = fault.reached
                raise fault
        elif self.k in ("id", "num", "str") and self.t not in WORDS or self.t == "(" and self.kind[self.i - 2] == "id" and self.i - at == 3:
            return self.unary()  # a cast to a named type
        else:
            return self.postfix()
        if self.t == "{":
            self.initializer()
            return self.postfix()
        return self.unary()

    def plain_group(self) -> None:
        self.expect("(")
        self.expression()
        if self.t == "..." or self.BINARY.get(self.t) and self.peek() == "...":
            while self.t != ")":
                self.i += 1
        self.expect(")")

    def primary(self) -> None:
        k, t = self.k, self.t
        if k == "num":
            self.i += 1
        elif k == "str":
            while self.k == "str" or self.k == "id" and self.peek_kind() == "str":
                self.i += 1
        elif k == "id" and t not in WORDS or t == "::" or t in BUILTIN:
            if t in BUILTIN:
                self.i += 1
            else:
                if t in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast") and self.peek() == "<":
                    self.i += 1
                    self.angles()
                    return
                self.qualified()
            if self.cpp and self.t == "{":
                self.initializer()
        elif t == "[" and self.cpp:
            self.skip_balanced()
            if self.t == "<":  # parameters of a generic lambda
                self.angles()
                if self.accept("requires"):
                    self.binary(4)
            if self.t == "(":
                self.parameters()
            while self.t in ("mutable", "noexcept", "constexpr"):
                self.i += 1
            if self.accept("->"):
                self.specifiers()
                self.declarator()
            self.block()
        else:
            raise self.fault("an expression")

    def postfix_of(self, rule) -> None:
        rule()
        self.postfix()

    def postfix(self) -> None:
        while True:
            t = self.t
            if t == "(":
                self.arguments()
            elif t == "[":
                self.i += 1
                self.expression()
                self.expect("]")
            elif t in (".", "->"):
                self.i += 1
                self.accept("template")
                self.accept("~")
                if self.t == "operator":
                    self.operator_name()
                else:
                    self.qualified()
            elif t in ("++", "--"):
                self.i += 1
            else:
                return


class CppParser(CParser):
    cpp = True


class EsqlParser(CParser):
    """C whose ``EXEC SQL`` statements run to their semicolon; strings inside keep SQL quotes."""


__all__ = ["CParser", "CppParser", "EsqlParser", "Fault"]
