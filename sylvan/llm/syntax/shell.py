"""POSIX shell with the usual extensions of bash."""

from __future__ import annotations

import re

from sylvan.llm.syntax.base import Fault, FunctionNode, Parser

WORD_END = frozenset(" \t\r\n;&|<>()")
OPERATORS = re.compile(r"&>>|&>|<<<|<<-|<<|>>|>\||<>|<&|>&|;;&|;;|;&|&&|\|\||\|&|[;&|<>()]")
RESERVED = frozenset("if then elif else fi for while until do done case esac select function in { } ! [[ time".split())
CLOSING = frozenset("then elif else fi do done esac }".split())


class ShellParser(Parser):
    """Words are tokens of kind ``word`` (``id`` when nothing in them is quoted or expanded)."""

    def tokenize(self, text: str) -> None:
        text = text.replace("\r\n", "\n")
        pos, n, line = 0, len(text), 1
        pending: list[tuple[str, bool]] = []
        while pos < n:
            c = text[pos]
            if c in " \t\r":
                pos += 1
            elif text.startswith("\\\n", pos):
                pos += 2
                line += 1
            elif c == "#":
                end = text.find("\n", pos)
                end = n if end < 0 else end
                self.comments.append((line, text[pos:end]))
                pos = end
            elif c == "\n":
                self.push("nl", "\n", line)
                pos += 1
                line += 1
                for mark, tabs in pending:  # bodies of here-documents
                    while pos < n:
                        end = text.find("\n", pos)
                        end = n if end < 0 else end
                        row = text[pos:end]
                        pos = min(end + 1, n)
                        line += 1
                        if (row.lstrip("\t") if tabs else row) == mark:
                            break
                pending = []
            elif text.startswith("((", pos) and (not self.tok or self.tok[-1] in ("\n", ";", "&&", "||", "for", "if", "while", "until", "do", "then")):
                end = self.nested(text, pos + 2, "))")
                if end < 0:
                    self.push("op", "(", line)
                    pos += 1
                else:
                    self.push("word", "((", line)
                    line += text.count("\n", pos, end)
                    pos = end
            else:
                m = OPERATORS.match(text, pos)
                if m and not (m.group() in ("<", ">") and text.startswith("(", pos + 1)):
                    op = m.group()
                    if op in ("<<", "<<-"):
                        m2 = re.compile(r"[ \t]*(['\"]?)([\w.+-]+)\1").match(text, m.end())
                        if m2:
                            pending.append((m2.group(2), op == "<<-"))
                    self.push("op", op, line)
                    pos = m.end()
                else:
                    end, plain, why = self.word(text, pos)
                    if why:
                        self.push("bad", why, line)
                    else:
                        self.push("id" if plain else "word", text[pos:end], line)
                    line += text.count("\n", pos, end)
                    pos = max(end, pos + 1)
        self.push("nl", "\n", line)
        self.push("eof", "", line)

    def word(self, text: str, pos: int) -> tuple[int, bool, str]:
        """End of a word, whether it is plain, and what is wrong with it."""
        n, plain = len(text), True
        start = pos
        while pos < n:
            c = text[pos]
            if c in "<>" and text.startswith("(", pos + 1) and pos == start:
                end = self.nested(text, pos + 2, ")")
                if end < 0:
                    return n, False, "unterminated substitution"
                pos, plain = end, False
            elif c == "(" and pos > start and text[pos - 1] == "=":  # an array
                end = self.nested(text, pos + 1, ")")
                if end < 0:
                    return n, False, "unterminated array"
                pos, plain = end, False
            elif c == "(" and pos > start and text[pos - 1] in "?*+@!":  # an extended pattern
                end = self.nested(text, pos + 1, ")")
                if end < 0:
                    return n, False, "unterminated pattern"
                pos, plain = end, False
            elif c in WORD_END:
                break
            elif c == "\\":
                pos, plain = pos + 2, False
            elif c == "'":
                end = text.find("'", pos + 1)
                if end < 0:
                    return n, False, "unterminated string"
                pos, plain = end + 1, False
            elif c in '"`':
                end = self.quoted(text, pos + 1, c)
                if end < 0:
                    return n, False, "unterminated string"
                pos, plain = end, False
            elif c == "$":
                plain = False
                if text.startswith("$((", pos):
                    end = self.nested(text, pos + 3, "))")
                    if end < 0:
                        end = self.nested(text, pos + 2, ")")
                elif text.startswith("$(", pos):
                    end = self.nested(text, pos + 2, ")")
                elif text.startswith("${", pos):
                    end = self.nested(text, pos + 2, "}")
                elif text.startswith("$'", pos):
                    m = re.compile(r"\$'(?:\\.|[^'\\])*'", re.S).match(text, pos)
                    end = m.end() if m else -1
                else:
                    end = pos + 1
                if end < 0:
                    return n, False, "unterminated expansion"
                pos = end
            else:
                pos += 1
        return min(pos, n), plain, ""

    def quoted(self, text: str, pos: int, quote: str) -> int:
        while pos < len(text):
            c = text[pos]
            if c == "\\":
                pos += 2
            elif c == quote:
                return pos + 1
            elif quote == '"' and (text.startswith("$(", pos) or text.startswith("${", pos)):
                pos = self.nested(text, pos + 2, ")" if text[pos + 1] == "(" else "}")
                if pos < 0:
                    return -1
            else:
                pos += 1
        return -1

    def nested(self, text: str, pos: int, end: str) -> int:
        """Position after the matching ``end``, over quotes and inner brackets; -1 if it is missing."""
        pairs = {")": "(", "))": "(", "}": "{"}
        opener, depth, n = pairs[end], 0, len(text)
        while pos < n:
            c = text[pos]
            if depth == 0 and text.startswith(end, pos):
                return pos + len(end)
            if c == "\\":
                pos += 2
                continue
            if c == "'" and end != "))":
                close = text.find("'", pos + 1)
                if close < 0:
                    return -1
                pos = close + 1
                continue
            if c in '"`':
                pos = self.quoted(text, pos + 1, c)
                if pos < 0:
                    return -1
                continue
            depth += (c == opener) - (c == end[0])
            pos += 1
        return -1

    def recover(self, at: int) -> None:
        """To the next line."""
        if self.i == at and self.k != "eof":
            self.i += 1
        while self.k not in ("nl", "eof"):
            self.i += 1
        if self.k == "nl":
            self.i += 1

    def lines(self) -> None:
        while self.k == "nl" or self.t == ";" and False:
            self.i += 1

    def program(self) -> None:
        self.lines()
        while self.k != "eof":
            self.guarded(self.line_list)
            self.lines()

    def line_list(self) -> None:
        self.and_or()
        while self.t in (";", "&"):
            self.i += 1
            if self.k in ("nl", "eof"):
                break
            self.and_or()
        if self.k not in ("nl", "eof"):
            raise self.fault("the end of the line")

    def list_until(self, *stops: str) -> None:
        self.lines()
        if self.t in stops and self.k == "id":
            raise self.fault("a command")
        while not (self.t in stops and self.k in ("id", "op")):
            if self.k == "eof":
                raise self.fault(f"'{stops[0]}'")
            self.and_or()
            if self.t in (";", "&"):
                self.i += 1
            elif self.k != "nl" and not (self.t in stops and self.k == "op"):
                raise self.fault("the end of the command")
            self.lines()

    def and_or(self) -> None:
        self.pipeline()
        while self.t in ("&&", "||"):
            self.i += 1
            self.lines()
            self.pipeline()

    def pipeline(self) -> None:
        while self.k == "id" and self.t in ("!", "time"):
            self.i += 1
        self.command()
        while self.t in ("|", "|&"):
            self.i += 1
            self.lines()
            self.command()

    def command(self) -> None:
        t, k = self.t, self.k
        if k == "id" and t in RESERVED:
            if t in CLOSING:
                raise self.fault("a command")
            if t == "if":
                self.i += 1
                self.list_until("then")
                self.i += 1
                self.list_until("fi", "else", "elif")
                while self.t == "elif":
                    self.i += 1
                    self.list_until("then")
                    self.i += 1
                    self.list_until("fi", "else", "elif")
                if self.accept("else"):
                    self.list_until("fi")
                self.expect("fi")
            elif t in ("while", "until"):
                self.i += 1
                self.list_until("do")
                self.do_group()
            elif t in ("for", "select"):
                self.i += 1
                if self.t == "((":
                    self.i += 1
                else:
                    if self.k != "id":
                        raise self.fault("a name")
                    self.i += 1
                    self.lines()
                    if self.accept("in"):
                        while self.k in ("id", "word"):
                            self.i += 1
                self.accept(";")
                self.lines()
                self.do_group()
            elif t == "case":
                self.i += 1
                self.take_word()
                self.lines()
                self.expect("in")
                self.lines()
                while self.t != "esac":
                    self.accept("(")
                    self.take_word()
                    while self.accept("|"):
                        self.take_word()
                    self.expect(")")
                    self.lines()
                    while self.t not in (";;", ";&", ";;&") and not (self.t == "esac" and self.k == "id"):
                        self.and_or()
                        if self.t in (";", "&"):
                            self.i += 1
                        elif self.k != "nl" and self.t not in (";;", ";&", ";;&"):
                            raise self.fault("';;'")
                        self.lines()
                        if self.k == "eof":
                            raise self.fault("'esac'")
                    if self.t != "esac":
                        self.i += 1
                    self.lines()
                self.i += 1
            elif t == "{":
                self.i += 1
                self.list_until("}")
                self.expect("}")
            elif t == "[[":
                self.i += 1
                while self.t != "]]":
                    if self.k == "eof" or self.k == "bad":
                        raise self.fault("']]'")
                    self.i += 1
                self.i += 1
            elif t == "function":
                self.i += 1
                self.take_word()
                opening = self.i
                if self.accept("("):
                    self.expect(")")
                closing = self.i - 1
                self.lines()
                body = self.i
                self.command()
                self.functions.append(FunctionNode(opening - 2, opening - 1, opening, closing, body, self.i - 1))
                return
            else:
                raise self.fault("a command")
            return self.redirections()
        if t == "((" and k == "word":
            self.i += 1
            return self.redirections()
        if t == "(":
            self.i += 1
            self.list_until(")")
            self.expect(")")
            return self.redirections()
        if k == "id" and self.peek() == "(" :
            first = self.i
            self.i += 1
            self.expect("(")
            self.expect(")")
            self.lines()
            if not (self.t in ("{", "(", "((") or self.k == "id" and self.t in RESERVED):
                raise self.fault("a body")
            body = self.i
            self.command()
            self.functions.append(FunctionNode(first, first, first + 1, first + 2, body, self.i - 1))
            return None
        had = False
        while True:
            if self.k in ("id", "word"):
                self.i += 1
                had = True
            elif self.redirection():
                had = True
            else:
                break
        if not had:
            raise self.fault("a command")
        return None

    def do_group(self) -> None:
        self.expect("do")
        self.list_until("done")
        self.expect("done")
        self.redirections()

    def take_word(self) -> None:
        if self.k not in ("id", "word"):
            raise self.fault("a word")
        self.i += 1

    def redirection(self) -> bool:
        if self.k == "op" and self.t in ("<", ">", ">>", "<<", "<<-", "<<<", ">|", "<>", "<&", ">&", "&>", "&>>"):
            self.i += 1
            self.take_word()
            return True
        return False

    def redirections(self) -> None:
        while self.redirection() or self.k == "id" and self.t.isdigit() and self.peek() in ("<", ">", ">>", ">&"):
            if self.k == "id" and self.t.isdigit():
                self.i += 1


__all__ = ["Fault", "ShellParser"]
