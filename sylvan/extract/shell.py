"""Shell: functions of both forms, sourced files, commands inside functions."""

from __future__ import annotations

import re

from sylvan.extract.model import Lines, Result, closing

NO_CALL = frozenset("if then else elif fi for while until do done case esac in function select time cd echo export local readonly shift test true false printf read return source set unset trap exit break continue eval exec [ [[ . : wait type".split())


def extract(path: str, text: str) -> Result:
    out, lines = Result(path, "shell"), Lines(text)
    file = out.file_symbol(lines.count)
    code = re.sub(r"(^|\s)#[^\n]*", lambda m: m[1] + " " * (len(m.group()) - len(m[1])), text)
    code = re.sub(r"\"(?:\\.|[^\"\\])*\"|'[^']*'", lambda m: re.sub(r"[^\n]", "_", m.group()), code)
    for m in re.finditer(r"^[ \t]*(?:function\s+([\w.-]+)\s*(?:\(\s*\))?|([\w.-]+)\s*\(\s*\))\s*\{", code, re.M):
        name = m[1] or m[2]
        at = m.start(1) if m[1] else m.start(2)
        stop = closing(code, m.end() - 1)
        line = lines.at(at)[0]
        s = out.add("function", name, line, lines.at(stop)[0], signature=text[m.start() : m.end()].strip().rstrip("{").strip(), offset=m.end(), stop=stop)
        out.link(file, s.id, "contains", line, 0)
        for c in re.finditer(r"(?:^|[;|&(]|\bthen\b|\bdo\b|\belse\b|\{)[ \t]*([A-Za-z_][\w.-]*)(?=[ \t;\n|&)]|$)(?!\s*=)", code[m.end() : stop], re.M):
            word = c[1]
            if word not in NO_CALL:
                line, col = lines.at(m.end() + c.start(1))
                out.link(s, word, "calls", line, col)
    for m in re.finditer(r"^[ \t]*(?:source|\.)[ \t]+(\S+)", text, re.M):
        line = lines.at(m.start(1))[0]
        name = m[1].strip("\"'")
        out.add("import", name, line, line, signature=m.group().strip())
        out.link(file, name, "imports", line, 0)
    return out
