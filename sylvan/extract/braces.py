"""Languages with braces: C, C++, C with embedded SQL, JavaScript, TypeScript, JSX, TSX, Go and Rust.

Comments and strings are blanked first, so that declarations are found by patterns at known nesting and
their ends by matching braces. Declarations are visited outermost first; each is placed in the
innermost container whose braces hold it.
"""

from __future__ import annotations

import re

from sylvan.extract.model import Lines, Result, Symbol, closing, mask

NO_CALL = frozenset("async if for while switch match return sizeof typeof new delete console print println len range Some None Ok Err catch else function do await yield defer go in of case super assert".split())
NO_NAME = frozenset("if for while switch return catch else do sizeof".split())
CONTAINERS = ("class", "struct", "interface", "trait", "namespace", "enum", "protocol")
P = lambda s: re.compile(s, re.M)

SCRIPT = [
    ("class", P(r"(?P<pre>(?:export\s+)?(?:default\s+)?(?:abstract\s+)?)\bclass\s+(?P<name>[\w$]+)(?P<head>[^{;]*)\{")),
    ("interface", P(r"(?P<pre>(?:export\s+)?(?:declare\s+)?)\binterface\s+(?P<name>[\w$]+)(?P<head>[^{;]*)\{")),
    ("enum", P(r"(?P<pre>(?:export\s+)?(?:const\s+)?)\benum\s+(?P<name>[\w$]+)\s*\{")),
    ("type_alias", P(r"(?P<pre>(?:export\s+)?)\btype\s+(?P<name>[\w$]+)\s*(?:<[^=;]*>)?\s*=")),
    ("function", P(r"(?P<pre>(?:export\s+)?(?:default\s+)?(?:async\s+)?)\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^({]*>)?\(")),
    ("function", P(r"(?P<pre>(?:export\s+)?)\b(?:const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]+)?=\s*(?:async\s+)?(?:function\b[^({]*\(|\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^=;{]+)?=>|[\w$]+\s*=>)")),
]
SCRIPT_METHOD = P(r"^[ \t]*(?P<pre>(?:(?:public|private|protected|static|async|override|readonly|abstract|get|set)\s+)*)\*?(?P<name>[#\w$]+)\s*(?:<[^({]*>)?\((?=[^;{}]*\)[^;{}]*\{)")
SCRIPT_VALUE = P(r"^(?P<pre>(?:export\s+)?)(?P<how>const|let|var)\s+(?P<name>[\w$]+)\s*(?::[^=;\n]+)?=(?!>)")
GO = [
    ("struct", P(r"(?P<pre>)^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\s*\{")),
    ("interface", P(r"(?P<pre>)^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\s*\{")),
    ("type_alias", P(r"(?P<pre>)^type\s+(?P<name>\w+)\s+=?\s*(?!struct\b|interface\b)[\w\[\]*.]+")),
    ("method", P(r"(?P<pre>)^func\s*\([^)]*\)\s*(?P<name>\w+)\s*\(")),
    ("function", P(r"(?P<pre>)^func\s+(?P<name>\w+)\s*(?:\[[^\]]*\])?\(")),
]
RUST = [
    ("struct", P(r"(?P<pre>(?:pub(?:\([^)]*\))?\s+)?)\bstruct\s+(?P<name>\w+)")),
    ("enum", P(r"(?P<pre>(?:pub(?:\([^)]*\))?\s+)?)\benum\s+(?P<name>\w+)")),
    ("trait", P(r"(?P<pre>(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?)\btrait\s+(?P<name>\w+)(?P<head>[^{;]*)")),
    ("namespace", P(r"(?P<pre>(?:unsafe\s+)?)^[ \t]*impl\b(?:\s*<[^{]*?>)?\s+(?P<head>[^{;]+?)\s*(?=\{)")),
    ("function", P(r"(?P<pre>(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?)\bfn\s+(?P<name>\w+)\s*(?:<[^({]*>)?\(")),
]
CPP = [
    ("namespace", P(r"(?P<pre>)\bnamespace\s+(?P<name>\w+)\s*\{")),
    ("class", P(r"(?P<pre>)(?<!enum )\bclass\s+(?P<name>\w+)(?P<head>[^{;()]*)\{")),
]
C = [
    ("struct", P(r"(?P<pre>(?:typedef\s+)?)\b(?:struct|union)\s*(?P<name>\w*)(?P<head>[^{;()=]*)\{")),
    ("enum", P(r"(?P<pre>(?:typedef\s+)?)\benum\s*(?:class\s+|struct\s+)?(?P<name>\w*)[^{;()]*\{")),
    ("function", P(r"^(?P<pre>[ \t]*(?:[A-Za-z_][\w:<>,]*[\s*&]+)*)(?P<name>(?:\w+::)*~?\w+|operator\s*[^\s(]+)[ \t]*\((?=[^;{}()]*(?:\([^;{}()]*\)[^;{}()]*)*\)[^;{}=]*\{)")),
    ("function", P(r"^(?P<pre>(?:[A-Za-z_]\w*[\s*]+)*)(?P<name>\w+)[ \t]*\((?=\s*(?:\w+\s*(?:,\s*\w+\s*)*)?\)\s*(?:(?:[A-Za-z_]\w*+[\s*]++)++[\w\s*,\[\]]*+;\s*+)++\{)")),  # parameters declared in the old style
    ("prototype", P(r"^(?P<pre>[ \t]*(?:[A-Za-z_][\w:<>,]*[\s*&]+)*)(?P<name>~?\w+)[ \t]*\((?=[^;{}()]*(?:\([^;{}()]*\)[^;{}()]*)*\)\s*(?:const|noexcept|override|final|=\s*\w+|\s)*;)")),
]
C_FIELD = P(r"(?<=[;{\n])[ \t]*(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(?:\(\s*\*\s*)?(?P<name>\w+)\s*(?:\)\s*\([^;]*\))?\s*(?:\[[^\]]*\]|:\s*\d+)?\s*(?:=[^;{}]*)?;")
NOT_TYPES = frozenset("return else case goto new delete throw typedef using".split())


def extract(path: str, text: str, language: str) -> Result:
    out = Result(path, language)
    code, lines = mask(text, language == "rust"), Lines(text)
    if language != "rust":
        file = out.file_symbol(lines.count)
        file.stop = len(text)
    else:
        file = None
    script = language in ("javascript", "typescript", "jsx", "tsx")
    c_family = language in ("c", "cpp", "esqlc")
    if c_family:
        directives(out, text, lines)
        if language == "esqlc":
            code = re.sub(r"^[ \t]*##", lambda m: " " * len(m.group()), code, flags=re.M)  # lines handed to the SQL preprocessor
        code = one_branch(code)
        code = re.sub(r"^[ \t]*#(?:[^\n]*\\\n)*[^\n]*", lambda m: re.sub(r"[^\n]", " ", m.group()), code, flags=re.M)
        code = re.sub(r"\bEXEC\s+SQL\b[^;]*;", lambda m: re.sub(r"[^\n]", " ", m.group()), code, flags=re.I)
    rules = SCRIPT if script else GO if language == "go" else RUST if language == "rust" else (CPP if language == "cpp" else []) + C
    found: list[tuple[int, int, str, re.Match]] = []
    for kind, pattern in rules:
        for m in pattern.finditer(code):
            at = m.start("pre") if m["pre"].strip() else m.start("name") if "name" in m.groupdict() and m["name"] and not script else m.start()
            at += len(code[at:]) - len(code[at:].lstrip()) if code[at : at + 1].isspace() else 0
            found.append((at, m.end(), kind, m))
    found.sort(key=lambda x: (x[0], x[1]))
    for at, end, kind, m in found:
        declare(out, text, code, lines, at, end, kind, m, language)
    if script:
        for m in SCRIPT_METHOD.finditer(code):
            holder = holder_of(out, m.start("name"))
            if holder is not None and holder.kind == "class" and m["name"] not in NO_NAME and depth_in(code, holder, m.start("name")) == 1:
                body = code.find("{", closing(code, m.end() - 1))
                add(out, "method", m["name"], text, lines, m.start("name"), closing(code, body), holder, code, exported=False, flags=m["pre"])
        made = {(s.name, s.start_line) for s in out.symbols if s.kind == "function"}
        for m in SCRIPT_VALUE.finditer(code):
            if holder_of(out, m.start("name")) is None and (m["name"], lines.at(m.start("name"))[0]) not in made:
                kind = "constant" if m["how"] == "const" else "variable"
                add(out, kind, m["name"], text, lines, m.start(), code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code), None, code, exported="export" in m["pre"])
        imports_script(out, text, code, lines)
        decorators(out, code, lines)
    elif language == "go":
        imports_go(out, text, lines)
        for m in re.finditer(r"^(const|var)\s+(\w+)", code, re.M):
            add(out, "constant" if m[1] == "const" else "variable", m[2], text, lines, m.start(), m.end(), None, code, exported=m[2][:1].isupper())
    elif language == "rust":
        for m in re.finditer(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", code, re.M):
            line = lines.at(m.start(1))[0]
            out.add("import", re.split(r"::|\{", m[1].strip())[0].strip(), line, line, signature=" ".join(m.group().split()))
        for m in re.finditer(r"^[ \t]*(?:pub\s+)?(const|static)\s+(?:mut\s+)?(\w+)\s*:", code, re.M):
            if holder_of(out, m.start(2)) is None:
                add(out, "constant", m[2], text, lines, m.start(), code.find(";", m.end()), None, code, exported="pub" in m.group())
    if c_family:
        fields_c(out, text, code, lines)
    place(out, file)
    calls(out, code, lines, language, file)
    if language == "cpp":
        overrides(out)
    return out


def one_branch(code: str) -> str:
    """The code with braces blanked in all branches of a conditional but the first, offsets unchanged: each
    branch may open the same block."""
    stack: list[bool] = []  # per open #if whether a later branch has begun
    out, at = [], 0
    for m in re.finditer(r"^[ \t]*#[ \t]*(if|ifdef|ifndef|elif|else|endif)\b[^\n]*", code, re.M):
        piece = code[at : m.start()]
        out += [re.sub(r"[{}]", " ", piece) if any(stack) else piece, m.group()]
        at = m.end()
        if m[1].startswith("if"):
            stack.append(False)
        elif m[1] == "endif":
            if stack:
                stack.pop()
        elif stack:
            stack[-1] = True
    return "".join([*out, code[at:]])


def depth_in(code: str, holder: Symbol, at: int) -> int:
    body = code.find("{", holder.offset)
    return code.count("{", body, at) - code.count("}", body, at)


def holder_of(out: Result, at: int, kinds: tuple[str, ...] | None = None) -> Symbol | None:
    return out.around(at, kinds)


def add(out, kind, name, text, lines, at, stop, holder, code, exported=False, flags="") -> Symbol:
    start, column = lines.at(at)
    stop = stop if stop and stop > 0 else len(text) - 1
    end, end_column = lines.at(max(at, min(stop, len(text) - 1)))
    signature = text[text.rfind("\n", 0, at) + 1 :].split("\n", 1)[0].strip()
    body = text[at : stop + 1]
    return out.add(kind, name, start, end, holder, start_column=column, end_column=end_column + 1, signature=signature or None, is_exported=exported,
                   is_async="async" in flags or "async" in body, is_static="static" in body, is_abstract="abstract" in flags, offset=at, stop=stop)


def declare(out, text, code, lines, at, end, kind, m, language) -> None:
    name = m["name"] if "name" in m.groupdict() else ""
    holder = holder_of(out, at, CONTAINERS)
    script = language in ("javascript", "typescript", "jsx", "tsx")
    exported = "export" in m["pre"] or m["pre"].strip().startswith("pub") or language == "go" and name[:1].isupper() or language in ("c", "cpp", "esqlc") and "static" not in m["pre"]
    if kind == "prototype":
        words = m["pre"].split()
        built = holder is not None and name.lstrip("~") == holder.name
        if not words and not built or words[:1] and words[0] in NOT_TYPES or name in NO_NAME or holder_of(out, at, ("function", "method")) is not None:
            return
        add(out, "method" if holder is not None else "function", name, text, lines, m.start("name"), code.find(";", end), holder, code, exported, m["pre"])
        return
    if kind in ("type_alias",):
        if holder_of(out, at) is None:
            add(out, kind, name, text, lines, at, code.find(";", end) if ";" in code[end:] else end, holder, code, exported)
        return
    if kind == "namespace" and language == "rust":
        head = re.sub(r"\bwhere\b.*", "", m["head"], flags=re.S)
        trait, _, target = head.rpartition(" for ")
        name = re.sub(r"<.*", "", target.strip()).split("::")[-1]
        body = code.find("{", end - 1 if code[end - 1] == "{" else end)
        s = add(out, "namespace", name, text, lines, at, closing(code, body), None, code)
        if trait.strip():
            same = next((x for x in out.symbols if x.name == name and x.kind in ("struct", "enum")), None)
            out.link(same.id if same else name, re.sub(r"<.*", "", trait.strip()).split("::")[-1], "implements", s.start_line, s.start_column, metadata={"implNode": s.id})
        return
    if kind == "function":
        if name.split("::")[-1] in NO_NAME or language in ("c", "cpp", "esqlc") and (m["pre"].split()[:1] or [""])[0] in NOT_TYPES:
            return
        around = holder_of(out, at, ("function", "method"))
        if language in ("c", "cpp", "esqlc") and around is not None:
            return
        paren = code.rfind("(", m.start(), end) if script else end - 1
        after = closing(code, paren) if paren >= 0 and code[paren] == "(" else end
        body, semi = code.find("{", after), code.find(";", after)
        if language in ("c", "esqlc") and 0 <= semi < body and re.fullmatch(r"\)\s*+(?:(?:[A-Za-z_]\w*+[\s*]++)++[\w\s*,\[\]]*+;\s*+)++", code[after:body]):
            semi = -1  # declarations of parameters in the old style
        arrow = script and "=" in m.group()
        if arrow:
            body = code.find("{", end) if code[end : end + 80].lstrip().startswith("{") or m.group().rstrip().endswith("(") else -1
            stop = closing(code, body) if body >= 0 else code.find("\n", end) if "\n" in code[end:] else len(code) - 1
        elif body < 0 or 0 <= semi < body:
            stop = semi if semi >= 0 else end
        else:
            stop = closing(code, body)
        if "::" in name:
            name = name.split("::")[-1]
            kind = "method"
        elif holder is not None and language != "go":
            kind = "method"
        add(out, kind, name, text, lines, m.start("name") if language in ("c", "cpp", "esqlc") else at, stop, holder, code, exported, m["pre"] if not arrow else m.group())
        return
    if kind == "method":
        body = code.find("{", closing(code, end - 1))
        add(out, kind, name, text, lines, at, closing(code, body) if body >= 0 else end, holder, code, exported)
        return
    body = code.find("{", end - 1) if code[end - 1 : end] == "{" else code.find("{", end)
    semi = code.find(";", end)
    if language == "rust" and kind == "struct" and (body < 0 or 0 <= semi < body):
        stop = semi
    else:
        stop = closing(code, body) if body >= 0 else end
    if language in ("c", "cpp", "esqlc") and (not name or "typedef" in m["pre"]):
        alias = re.match(r"\s*\*?\s*(\w+)\s*[;,]", code[stop + 1 : stop + 200])
        name = alias[1] if alias and ("typedef" in m["pre"] or not name) else name
        if not name:
            return
    s = add(out, kind, name, text, lines, at, stop, holder, code, exported, m["pre"])
    head = m["head"] if "head" in m.groupdict() and m["head"] else ""
    if script:
        for verb, edge in (("extends", "extends"), ("implements", "implements")):
            part = re.search(rf"\b{verb}\s+(.*?)(?=\bimplements\b|\bextends\b|$)", head, re.S)
            if part:
                for base in re.split(r",(?![^<]*>)", part[1]):
                    base = re.sub(r"<.*", "", base).strip().split(".")[-1].split("(")[0]
                    if base:
                        out.link(s, base, edge, s.start_line, s.start_column)
    elif language in ("cpp",) and ":" in head:
        for base in head.split(":", 1)[1].split(","):
            base = re.sub(r"<.*", "", re.sub(r"\b(public|private|protected|virtual)\b", "", base)).strip().split("::")[-1]
            if base:
                out.link(s, base, "extends", s.start_line, s.start_column)
    elif language == "rust" and kind == "trait" and ":" in head:
        for base in re.sub(r"\bwhere\b.*", "", head.split(":", 1)[1], flags=re.S).split("+"):
            base = re.sub(r"<.*", "", base).strip().split("::")[-1]
            if base and base[0] != "'":
                out.link(s, base, "extends", s.start_line, s.start_column)
    if language == "rust" and kind in ("struct", "trait", "enum"):
        rust_attributes(text, s)
    if kind == "enum" and language != "rust" and body >= 0:
        depth = 0
        for part in re.finditer(r"[{}()\[\]]|[A-Za-z_]\w*|,", code[body + 1 : stop]):
            t = part.group()
            depth += (t in "{([") - (t in "})]")
            if depth == 0 and re.match(r"\w", t) and (part.start() == 0 or re.search(r"(^|,)\s*$", code[body + 1 : body + 1 + part.start()])):
                line, col = lines.at(body + 1 + part.start())
                out.add("enum_member", t, line, line, s, start_column=col, offset=body + 1 + part.start())


def rust_attributes(text: str, s: Symbol) -> None:
    marks, rows = [], text[: s.offset].split("\n")
    for row in reversed(rows[:-1]):
        m = re.match(r"\s*#\[(.*)\]\s*$", row)
        if not m:
            break
        marks.insert(0, m[1])
    s.decorators = marks or None


def directives(out: Result, text: str, lines: Lines) -> None:
    for m in re.finditer(r"^[ \t]*#[ \t]*(include|define)[ \t]+([<\"]([^>\"]+)[>\"]|(\w+))[^\n]*", text, re.M):
        line = lines.at(m.start(1))[0]
        if m[1] == "include" and m[3]:
            out.add("import", m[3], line, line, signature=m.group().strip())
        elif m[1] == "define" and m[4]:
            out.add("constant", m[4], line, line, signature=m.group().strip())


def fields_c(out: Result, text: str, code: str, lines: Lines) -> None:
    made = {(s.name, s.start_line) for s in out.symbols}
    for holder in [s for s in out.symbols if s.kind in ("struct", "class") and s.stop]:
        body = code.find("{", holder.offset)
        depth, seen = 0, body  # braces are counted on from field to field
        for m in C_FIELD.finditer(code, body + 1, holder.stop):
            depth += code.count("{", seen, m.start("name")) - code.count("}", seen, m.start("name"))
            seen = m.start("name")
            if depth == 1 and m.group().split()[0] not in NOT_TYPES and "(" not in m.group().split(m["name"])[0].replace("(*", ""):
                line, col = lines.at(m.start("name"))
                if (m["name"], line) not in made:
                    made.add((m["name"], line))
                    out.add("field", m["name"], line, line, holder, start_column=col, signature=" ".join(m.group().split()), offset=m.start("name"))


def imports_script(out: Result, text: str, code: str, lines: Lines) -> None:
    for m in re.finditer(r"^[ \t]*import\b(?:[^'\"();]*?from)?\s*(['\"])", code, re.M):
        start = m.start(1)
        end = text.find(text[start], start + 1)
        line = lines.at(m.end())[0]
        out.add("import", text[start + 1 : end], line, line, signature=" ".join(text[m.start() : end + 1].split()))


def imports_go(out: Result, text: str, lines: Lines) -> None:
    for m in re.finditer(r"^import\s*(\((?P<block>[^)]*)\)|(?P<one>[^\n]+))", text, re.M):
        base = m.start("block") if m["block"] is not None else m.start("one")
        for spec in re.finditer(r"[^\n]+", m["block"] if m["block"] is not None else m["one"]):
            path = re.search(r"[\"`]([^\"`]+)[\"`]", spec.group())
            if path:
                line = lines.at(base + spec.start())[0]
                out.add("import", path[1], line, line, signature=spec.group().strip())


def decorators(out: Result, code: str, lines: Lines) -> None:
    """Decorators directly above a class or member belong to it."""
    rows = code.split("\n")
    for s in list(out.symbols):
        if s.kind not in ("class", "method", "function"):
            continue
        i = s.start_line - 2
        while i >= 0:
            m = re.match(r"\s*@([\w$.]+)", rows[i])
            if not m:
                break
            out.link(s, m[1].split(".")[-1], "decorates", i + 1, rows[i].find("@"))
            i -= 1


def place(out: Result, file: Symbol | None) -> None:
    """contains edges: container to member, file to whatever nothing else holds."""
    for s in out.symbols:
        if s.kind in ("file", "import"):
            continue
        holder = holder_of(out, s.offset, CONTAINERS) if s.offset else None
        if holder is not None and holder is not s:
            out.link(holder, s.id, "contains", s.start_line, s.start_column)
        elif file is not None:
            out.link(file, s.id, "contains", s.start_line, s.start_column)
    if file is not None:
        for s in out.symbols:
            if s.kind == "import":
                out.link(file, s.name, "imports", s.start_line, s.start_column)


CALL = re.compile(r"(?<![\w$.#@])(?P<new>new\s+)?(?P<name>[A-Za-z_$][\w$]*(?:(?:\.|->|::|\?\.)[A-Za-z_$][\w$]*)*)(?P<bang>!)?\s*\(")


def calls(out: Result, code: str, lines: Lines, language: str, file: Symbol | None) -> None:
    functions = sorted((s for s in out.symbols if s.kind in ("function", "method") and s.stop), key=lambda s: (s.offset, -s.stop))
    around: list[Symbol] = []  # functions open at the current offset, outermost first; sites come in order
    following = 0
    heads = {(s.name.lstrip("~"), s.start_line) for s in functions}
    for m in CALL.finditer(code):
        name = re.split(r"\.|->|::|\?\.", m["name"])[-1]
        if m["bang"] and language == "rust":
            name += "!"
        line, col = lines.at(m.start("name"))
        if name in NO_CALL or (name, line) in heads:
            continue
        while following < len(functions) and functions[following].offset < m.start():
            around.append(functions[following])
            following += 1
        while around and around[-1].stop < m.start():
            around.pop()
        owner = next((s for s in reversed(around) if s.stop >= m.start()), None)
        if owner is None:
            continue
        out.link(owner, name, "calls", line, col)
        if m["new"]:
            out.link(owner, name, "instantiates", line, col)
    if language in ("c", "cpp", "esqlc"):
        for m in re.finditer(r"=\s*\{([^{}]*)\}", code):
            if holder_of(out, m.start(), ("function", "method", "enum")) is None and file is not None:
                for x in re.finditer(r"\b[A-Za-z_]\w*\b", m[1]):
                    line, col = lines.at(m.start(1) + x.start())
                    out.link(file, x.group(), "references", line, col)


def overrides(out: Result) -> None:
    """base method -> overriding method of classes of one file."""
    by_name = {s.name: s for s in out.symbols if s.kind in ("class", "struct")}
    by_id = {s.id: s for s in out.symbols}
    members: dict[str, dict[str, Symbol]] = {}
    for e in out.links:
        if e.kind == "contains" and e.target in by_id and by_id[e.target].kind == "method":
            members.setdefault(e.source, {})[by_id[e.target].name] = by_id[e.target]
    for e in [e for e in out.links if e.kind == "extends"]:
        base = by_name.get(e.target)
        if base is None:
            continue
        for name, method in members.get(e.source, {}).items():
            old = members.get(base.id, {}).get(name)
            if old is not None:
                out.link(old, method.id, "calls", method.start_line, method.start_column, provenance="tree-sitter+cpp-override",
                         metadata={"synthesizedBy": "cpp-override", "via": name})
