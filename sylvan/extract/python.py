"""Python, by its own syntax tree; by lines where the text does not parse."""

from __future__ import annotations

import ast
import re

from sylvan.extract.model import Result

NO_CALL = frozenset("if for while with return yield print len range str int float list dict set tuple super".split())


def _call_name(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return node.attr
    return None


def extract(path: str, text: str) -> Result:
    out = Result(path, "python")
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return by_lines(out, text)
    rows = text.split("\n")

    def signature(n: ast.AST) -> str:
        return rows[n.lineno - 1].strip()

    def visit(node: ast.AST, container, function) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                s = out.add("class", child.name, child.lineno, child.end_lineno or child.lineno, start_column=child.col_offset, end_column=child.end_col_offset or 0,
                            signature=signature(child), is_exported=not child.name.startswith("_"))
                for base in child.bases:
                    name = _call_name(base)
                    if name:
                        out.link(s, name, "extends", child.lineno, child.col_offset)
                visit(child, s, function)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                kind = "method" if container is not None else "function"
                s = out.add(kind, child.name, child.lineno, child.end_lineno or child.lineno, start_column=child.col_offset, end_column=child.end_col_offset or 0,
                            signature=signature(child), is_exported=not child.name.startswith("_"), is_async=isinstance(child, ast.AsyncFunctionDef))
                if container is not None:
                    out.link(container, s.id, "contains", child.lineno, child.col_offset)
                visit(child, None, s)
            else:
                if isinstance(child, ast.Import):
                    for a in child.names:
                        out.add("import", a.name, child.lineno, child.end_lineno or child.lineno, signature=signature(child))
                elif isinstance(child, ast.ImportFrom):
                    name = "." * child.level + (child.module or "")
                    out.add("import", name, child.lineno, child.end_lineno or child.lineno, signature=signature(child))
                elif isinstance(child, ast.Call) and function is not None:
                    name = _call_name(child.func)
                    if name and name not in NO_CALL:
                        out.link(function, name, "calls", child.lineno, child.col_offset)
                visit(child, container, function)

    visit(tree, None, None)
    return out


def by_lines(out: Result, text: str) -> Result:
    """Definitions, imports and calls found line by line; a block ends before the next line indented no deeper."""
    rows = text.split("\n")
    open_: list[tuple[int, object]] = []
    for i, row in enumerate(rows, 1):
        body = row.strip()
        if not body or body.startswith("#"):
            continue
        indent = len(row) - len(row.lstrip())
        while open_ and open_[-1][0] >= indent:
            open_.pop()
        m = re.match(r"(async\s+)?(def|class)\s+(\w+)", body)
        if m:
            end = i
            for j in range(i, len(rows)):
                nxt = rows[j]
                if nxt.strip() and len(nxt) - len(nxt.lstrip()) <= indent:
                    break
                if nxt.strip():
                    end = j + 1
            holder = next((s for _, s in reversed(open_) if s.kind == "class"), None)
            kind = "class" if m[2] == "class" else "method" if holder is not None else "function"
            s = out.add(kind, m[3], i, max(i, end), start_column=indent, signature=body, is_exported=not m[3].startswith("_"), is_async=bool(m[1]))
            if kind == "method":
                out.link(holder, s.id, "contains", i, indent, provenance="regex")
            open_.append((indent, s))
            continue
        m = re.match(r"(?:from\s+(\S+)\s+import|import\s+([\w.]+))", body)
        if m:
            out.add("import", m[1] or m[2], i, i, signature=body)
            continue
        holder = next((s for _, s in reversed(open_) if s.kind != "class"), None)
        if holder is not None:
            for c in re.finditer(r"([A-Za-z_][\w.]*)\s*\(", row):
                name = c[1].split(".")[-1]
                if name not in NO_CALL:
                    out.link(holder, name, "calls", i, c.start(), provenance="regex")
    return out
