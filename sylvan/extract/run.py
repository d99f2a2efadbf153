"""Extraction as a Spark stage: contents in, symbols, relations and unresolved references out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.extract.model import Lines, Result
from sylvan.tables import NODES

# -- fixed values: words of embedded SQL that name no table ----------------------------------------------
SQL_NOISE = frozenset(
    "select where set values null not and or in is as on all distinct order group by having union exists case when then else end count sum max min avg upper lower trim length substr substring like "
    "between to for with session current user table view index unique primary key foreign references default check constraint smallint integer int float char".split()
)
SQL_TABLE = re.compile(r"\b(?:from|into|update|join|table|append\s+to|delete\s+from)\s+([A-Za-z_][\w.$]*)", re.I)


def extract_file(path: str, language: str, text: str) -> Result:
    """Symbols and relations of one file; an unknown language gives none."""
    from sylvan.extract import braces, callbacks, python, shell

    if language == "python":
        out = python.extract(path, text)
    elif language == "shell":
        out = shell.extract(path, text)
    elif language in ("c", "cpp", "esqlc", "javascript", "typescript", "jsx", "tsx", "go", "rust"):
        out = braces.extract(path, text, language)
    else:
        return Result(path, language)
    if language == "esqlc":
        sql_references(out, text)
    callbacks.synthesize(out, text, language)
    resolve_local(out)
    return out


def sql_references(out: Result, text: str) -> None:
    """Tables named in embedded SQL, once per line."""
    file, lines = out.symbols[0], Lines(text)
    seen = set()
    for block in re.finditer(r"\bEXEC\s+SQL\b([^;]*);|^[ \t]*##([^\n]*)", text, re.I | re.M):
        body = block[1] if block[1] is not None else block[2]
        base = block.start(1) if block[1] is not None else block.start(2)
        for m in SQL_TABLE.finditer(body):
            line = lines.at(base + m.start(1))[0]
            if m[1].lower() in SQL_NOISE or (line, m[1].lower()) in seen:
                continue
            seen.add((line, m[1].lower()))
            owner = out.innermost(line) or file
            out.link(owner, m[1], "references", line, 0, provenance="esqlc-overlay")


def resolve_local(out: Result) -> None:
    """Targets that name one symbol of the file, by qualified name or by a name no other one has, become ids."""
    ids = {s.id for s in out.symbols}
    qualified = {s.qualified_name: s.id for s in out.symbols}
    named: dict[str, list[str]] = {}
    for s in out.symbols:
        if s.kind != "import":
            named.setdefault(s.name, []).append(s.id)
    for e in out.links:
        if e.target in ids:
            continue
        hit = qualified.get(e.target) or (named[e.target][0] if len(named.get(e.target, ())) == 1 else None)
        if hit and hit != e.source:
            e.target = hit
            if e.kind in ("calls", "references") and e.provenance in ("tree-sitter", "regex"):
                e.provenance = {"tree-sitter": "tree-sitter+resolved-local", "regex": "regex+resolved-local"}[e.provenance]


_LINK = "source string, target string, kind string, metadata map<string,string>, line int, col int, provenance string"
OUT = f"file_path string, node struct<{NODES.replace(' STRING', ':STRING').replace(' INT', ':INT').replace(' BOOLEAN', ':BOOLEAN').replace(' ARRAY', ':ARRAY').replace(' BIGINT', ':BIGINT')}>, link struct<{_LINK.replace(' ', ':').replace(',:', ', ')}>"


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        path, node, link = [], [], []
        for p, language, text in zip(pdf["path"], pdf["language"], pdf["content"]):
            result = extract_file(p, language, text or "")
            last = {s.id: s for s in result.symbols}  # two symbols with one id: the last one counts
            for s in last.values():
                path.append(p)
                node.append(
                    {"id": s.id, "kind": s.kind, "name": s.name, "qualified_name": s.qualified_name, "file_path": p, "language": language, "start_line": s.start_line, "end_line": s.end_line,
                     "start_column": s.start_column, "end_column": s.end_column, "docstring": None, "signature": s.signature, "visibility": "public" if s.is_exported else "private",
                     "is_exported": s.is_exported, "is_async": s.is_async, "is_static": s.is_static, "is_abstract": s.is_abstract, "decorators": s.decorators, "type_parameters": None, "updated_at": 0}
                )
                link.append(None)
            for e in result.links:
                path.append(p)
                node.append(None)
                link.append({"source": e.source, "target": e.target, "kind": e.kind, "metadata": e.metadata, "line": e.line, "col": e.col, "provenance": e.provenance})
        yield pd.DataFrame({"file_path": path, "node": node, "link": link})


def extract_rows(sources: DataFrame) -> DataFrame:
    """One pass over (path, language, content); rows carry either a node or a link. Split with ``nodes_of``
    and ``links_of`` after staging the result, so that texts are parsed once."""
    return sources.select("path", "language", "content").filter(F.col("path").isNotNull()).mapInPandas(_rows, OUT)


def nodes_of(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("node").isNotNull()).select("node.*")


def links_of(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("link").isNotNull()).select("file_path", "link.*")


def unresolved_of(rows: DataFrame) -> DataFrame:
    """References by name: links whose target is no node of their file, builtins and noise left out."""
    from sylvan.operators.resolve import flag_builtins, trackable

    ids = nodes_of(rows).select(F.col("id").alias("n_id"), F.col("file_path").alias("n_path"), "language")
    links = links_of(rows).filter(~F.col("kind").isin("contains"))
    open_ = links.join(ids.select("n_id", "n_path"), (F.col("target") == F.col("n_id")) & (F.col("file_path") == F.col("n_path")), "left_anti")
    refs = open_.join(ids, (F.col("source") == F.col("n_id")) & (F.col("file_path") == F.col("n_path"))).select(
        F.col("source").alias("from_node_id"), F.col("target").alias("reference_name"), F.col("kind").alias("reference_kind"), "line", "col", "file_path", "language"
    )
    flagged = flag_builtins(refs.distinct())
    return flagged.filter(trackable(flagged)).drop("is_builtin")
