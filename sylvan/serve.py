"""Answers of an ``Engine`` over JSON-RPC: tools for assistants and requests of editors, one loop on a pair of streams.

Thin on purpose: every answer is an ``Engine`` call whose rows are bounded by a limit before they are collected.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import BinaryIO
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sylvan.functions.kinds import EDITOR_KIND
from sylvan.functions.terms import human_bytes

FRAME = 1 << 20  # bytes of a message at most
TEXT, TASK, PATH, KIND, WHOLE = 10_000, 50_000, 4_096, 128, (1 << 32) - 1
PARSE_ERROR, BAD_REQUEST, NO_METHOD, BAD_PARAMS = -32700, -32600, -32601, -32602


class Refused(Exception):
    """A request that cannot be answered as it stands."""

    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def text_of(args: dict, name: str, limit: int = TEXT, needed: bool = True) -> str | None:
    value = args.get(name)
    if value is None and not needed:
        return None
    if not isinstance(value, str) or needed and not value.strip() or len(value) > limit:
        raise Refused(BAD_PARAMS, f"{name}: text of 1 to {limit} characters wanted")
    return value


def number_of(args: dict, name: str, default: int) -> int:
    value = args.get(name, default)
    if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= WHOLE:
        raise Refused(BAD_PARAMS, f"{name}: whole number of 0 to {WHOLE} wanted")
    return value


def listed(rows: DataFrame, limit: int, none: str) -> str:
    """One line a symbol; the limit applies before anything comes to the driver."""
    found = rows.limit(limit).collect()
    return "\n".join(f"{r['name']} ({r['kind']}) {r['file_path']}:{r['start_line']}" for r in found) or none


def node_text(engine, args: dict) -> str:
    found = engine.nodes.filter(F.col("id") == engine.bind(text_of(args, "symbol"))).limit(1).collect()
    if not found:
        return "No such symbol."
    n = found[0]
    out = [f"{n['name']} ({n['kind']}) {n['file_path']}:{n['start_line']}-{n['end_line']}", *(x for x in (n["signature"], n["docstring"]) if x)]
    if args.get("include_code"):
        rows = F.slice(F.split("content", "\n"), F.lit(max(n["start_line"], 1)), F.lit(max(n["end_line"] - n["start_line"] + 1, 1)))
        code = engine.file_contents.filter(F.col("path") == n["file_path"]).select(rows.alias("rows")).first()
        out += ["", *(code["rows"] if code else [])]
    return "\n".join(out)


def impact_text(engine, args: dict) -> str:
    depth = min(number_of(args, "depth", 2), 10)
    rows = engine.impact(text_of(args, "symbol"), depth).groupBy("file_path").agg(F.count("*").alias("n"), F.max("depth").alias("far"))
    found = rows.orderBy(F.desc("n"), "file_path").limit(100).collect()
    return "\n".join(f"{r['file_path']}: {r['n']} symbols within {r['far']} calls" for r in found) or "Nothing calls it."


def status_text(engine, args: dict) -> str:
    rows = engine.stats().orderBy("what", F.desc("n"), "value").collect()  # kinds and languages
    size = engine.files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    return "\n".join([f"{size['n']} files, {human_bytes(size['size'])}", *(f"{r['what']} {r['value']}: {r['n']}" for r in rows)])


def trace_text(engine, args: dict) -> str:
    path = engine.trace(text_of(args, "from"), text_of(args, "to"))
    if not path:
        return "No call path."
    names = {r["id"]: r["name"] for r in engine.nodes.filter(F.col("id").isin(path)).select("id", "name").collect()}
    return " → ".join(names.get(i, i) for i in path)


def files_text(engine, args: dict) -> str:
    found = engine.list_files(text_of(args, "language", KIND, needed=False)).limit(number_of(args, "limit", 1000)).collect()
    return "\n".join(f"{r['path']} ({r['language']}, {human_bytes(r['size'] or 0)})" for r in found) or "No files."


#: name -> (what it does, arguments, answer)
TOOLS: dict[str, tuple[str, list[str], Callable]] = {
    "search": ("Symbols by name or wildcard", ["query", "kind", "limit"], lambda e, a: listed(e.search(text_of(a, "query"), text_of(a, "kind", KIND, False), number_of(a, "limit", 20)), number_of(a, "limit", 20), "No symbols found.")),
    "context": ("Symbols, relations and code for a task", ["task", "max_nodes"], lambda e, a: e.context_markdown(text_of(a, "task", TASK), max(1, min(number_of(a, "max_nodes", 20), 100)), a.get("include_code", True) is not False)),
    "callers": ("Who calls a symbol", ["symbol", "limit"], lambda e, a: listed(e.callers(text_of(a, "symbol"), number_of(a, "limit", 20)), number_of(a, "limit", 20), "No callers.")),
    "callees": ("What a symbol calls", ["symbol", "limit"], lambda e, a: listed(e.callees(text_of(a, "symbol"), number_of(a, "limit", 20)), number_of(a, "limit", 20), "No callees.")),
    "uncalled": ("Functions nothing calls", ["limit"], lambda e, a: listed(e.uncalled(number_of(a, "limit", 100)).withColumn("kind", F.lit("function")), number_of(a, "limit", 100), "All functions are called.")),
    "impact": ("Files whose symbols reach a symbol by calls", ["symbol", "depth"], impact_text),
    "node": ("One symbol, with its code if wanted", ["symbol", "include_code"], node_text),
    "status": ("Numbers of the snapshot", [], status_text),
    "files": ("Files of the snapshot", ["language", "limit"], files_text),
    "trace": ("A shortest call path", ["from", "to"], trace_text),
    "explore": ("Source of a query's symbols by file", ["query", "max_files"], lambda e, a: e.explore(text_of(a, "query"), number_of(a, "max_files", 0))),
}


def tool_list() -> list[dict]:
    numbers = {"limit", "depth", "max_nodes", "max_files"}
    kind = lambda n: "integer" if n in numbers else "boolean" if n.startswith("include_") else "string"
    return [{"name": name, "description": what, "inputSchema": {"type": "object", "properties": {a: {"type": kind(a)} for a in args}}} for name, (what, args, _) in TOOLS.items()]


def call_tool(engine, params: dict) -> dict:
    name, args = params.get("name"), params.get("arguments") or {}
    if name not in TOOLS:
        raise Refused(BAD_PARAMS, f"unknown tool {name!r}")
    if not isinstance(args, dict):
        raise Refused(BAD_PARAMS, "arguments: an object wanted")
    try:
        return {"content": [{"type": "text", "text": TOOLS[name][2](engine, args)}], "isError": False}
    except Refused as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}


# -- editors ------------------------------------------------------------------------------------------
class Editor:
    """Requests of editors; paths are relative to ``root``, lines count from 0 there and from 1 here."""

    def __init__(self, engine, root: str):
        self.engine, self.root = engine, root.rstrip("/")

    def path(self, params: dict) -> str:
        uri = params.get("textDocument", {}).get("uri", "")
        if not uri.startswith("file://"):
            raise Refused(BAD_PARAMS, "a file URI wanted")
        return unquote(uri[7:]).removeprefix(self.root + "/")

    def place(self, r) -> dict:
        end = max(r["end_line"] or 0, r["start_line"] or 1)
        return {"uri": "file://" + quote(f"{self.root}/{r['file_path']}"), "range": {"start": {"line": max((r["start_line"] or 1) - 1, 0), "character": 0}, "end": {"line": end - 1, "character": 0}}}

    def item(self, r) -> dict:
        return {"name": r["name"], "kind": EDITOR_KIND.get(r["kind"], 13), **self.place(r), "selectionRange": self.place(r)["range"], "data": r["id"]}

    def at(self, params: dict) -> DataFrame:
        where = params.get("position", {})
        return self.engine.definition(self.path(params), number_of(where, "line", 0) + 1, number_of(where, "character", 0))

    def symbols(self, params: dict) -> list:
        rows = self.engine.document_symbols(self.path(params)).limit(10_000).collect()
        made = {r["id"]: {"name": r["name"], "kind": EDITOR_KIND.get(r["kind"], 13), "range": self.place(r)["range"], "selectionRange": self.place(r)["range"], "children": []} for r in rows}
        top = []
        for r in rows:
            (made[r["parent_id"]]["children"] if r["parent_id"] in made else top).append(made[r["id"]])
        return top

    def definition(self, params: dict) -> list:
        return [self.place(r) for r in self.at(params).limit(50).collect()]

    def hover(self, params: dict) -> dict | None:
        r = self.at(params).first()
        return None if r is None else {"contents": {"kind": "markdown", "value": "\n\n".join(x for x in (f"```\n{r['signature'] or r['name']}\n```", r["docstring"]) if x)}}

    def references(self, params: dict) -> list:
        r = self.at(params).first()
        if r is None:
            return []
        links = self.engine.edges_of(r["id"]).filter(F.col("target").isin(r["id"], r["name"])).join(self.engine.nodes.select(F.col("id").alias("source"), "file_path"), "source")
        rows = links.select("file_path", F.coalesce("line", F.lit(1)).alias("start_line"), F.coalesce("line", F.lit(1)).alias("end_line")).distinct().orderBy("file_path", "start_line").limit(1000)
        return [self.place(x) for x in rows.collect()]

    def workspace(self, params: dict) -> list:
        wide = self.engine.workspace_symbols(text_of(params, "query", TEXT, False) or "").join(self.engine.nodes.select("id", "end_line"), "id")
        return [{"name": r["name"], "kind": EDITOR_KIND.get(r["kind"], 13), "location": self.place(r)} for r in wide.orderBy("rank", "start_line", "file_path").collect()]  # at most 50

    def hierarchy(self, params: dict) -> list:
        r = self.at(params).limit(1).select("id").join(self.engine.nodes, "id").first()
        return [] if r is None else [self.item(r)]

    def calls(self, params: dict, incoming: bool) -> list:
        name = params.get("item", {}).get("name", "")
        rows = (self.engine.callers if incoming else self.engine.callees)(name, 1000)
        key = "caller_id" if incoming else "callee_id"
        wide = rows.select(F.col(key).alias("id")).distinct().join(self.engine.nodes, "id").orderBy("file_path", "start_line").limit(1000)
        return [{"from" if incoming else "to": self.item(r), "fromRanges": []} for r in wide.collect()]

    def saved(self, params: dict) -> None:
        """A saved file replaces what the snapshot has of it."""
        path = self.path(params)
        whole = os.path.join(self.root, path)
        text = params.get("text")
        if text is None and os.path.exists(whole):
            with open(whole, encoding="utf-8", errors="replace") as f:
                text = f.read()
        self.engine = self.engine.sync_file(path, text)


def answer(engine, message: object, editor: Editor | None = None) -> object | None:
    """The reply to a message or a batch of them; None where none is due."""
    if isinstance(message, list):
        replies = [r for r in (answer(engine, m, editor) for m in message) if r is not None]
        return replies or None
    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": BAD_REQUEST, "message": "no request"}}
    method, params, number = message["method"], message.get("params") or {}, message.get("id")
    known: dict[str, Callable[[dict], object]] = {
        "ping": lambda p: {},
        "shutdown": lambda p: None,
        "tools/list": lambda p: {"tools": tool_list()},
        "tools/call": lambda p: call_tool(editor.engine if editor else engine, p),
        "initialize": lambda p: {"protocolVersion": p.get("protocolVersion", "2024-11-05"), "serverInfo": {"name": "sylvan", "version": "0.1.0"}, "capabilities": {"tools": {}, **EDITOR_CAPABILITIES}},
    }
    if editor is not None:
        known |= {
            "textDocument/documentSymbol": editor.symbols,
            "textDocument/definition": editor.definition,
            "textDocument/references": editor.references,
            "textDocument/hover": editor.hover,
            "workspace/symbol": editor.workspace,
            "textDocument/prepareCallHierarchy": editor.hierarchy,
            "callHierarchy/incomingCalls": lambda p: editor.calls(p, True),
            "callHierarchy/outgoingCalls": lambda p: editor.calls(p, False),
            "textDocument/didSave": editor.saved,
        }
    if method not in known:
        return None if number is None else {"jsonrpc": "2.0", "id": number, "error": {"code": NO_METHOD, "message": method}}
    try:
        result = known[method](params)
    except Refused as e:
        return None if number is None else {"jsonrpc": "2.0", "id": number, "error": {"code": e.code, "message": str(e)}}
    return None if number is None else {"jsonrpc": "2.0", "id": number, "result": result}


EDITOR_CAPABILITIES = dict.fromkeys(("documentSymbolProvider", "definitionProvider", "referencesProvider", "hoverProvider", "workspaceSymbolProvider", "callHierarchyProvider"), True)


def read_message(source: BinaryIO) -> tuple[object, bool] | None:
    """The next message and whether it came with a header: ``Content-Length`` frames or one line of JSON each. A
    message that is too long or no JSON comes as a ``Refused``. None at the end."""
    line = source.readline(FRAME + 1)
    while line in (b"\n", b"\r\n"):
        line = source.readline(FRAME + 1)
    if not line:
        return None
    framed = line.lower().startswith(b"content-length:")
    if framed:
        size = int(line.split(b":", 1)[1])
        while source.readline(FRAME).strip():
            pass
        if size > FRAME:
            left = size
            while left > 0:
                got = source.read(min(left, FRAME))
                if not got:
                    break
                left -= len(got)
            return Refused(BAD_REQUEST, "message too long"), True
        line = source.read(size)
    elif len(line) > FRAME:
        while not line.endswith(b"\n"):
            line = source.readline(FRAME)
            if not line:
                break
        return Refused(BAD_REQUEST, "message too long"), False
    try:
        return json.loads(line), framed
    except ValueError:
        return Refused(PARSE_ERROR, "no JSON"), framed


def serve(engine, source: BinaryIO, target: BinaryIO, root: str = ".") -> None:
    """Answers messages until the stream ends or an ``exit`` comes; replies are framed as their requests are."""
    editor = Editor(engine, os.path.abspath(root))
    while (got := read_message(source)) is not None:
        message, framed = got
        if isinstance(message, dict) and message.get("method") == "exit":
            return
        reply = {"jsonrpc": "2.0", "id": None, "error": {"code": message.code, "message": str(message)}} if isinstance(message, Refused) else answer(engine, message, editor)
        if reply is not None:
            body = json.dumps(reply, ensure_ascii=False).encode()
            target.write(b"Content-Length: %d\r\n\r\n%b" % (len(body), body) if framed else body + b"\n")
            target.flush()
