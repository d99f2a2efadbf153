import io
import json

import pytest

from sylvan import serve
from sylvan.api import Engine

A = 'def load(x):\n    """Reads."""\n    return trim(x)\n\n\ndef trim(x):\n    return x\n'


@pytest.fixture(scope="module")
def engine(spark):
    return Engine.index(spark, spark.createDataFrame([("src/a.py", "python", A), ("src/b.py", "python", "class Box:\n    def put(self):\n        load(1)\n")], "path string, language string, content string"))


def tool(engine, name, **args):
    r = serve.answer(engine, {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})["result"]
    return r["content"][0]["text"], r["isError"]


def test_tools(engine):
    listed = serve.answer(engine, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"})["result"]["tools"]
    assert len(listed) == 11 and {t["name"] for t in listed} == set(serve.TOOLS)
    assert tool(engine, "search", query="tr*")[0].startswith("trim (function) src/a.py:6")
    assert tool(engine, "callers", symbol="load")[0].startswith("put (method)") and tool(engine, "callees", symbol="load")[0].startswith("trim")
    assert tool(engine, "trace", **{"from": "put", "to": "trim"})[0] == "put → load → trim"
    assert "return trim(x)" in tool(engine, "node", symbol="load", include_code=True)[0] and tool(engine, "node", symbol="gone")[0] == "No such symbol."
    assert "src/b.py: 1 symbols" in tool(engine, "impact", symbol="trim")[0] and tool(engine, "status")[0].startswith("2 files")
    assert "src/a.py (python" in tool(engine, "files")[0] and "#### src/a.py" in tool(engine, "explore", query="load")[0]
    assert "load" in tool(engine, "context", task="how does load trim?")[0] and tool(engine, "uncalled", limit=5)[0] == "All functions are called."
    assert tool(engine, "search")[1] and tool(engine, "search", query="x" * 10_001)[1] and tool(engine, "callers", symbol="load", limit=-1)[1] and tool(engine, "search", query="a", limit=True)[1]


def test_protocol(engine):
    assert serve.answer(engine, {"jsonrpc": "2.0", "method": "notifications/initialized"}) is None
    assert serve.answer(engine, {"jsonrpc": "2.0", "id": 2, "method": "none"})["error"]["code"] == -32601
    assert serve.answer(engine, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "none"}})["error"]["code"] == -32602
    batch = serve.answer(engine, [{"id": 1, "method": "ping"}, {"method": "ping"}, 5])
    assert [r.get("id") for r in batch] == [1, None] and "error" in batch[1]
    body = b'{"id": 7, "method": "ping"}'
    stream = io.BytesIO(b"Content-Length: %d\r\nX: y\r\n\r\n%b\n" % (len(body), body) + body + b"\n{broken\n" + b"Content-Length: 2000000\r\n\r\n" + b"x" * 2_000_000 + b'{"method": "exit"}\n' + body)
    out = io.BytesIO()
    serve.serve(engine, stream, out)
    text = out.getvalue()
    assert text.count(b'"id": 7') == 2 and text.startswith(b"Content-Length: ") and text.count(b"error") == 2


def test_editor(engine, tmp_path):
    editor = serve.Editor(engine, "/w")
    doc = {"textDocument": {"uri": "file:///w/src/a.py"}}
    ask = lambda method, params: serve.answer(engine, {"id": 1, "method": method, "params": params}, editor)["result"]
    assert [s["name"] for s in ask("textDocument/documentSymbol", doc)] == ["load", "trim"]
    box = ask("textDocument/documentSymbol", {"textDocument": {"uri": "file:///w/src/b.py"}})
    assert box[0]["name"] == "Box" and box[0]["children"][0]["name"] == "put"
    here = {**doc, "position": {"line": 2, "character": 12}}
    assert ask("textDocument/definition", here)[0] == {"uri": "file:///w/src/a.py", "range": {"start": {"line": 5, "character": 0}, "end": {"line": 6, "character": 0}}}
    assert [r["range"]["start"]["line"] for r in ask("textDocument/references", here)] == [2]
    assert "def trim(x):" in ask("textDocument/hover", here)["contents"]["value"] and ask("textDocument/hover", {**doc, "position": {"line": 2, "character": 0}}) is None
    assert [s["name"] for s in ask("workspace/symbol", {"query": "tri"})] == ["trim"]
    item = ask("textDocument/prepareCallHierarchy", here)[0]
    assert item["name"] == "trim" and ask("callHierarchy/incomingCalls", {"item": item})[0]["from"]["name"] == "load" and ask("callHierarchy/outgoingCalls", {"item": item}) == []
    assert serve.answer(engine, {"method": "textDocument/didSave", "params": {**doc, "text": "def fresh(x):\n    return x\n"}}, editor) is None
    assert [s["name"] for s in ask("textDocument/documentSymbol", doc)] == ["fresh"]
    assert serve.answer(engine, {"id": 1, "method": "textDocument/hover", "params": {"textDocument": {"uri": "http://x"}}}, editor)["error"]["code"] == -32602
