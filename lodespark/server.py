"""The engine over HTTP and as tools over standard input: thin services, one engine for all clients.

HTTP: ``GET /health``, ``GET /status``, ``POST /query`` (or ``/search``) with ``{"query": ...}`` or ``{"searches": [{"type", "query"}], "intent"}``, and
``limit, minScore, collections, candidateLimit, rerank``; ``POST /get`` and ``/multi_get`` with ``{"name"}``.
"""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from lodespark.api import Engine
from lodespark.plans.hybrid import Options

PROTOCOL = "2025-06-18"


def query(engine: Engine, q: dict) -> list[dict]:
    """Runs a request's query; raises ValueError on one that can't be run."""
    searches = q.get("searches")
    if searches:
        lines = [f"{s['type']}: {s['query']}" for s in searches]
        text = "\n".join(lines + ([f"intent: {q['intent']}"] if q.get("intent") else []))
    else:
        text = q.get("query") or ""
    if not text.strip():
        raise ValueError("give a query, or searches with type and query")
    o = Options(
        limit=int(q.get("limit", 10)), min_score=float(q.get("minScore", 0)), candidate_limit=int(q.get("candidateLimit", 40)), intent=None if searches else q.get("intent"), skip_rerank=q.get("rerank") is False,
    )
    rows = engine.search(text, q.get("collections"), o)
    return [{k: r.get(k) for k in ("docid", "file", "title", "score", "context", "best_chunk", "best_chunk_pos")} for r in rows]


def instructions(engine: Engine) -> str:
    s = engine.status()
    names = ", ".join(f"{c['collection']} ({c['n_active']})" for c in s["collections"]) or "none"
    return f"{s['active'] or 0} documents in collections: {names}. Use query with typed searches: lex for exact words, vec for questions, hyde for a passage that would answer."


TOOLS = {
    "query": ("Search documents", {"query": "string", "searches": "array", "intent": "string", "limit": "integer", "minScore": "number", "candidateLimit": "integer", "collections": "array", "rerank": "boolean"}, query),
    "get": ("One document, or those with like paths", {"name": "string", "fromLine": "integer", "maxLines": "integer"}, lambda e, q: e.get(q["name"], q.get("fromLine"), q.get("maxLines"))),
    "multi_get": ("Documents of a list or a glob", {"name": "string", "maxBytes": "integer"}, lambda e, q: e.multi_get(q["name"], int(q.get("maxBytes", 10 * 1024)))),
    "status": ("Counts and warnings", {}, lambda e, q: e.status() | {"warnings": e.health()}),
}


def http_server(engine: Engine, host: str = "127.0.0.1", port: int = 8181) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def answer(self, code: int, body) -> None:
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:  # noqa: N802
            if self.path == "/health":
                self.answer(200, {"status": "ok"})
            elif self.path == "/status":
                self.answer(200, TOOLS["status"][2](engine, {}))
            else:
                self.answer(404, {"error": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            if self.path.rstrip("/") == "/mcp":
                return self.tools()
            name = {"search": "query"}.get(self.path.strip("/"), self.path.strip("/"))
            if name not in TOOLS:
                return self.answer(404, {"error": "not found"})
            try:
                q = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                self.answer(200, {"results": TOOLS[name][2](engine, q)})
            except (ValueError, KeyError, TypeError, AttributeError) as e:
                self.answer(400, {"error": str(e)})

        def tools(self) -> None:
            """The tool server's messages, one or a list of them in a request; notifications alone get an empty 202."""
            try:
                sent = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                answers = [a for a in (tool_answer(engine, m) for m in (sent if isinstance(sent, list) else [sent])) if a is not None]
            except (ValueError, AttributeError) as e:
                return self.answer(400, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}})
            if answers:
                return self.answer(200, answers if isinstance(sent, list) else answers[0])
            self.send_response(202)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def tool_answer(engine: Engine, m: dict) -> dict | None:
    """The answer to a JSON-RPC message ``initialize``, ``tools/list``, ``tools/call`` or ``resources/read``; None to a notification."""
    if not isinstance(m, dict):
        raise ValueError("a message is an object")
    if "id" not in m:
        return None
    out: dict = {"jsonrpc": "2.0", "id": m["id"]}
    p = m.get("params") or {}
    if m.get("method") == "initialize":
        out["result"] = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}, "resources": {}}, "serverInfo": {"name": "lodespark", "version": "1"}, "instructions": instructions(engine)}
    elif m.get("method") == "tools/list":
        out["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in ps.items()}}} for n, (d, ps, _) in TOOLS.items()]}
    elif m.get("method") == "tools/call" and p.get("name") in TOOLS:
        try:
            text, wrong = json.dumps(TOOLS[p["name"]][2](engine, p.get("arguments") or {}), ensure_ascii=False, default=str), False
        except (ValueError, KeyError, TypeError) as e:
            text, wrong = str(e), True
        out["result"] = {"content": [{"type": "text", "text": text}], "isError": wrong}
    elif m.get("method") == "resources/read":
        d = engine.get(p.get("uri", ""))
        out["result"] = {"contents": [{"uri": p.get("uri", ""), "mimeType": "text/markdown", "text": d.get("body", "")}]}
    else:
        out["error"] = {"code": -32601, "message": "no such method"}
    return out


def tool_server(engine: Engine, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """JSON-RPC messages, one a line."""
    for line in source:
        if line.strip() and (out := tool_answer(engine, json.loads(line))) is not None:
            print(json.dumps(out, ensure_ascii=False), file=sink, flush=True)
