"""Command line: ``python -m lodespark --root DIR COMMAND ...``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from lodespark.api import Engine
from lodespark.plans.evaluate import compare_file
from lodespark.plans.hybrid import Options
from lodespark.server import http_server, tool_server


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodespark")
    p.add_argument("--root", required=True, help="directory of the tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("collection")
    c.add_argument("action", choices=["add", "remove", "rename", "list"])
    c.add_argument("args", nargs="*")
    c.add_argument("--pattern", default="**/*.md")
    c = sub.add_parser("context")
    c.add_argument("action", choices=["set", "remove", "list"])
    c.add_argument("args", nargs="*")
    for name in ("update", "embed", "status", "cleanup"):
        c = sub.add_parser(name)
        c.add_argument("--force", action="store_true")
    for name in ("search", "vsearch", "query"):
        c = sub.add_parser(name)
        c.add_argument("text")
        c.add_argument("-n", type=int)
        c.add_argument("--all", action="store_true")
        c.add_argument("--min-score", type=float, default=0.0)
        c.add_argument("--style", default="md", choices=["json", "csv", "files", "md", "xml"])
        c.add_argument("-c", "--collection", action="append")
        c.add_argument("--full", action="store_true")
        c.add_argument("--explain", action="store_true")
        c.add_argument("--intent")
    for name in ("get", "multi-get", "ls"):
        c = sub.add_parser(name)
        c.add_argument("name")
        c.add_argument("prefix", nargs="?", default="")
    c = sub.add_parser("bench")
    c.add_argument("fixture")
    c = sub.add_parser("serve")
    c.add_argument("--port", type=int, default=8181)
    sub.add_parser("tools")
    a = p.parse_args(argv)
    e = Engine(SparkSession.builder.appName("lodespark").getOrCreate(), a.root)
    show = lambda x: print(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False, indent=2, default=str))
    if a.command == "collection":
        if a.action == "add":
            e.add_collection(a.args[0], a.args[1], a.pattern)
        elif a.action == "remove":
            e.remove_collection(a.args[0])
        elif a.action == "rename":
            e.rename_collection(a.args[0], a.args[1])
        show(e.collections())
    elif a.command == "context":
        if a.action != "list":
            e.set_context(a.args[0], a.args[1], a.args[2] if a.action == "set" else None)
        show([r.asDict() for r in e.contexts().collect()])
    elif a.command == "embed":
        show(e.embed(a.force))
    elif a.command in ("update", "status", "cleanup"):
        show(getattr(e, a.command)())
    elif a.command in ("search", "vsearch", "query"):
        n = 100_000 if a.all else a.n or (20 if a.style in ("json", "files") else 5)
        if a.command == "search":
            rows = e.search_lex(a.text, n, a.collection, a.min_score)
        elif a.command == "vsearch":
            rows = e.search_vector(a.text, n, a.collection, a.min_score or 0.3)
        else:
            rows = e.search(a.text, a.collection, Options(limit=n, min_score=a.min_score, intent=a.intent, explain=a.explain))
        show(e.format(rows, a.style, a.text, a.full))
    elif a.command == "bench":
        show(compare_file(e, a.fixture))
    elif a.command == "serve":
        http_server(e, port=a.port).serve_forever()
    elif a.command == "tools":
        tool_server(e)
    elif a.command == "get":
        show(e.get(a.name))
    elif a.command == "multi-get":
        show(e.multi_get(a.name))
    else:
        show(e.list_files(a.name, a.prefix))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
