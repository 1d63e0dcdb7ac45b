import hashlib
import json
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespark.api import Engine
from lodespark.functions import paths as P
from lodespark.operators import context, lookup, models, store
from lodespark.plans.hybrid import Options
from lodespark.plans.query_document import SubQuery, parse_expansion, parse_query_document
from lodespark.schema import Descriptor, check_space, templates
from lodespark.sources import formats, ingest, training
from lodespark.streaming import jobs

INDEX = "id long, collection string, path string, title string, hash string, created_at timestamp, modified_at timestamp, active int, loaded_at timestamp"


@pytest.mark.parametrize(
    "path, want",
    [("A___B/C d.e.MD", "a/b/c-d-e.md"), ("📌 note.md", "1f4cc-note.md"), ("x/📌📌/y.txt", "x/1f4cc-1f4cc/y.txt"), ("$id.md", "$id.md"), ("--a--/b_c.md", "a/b-c.md"), ("Ünï code.md", "ünï-code.md"), ("no ext", "no-ext"), ("a//b.md", "a/b.md")],
)
def test_handelize(spark, path, want):
    assert P.handelize(path) == want
    assert spark.createDataFrame([(path,)], "p string").select(P.handelized(F.col("p"))).first()[0] == want


def test_handelize_refuses(spark):
    for bad in ("", "  ", "...", "a/---.md", "/"):
        with pytest.raises(ValueError):
            P.handelize(bad)
    rows = spark.createDataFrame([("...",), (None,), ("a/---.md",)], "p string").select(P.handelized(F.col("p"))).collect()
    assert [r[0] for r in rows] == [None] * 3


def test_paths():
    assert P.parse_virtual("lode://c/a/b.md") == ("c", "a/b.md") and P.parse_virtual("lode:////c") == ("c", "") and P.parse_virtual("//c/x") == ("c", "x") and P.parse_virtual("c/x") is None
    assert P.is_docid("'#abc123'") and not P.is_docid("abc12") and not P.is_docid("xyz123") and P.normal_docid('"#ab"') == "ab"
    assert P.split_line_suffix("a.md:12") == ("a.md", 12) and P.split_line_suffix("a.md") == ("a.md", None)
    assert P.resolve("/a/b", "../c", "./d") == "/a/c/d" and P.resolve("/a", "/x/y") == "/x/y" and P.native_path("/mnt/c/x") == "C:/x" and P.native_path("C:\\a\\b") == "C:/a/b"
    assert P.is_absolute("C:/x") and P.is_absolute("/x") and not P.is_absolute("x")


@pytest.mark.parametrize("glob, yes, no", [("**/*.md", ["a.md", "x/y/a.md"], ["a.txt"]), ("a/*.md", ["a/b.md"], ["a/b/c.md"]), ("{a,b}/?[0-9].md", ["a/x1.md", "b/y2.md"], ["c/x1.md", "a/xx.md"]), ("**/tmp/**", ["tmp/x", "a/tmp/b/c"], ["tmpx/a"])])
def test_globs(glob, yes, no):
    import re

    rx = re.compile(P.glob_regex(glob))
    assert all(rx.match(p) for p in yes) and not any(rx.match(p) for p in no)


def test_titles(spark):
    rows = [("# Head\nx", "a.md", "Head"), ("x\n## Two  \r\ny", "a.md", "Two"), ("# Notes\n## Real", "a.md", "Real"), ("# Notes\nx", "a.md", "Notes"), ("no", "d/a.b.md", "a.b"), ("#+TITLE: Org\n* h", "a.org", "Org"), ("* First", "a.org", "First"), ("# x", "a.txt", "a"), ("", "q.md", "q")]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, p string")
    assert [r[0] for r in df.select(ingest.title_of(F.col("t"), F.col("p"))).collect()] == [r[2] for r in rows]


def test_current_and_empty(spark):
    from datetime import datetime as dt

    rows = [(1, "c", "p", "old", "h1", None, None, 1, dt(2024, 1, 1)), (1, "c", "p", "new", "h2", None, None, 1, dt(2024, 1, 2)), (2, "c", "q", None, None, None, None, 0, None), (None, "c", "z", "t", "h", None, None, 1, None)]
    d = spark.createDataFrame(rows, INDEX)
    assert {(r["id"], r["title"]) for r in store.current_documents(d).collect()} == {(1, "new"), (2, None)}
    assert store.current_documents(d.limit(0)).count() == 0
    assert {r["hash"] for r in store.bodies(spark.createDataFrame([("a", None, None), ("a", "x", None), (None, "y", None)], "hash string, doc string, created_at timestamp")).collect()} == {"a"}


def test_merge_reactivates_and_keeps_other_collections(spark):
    docs = spark.createDataFrame([("c", "a", "h1", "t", 0), ("c", "gone", "h2", "t", 1), ("other", "x", "h3", "t", 1)], "collection string, path string, hash string, title string, active int")
    scan = spark.createDataFrame([("c", "a", "h1", "t"), ("c", "new", "h4", "t")], "collection string, path string, hash string, title string")
    out = {(r["collection"], r["path"]): r["active"] for r in store.merge_documents(docs, scan).collect()}
    assert out == {("c", "a"): 1, ("c", "gone"): 0, ("c", "new"): 1, ("other", "x"): 1}
    diff = {(r["path"], r["status"]) for r in store.scan_diff(docs, scan).collect()}
    assert diff == {("a", "indexed"), ("gone", "removed"), ("new", "indexed")}


def test_context_boundary(spark):
    docs = spark.createDataFrame([("c", "talks/a.md"), ("c", "talks-old/b.md"), ("d", "x.md")], "collection string, path string")
    ctx = spark.createDataFrame([("c", "/", "root"), ("c", "/talks", "talks")], "collection string, prefix string, text string")
    plain = {r["path"]: r["context"] for r in context.inherited_context(docs, ctx, "all").collect()}
    assert plain == {"talks/a.md": "all\n\nroot\n\ntalks", "talks-old/b.md": "all\n\nroot\n\ntalks", "x.md": "all"}
    strict = {r["path"]: r["context"] for r in context.inherited_context(docs, ctx, None, path_boundary=True).collect()}
    assert strict == {"talks/a.md": "root\n\ntalks", "talks-old/b.md": "root", "x.md": None}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


def test_fuzzy_equals_brute_force(spark):
    import random

    r = random.Random(3)
    names = ["".join(r.choice("abc/.") for _ in range(r.randint(0, 9))) for _ in range(120)]
    queries = ["".join(r.choice("abc/.") for _ in range(r.randint(0, 9))) for _ in range(25)] + ["aé", ""]
    docs = spark.createDataFrame([(n,) for n in names], "path string")
    out = lookup.fuzzy_lookup(docs, spark.createDataFrame([(q,) for q in queries], "query string"), 2, 1000).collect()
    want = {(q, n, distance(q, n)) for q in queries for n in names if distance(q, n) <= 2}
    assert {(x["query"], x["path"], x["distance"]) for x in out} == want


@pytest.mark.parametrize("bad", ["lex: a\nplain", "intent: x", "intent: a\nintent: b\nlex: c", "lex:\nvec: a", "expand: a\nlex: b", "expand:", "vec:  "])
def test_query_document_errors(bad):
    with pytest.raises(ValueError):
        parse_query_document(bad)


def test_query_documents():
    assert parse_query_document("plain text") is None and parse_query_document("expand: x") is None and parse_query_document(" \n ") is None
    d = parse_query_document("LEX: a b\n\nintent: why\nhyde:  c ")
    assert d.searches == (SubQuery("lex", "a b", 1), SubQuery("hyde", "c", 4)) and d.intent == "why"


def test_expansions():
    e = parse_expansion("```\n- lex: **harbour ferry**\n1. vec: how the harbour works\nhyde: <query>\nvec: other\nprose\nlex: harbour ferry", "harbour")
    assert e.usable and [(q.type, q.query) for q in e.queries] == [("lex", "harbour ferry"), ("vec", "how the harbour works")] and len(e.rejected) == 4
    assert not parse_expansion("<think>x</think>", "a").usable and not parse_expansion(" ", "a").usable
    assert [q.type for q in parse_expansion("lex: a b\nvec: a b", "a b", lexical=False).queries] == ["vec"]


def test_formats(spark):
    rows = [{"docid": "abc123", "score": 0.98765, "file": "lode://c/a,b.md", "title": 'T "x" & <y>', "context": "all, of it", "body": "one\ntwo"}]
    assert json.loads(formats.results_text(formats.with_snippets(spark, rows, "two", "json"), "json"))[0]["score"] == 0.99
    assert formats.results_text(formats.with_snippets(spark, rows, "two", "csv"), "csv").split("\n")[1].startswith('#abc123,0.9877,"lode://c/a,b.md","T ""x"" & <y>","all, of it",2,')
    assert formats.results_text(rows, "files") == '#abc123,0.99,"lode://c/a,b.md","all, of it"' and "&lt;y&gt;" in formats.results_text(rows, "xml") and "**docid:** `#abc123`" in formats.results_text(rows, "md", full=True)
    assert formats.results_text([], "json") == "[]"
    with pytest.raises(ValueError):
        formats.results_text(rows, "yaml")


def test_spaces_and_templates():
    a, b = Descriptor("hash", "m", 8), Descriptor("hash", "m", 16)
    assert a.space_id != b.space_id and len(a.space_id) == 24 and a.space_id == Descriptor("hash", "m", 8).space_id
    check_space(None, "x")
    with pytest.raises(ValueError):
        check_space(a.space_id, b.space_id)
    assert templates("Qwen3-Embedding")[0].startswith("Instruct") and templates("nomic")[1].startswith("search_document") and "{title}" in templates("other")[1]


def test_training_jsonl(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"query": "q", "output": [["lex", "a"], ["hyde", " b "]]}\n')
    assert training.read_jsonl(spark, str(good)).first()["output"][0]["type"] == "lex"
    (tmp_path / "b.jsonl").write_text('{"query": "q", "output": 5x}\n')
    with pytest.raises(Exception):
        training.read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()


def broken(dims):
    """An encoder that fails on texts with ``bad`` in them, and on any batch that holds one."""
    inner = models.HashEncoder(dims)

    class Broken:
        descriptor = inner.descriptor

        def encode(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("no")
            x = inner.encode(texts)
            if any("nan" in t for t in texts):
                x[0, 0] = float("nan")
            return x

    return Broken()


def test_encoding_failures_are_outcomes(spark):
    rows = spark.createDataFrame([("a", 0, 0, "fine text", None), ("b", 0, 0, "bad text", "t"), ("c", 0, 0, "nan text", "t"), ("d", 0, 0, "", None)], "key string, seq int, pos int, chunk string, title string")
    out = {r["key"]: (r["embedding"] is not None, r["error"]) for r in models.encode_chunks(rows, broken(8)).collect()}
    assert out["a"] == (True, None) and out["d"][0] and out["b"] == (False, "RuntimeError: no") and out["c"] == (False, "values that are not finite")


def test_rerank_scores_texts_once(spark):
    pairs = spark.createDataFrame([("harbour", "a", "the harbour"), ("harbour", "b", "the harbour"), ("harbour", "c", "nothing")], "query string, file string, chunk string")
    out = {r["file"]: r["score"] for r in models.rerank(pairs, models.OverlapScorer()).collect()}
    assert out["a"] == out["b"] > out["c"]
    cache = models.rerank(pairs, models.OverlapScorer()).select("cache_key", F.lit(0.25).alias("score")).distinct()
    assert {r["score"] for r in models.rerank(pairs, models.OverlapScorer(), cache).collect()} == {0.25}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="ab c", max_size=12), min_size=1, max_size=5))
def test_hash_encoder_is_unit(texts):
    x = models.HashEncoder(16).encode(texts)
    assert x.shape == (len(texts), 16) and all(abs(np.linalg.norm(v) - 1) < 1e-5 or not v.any() for v in x)


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("engine")
    files = root / "files"

    def write(name, text):
        p = files / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())

    write("talks/Big Idea.md", "# Big Idea\n\nThe quick harbour keeps a copper ledger.\n")
    write("a.md", "# Second\nharbour ferry harbour\n")
    write("b.md", "plain text about ferries\n")
    for name, text in (("blank.md", " \n"), (".x.md", "hidden"), ("node_modules/n.md", "x"), ("talks/.h/h.md", "x"), ("c.txt", "not markdown"), ("bad.md", b"\xff\xfe\x00")):
        write(name, text)
    e = Engine(spark, str(root / "store"))
    e.write = write
    e.files = files
    e.add_collection("docs", str(files))
    e.set_context("docs", "/talks", "Talks of the year")
    e.global_context = "All."
    return e


def test_engine_from_scan_to_search(engine):
    e = engine
    assert e.update()["indexed"] == 3 and e.update() == {"indexed": 0, "updated": 0, "unchanged": 3, "removed": 0, "orphaned": 0}
    assert e.list_files("docs") == ["a.md", "b.md", "talks/big-idea.md"] and e.list_files("docs", "t") == ["talks/big-idea.md"]
    assert e.health() and e.embed()["documents"] == 3 and e.embed()["documents"] == 0 and e.health() == []
    assert e.get("docs/a.md")["body"].startswith("# Second") and e.get("lode://docs/talks/big-idea.md:3")["context"] == "All.\n\nTalks of the year"
    assert e.get(e.get("b.md")["docid"])["file"] == "lode://docs/b.md" and e.get("c.md")["similar"] == ["a.md", "b.md"]
    assert [r["file"] for r in e.search_lex("harbour -copper")] == ["lode://docs/a.md"] and e.search_vector("harbour ferry")[0]["file"] == "lode://docs/a.md"
    rows = e.search("harbour", options=Options(explain=True))
    assert rows[0]["file"] == "lode://docs/a.md" and rows[0]["contributions"] and e.search("lex: ledger\nvec: copper\nintent: boats")[0]["title"] == "Big Idea"
    assert e.search("harbour", options=Options(skip_rerank=True, limit=2))[1]["score"] == 0.5 and "docs/a.md" in e.format(rows, "csv")
    assert len(e.multi_get("docs/**/*.md")) == 3 and e.multi_get("a.md, b.md", max_bytes=5)[0]["skip_reason"]
    with pytest.raises(ValueError):
        e.search("lex: a\nplain")


def test_engine_changes(engine):
    e = engine
    os.remove(e.files / "b.md")
    e.write("a.md", "# New\nharbour")
    assert {k: v for k, v in e.update().items() if v} == {"updated": 1, "unchanged": 1, "removed": 1, "orphaned": 2}
    e.write("b.md", "plain text about ferries\n")
    assert e.update()["indexed"] == 1
    e.cleanup()
    assert e.status()["active"] == 3 and e.embed()["status"] == "complete"
    with pytest.raises(ValueError):
        Engine(e.spark, e.tables.root, encoder=models.HashEncoder(32)).embed()
    bigger = Engine(e.spark, e.tables.root, encoder=models.HashEncoder(32))
    assert bigger.embed(force=True)["documents"] == 3
    with pytest.raises(ValueError):
        e.search_vector("harbour")
    e.clear_embeddings()
    assert e.embed()["documents"] == 3
    with pytest.raises(ValueError):
        e.rename_collection("docs", "docs")
    e.rename_collection("docs", "d2")
    assert e.list_files("d2") and e.collections()[0]["name"] == "d2"
    e.set_default("d2", False)
    assert e.search_lex("harbour") == [] and e.search_lex("harbour", collections=["d2"])
    e.remove_collection("d2")
    assert e.collections() == [] and e.list_files("d2") == []


def test_failed_jobs(spark, engine, tmp_path):
    (tmp_path / "f").mkdir()
    for i, t in enumerate(("good one", "bad one", "good two")):
        (tmp_path / "f" / f"{i}.md").write_text(t)
    e = Engine(spark, str(tmp_path / "s"), encoder=broken(8))
    e.add_collection("c", str(tmp_path / "f"))
    e.update()
    assert e.embed()["status"] == "partial" and e.embed() | {"seconds": 0} == {"status": "failed", "documents": 1, "chunks": 1, "failed": 1, "seconds": 0}
    e.encoder = models.HashEncoder(8)
    assert e.embed()["status"] == "complete" and e.vectors().count() == 3


def stoppable(file):
    """An encoder that fails for good while a file exists."""

    class Stoppable(models.HashEncoder):
        def encode(self, texts):
            if os.path.exists(str(file)):
                raise RuntimeError("gone")
            return super().encode(texts)

    return Stoppable(8)


def test_jobs_are_stored_by_batch(spark, tmp_path):
    src, stop = tmp_path / "f", tmp_path / "stop"
    src.mkdir()
    e = Engine(spark, str(tmp_path / "s"), encoder=stoppable(stop))
    e.add_collection("c", str(src))
    write = lambda some: [(src / f"{i}.md").write_text(f"# T{i}\nbody {i}") for i in some]
    write(range(6))
    e.update()
    assert e.embed(batch_docs=2)["documents"] == 6 and e.vectors().count() == 6
    parts = set((tmp_path / "s" / "vectors" / e.tables.current("vectors")).iterdir())
    write(range(6, 8))
    e.update()
    assert e.embed()["documents"] == 2 and e.vectors().count() == 8
    assert parts < set((tmp_path / "s" / "vectors" / e.tables.current("vectors")).iterdir())  # added, not rewritten
    stop.touch()
    write(range(8, 14))
    e.update()
    out = e.embed(batch_docs=2)
    assert out["status"] == "failed" and out["chunks"] < 6 and e.vectors().count() == 8  # stopped early
    stop.unlink()
    # A job that broke off between its two writes: the texts are pending still, and nothing comes twice.
    e.tables.append("expected", spark.createDataFrame([(h["hash"], e._fingerprint(), 1) for h in e.documents().select("hash").collect()], "hash string, fingerprint string, total_chunks long"))
    assert e.embed(batch_docs=3)["documents"] == 6 and e.vectors().count() == 14 and e.vectors().select("hash", "seq").distinct().count() == 14
    assert e.embed()["documents"] == 0


def test_configurations(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "s"))
    e.add_collection("old", "/nowhere")
    config = {"collections": {"a": {"path": "/x", "ignore": ["b/**"], "context": {"/": "All"}}, "b": {"path": "/y", "includeByDefault": False}}, "global_context": "G"}
    (tmp_path / "c.json").write_text(json.dumps(config))
    assert e.sync_config(str(tmp_path / "c.json")) and [c["name"] for c in e.collections()] == ["a", "b"] and e.global_context == "G"
    assert not e.sync_config(config) and e.sync_config({"collections": {"b": {"path": "/y"}}}) and [c["name"] for c in e.collections()] == ["b"]


def test_older_cache_keys(spark):
    pairs = spark.createDataFrame([("q", "f1", "one q"), ("q", "f2", "one q"), ("q", "f3", "two"), ("q", "f4", "q")], "query string, file string, chunk string")
    key = lambda *parts: hashlib.sha256("\n".join(parts).encode()).hexdigest()
    cache = spark.createDataFrame([(key("overlap", "q", "one q"), 0.1), (key("overlap", "q", "f1", "one q"), 0.2), (key("overlap", "q", "f3", "two"), 0.3)], "cache_key string, score double")
    out = {r["file"]: r["score"] for r in models.rerank(pairs, models.OverlapScorer(), cache).collect()}
    assert (out["f1"], out["f2"], out["f3"]) == (0.1, 0.1, 0.3) and out["f4"] > 0.9


def test_remote_encoder():
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lodespark.schema import Descriptor

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["texts"]
            x = np.array([[len(t), 1] for t in texts], "<f4")
            raw = self.headers["Accept"] == "application/octet-stream"
            data = np.array(x.shape, "<i4").tobytes() + x.tobytes() if raw else json.dumps({"embeddings": x.tolist()}).encode()
            self.send_response(200)
            self.send_header("Content-Type", self.headers["Accept"])
            self.end_headers()
            self.wfile.write(data[:-1] if "cut" in texts else data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    remote = models.RemoteEncoder(url, Descriptor("remote", "m", 2))
    for n in (1, 15, 16, 40):
        assert remote.encode(["x" * i for i in range(n)]).tolist() == [[i, 1] for i in range(n)]
    for texts in (["cut"] * 20, ["cut"]):
        with pytest.raises(ValueError):
            remote.encode(texts)
    with pytest.raises(ValueError):
        models.RemoteEncoder(url, Descriptor("remote", "m", 3)).encode(["a"])
    server.shutdown()


def test_streams(spark, tmp_path):
    from datetime import datetime as dt

    rows = [(i, dt(2024, 1, 1, i // 6, (i % 6) * 10), i % 2, "view", 1.0, "{}") for i in range(30)]
    spark.createDataFrame(rows, jobs.EVENTS).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(jobs.EVENTS).parquet(str(tmp_path / "events"))
    for name, plan in (("windows", jobs.windowed_counts), ("users", jobs.sessions)):
        q = plan(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "windows" else "append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert {tuple(r) for r in spark.table("windows").select("start", "n").collect()} == {tuple(r) for r in jobs.windowed_counts(spark.read.parquet(str(tmp_path / "events"))).select("start", "n").collect()}
    docs = [(i, f"text {i}", None, None, 6, "c", f"{i}.md", None, dt(2024, 1, 1)) for i in range(5)] + [(9, None, None, None, 0, "c", "n", None, None)]
    spark.createDataFrame(docs, jobs.DOCUMENTS).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        jobs.embed_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), models.HashEncoder(8)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    assert jobs.distinct_content(spark.read.parquet(str(tmp_path / "in"))).count() == 5


def test_services(spark, tmp_path):
    import io
    import threading
    import urllib.error
    import urllib.request

    from lodespark.server import http_server, tool_server

    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.md").write_text("# A\ncopper harbour ledger")
    e = Engine(spark, str(tmp_path / "s"))
    e.add_collection("c", str(tmp_path / "f"))
    e.update()
    e.embed()
    from lodespark.plans.evaluate import compare

    _, averages = compare(e, [{"id": "q1", "query": "copper harbour", "expected_files": ["a.md"]}, {"id": "q2", "query": 'a "b', "expected_files": ["a.md"]}])
    by = {r["backend"]: r for r in averages.collect()}
    assert set(by) == {"bm25", "vector", "hybrid", "full"} and by["bm25"]["recall"] == 0.5 and by["full"]["n_queries"] == 2
    http = http_server(e, port=0)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{http.server_address[1]}"
    ask = lambda path, body: json.load(urllib.request.urlopen(urllib.request.Request(base + path, json.dumps(body).encode())))
    assert json.load(urllib.request.urlopen(base + "/health")) == {"status": "ok"}
    assert ask("/query", {"searches": [{"type": "lex", "query": "copper"}], "limit": 3})["results"][0]["file"] == "lode://c/a.md"
    assert ask("/get", {"name": "a.md"})["results"]["body"].startswith("# A")
    assert ask("/mcp", {"jsonrpc": "2.0", "id": 7, "method": "tools/list"})["id"] == 7
    assert [m["id"] for m in ask("/mcp", [{"id": 1, "method": "tools/call", "params": {"name": "status"}}, {"method": "notifications/x"}, {"id": 2, "method": "x"}])] == [1, 2]
    assert urllib.request.urlopen(urllib.request.Request(base + "/mcp", b'{"method": "notifications/initialized"}')).status == 202
    for path, body, code in (("/mcp", "x", 400), ("/query", {}, 400), ("/nothing", {}, 404), ("/query", {"searches": [{"type": "lex", "query": 'a "b'}]}, 400)):
        with pytest.raises(urllib.error.HTTPError) as err:
            ask(path, body)
        assert err.value.code == code
    http.shutdown()
    calls = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "query", "arguments": {"query": "copper"}}}, {"id": 4, "method": "x"}, {"id": 5, "method": "tools/call", "params": {"name": "get", "arguments": {}}}]
    sink = io.StringIO()
    tool_server(e, io.StringIO("\n".join(map(json.dumps, calls)) + "\n"), sink)
    out = {m["id"]: m for m in map(json.loads, sink.getvalue().splitlines())}
    assert "1 documents" in out[1]["result"]["instructions"] and len(out[2]["result"]["tools"]) == 4 and "lode://c/a.md" in out[3]["result"]["content"][0]["text"] and out[4]["error"] and out[5]["result"]["isError"]


def test_numbered_bodies(spark, tmp_path):
    from lodespark.plans.store_queries import QUERIES

    docs = {"a": "one\r\ntwo\n", "b": None, "c": "", "d": "x" * 100_000 + "\n\n汉🙂", "e": "\ufeffone"}
    rows = [(h, d, None) for h, d in docs.items()] + [("a", docs["a"], None)]
    spark.createDataFrame(rows, "hash string, doc string, created_at timestamp").write.parquet(str(tmp_path / "content.parquet"))
    out = QUERIES["f8_numbered_bodies"](spark, str(tmp_path)).collect()
    want = {h: None if d is None else "\n".join(f"{i}: {x}" for i, x in enumerate(d.split("\n"), 10)) for h, d in docs.items()}
    assert len(out) == len(docs) and {r["hash"]: r["numbered"] for r in out} == want
