import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodespark.functions.snippet import intent_terms, numbered_lines, snippets
from lodespark.functions.stem import stem
from lodespark.operators import chunks, fusion, lexical, lookup, metrics, models, syntax, vector


@pytest.mark.parametrize(
    "query, want",
    [
        ("performance -sports", '"performance"* NOT "sports"*'), ('"machine learning"', '"machine learning"'), ("multi-agent memory", '"multi agent" AND "memory"*'), ("DEC-0054", '"dec 0054"'), ("-multi-agent", None),
        ('a -"b c" d', '"a"* AND "d"* NOT "b c"'), ("", None), ("   ", None), ("!!!", None), ('"open phrase', '"open phrase"'), ("don't stop", '"don\'t"* AND "stop"*'), ("c++ code", '"c"* AND "code"*'), ("x -multi-agent", '"x"* NOT "multi agent"'),
        ('""', None), ('a"b c"', '"a"* AND "b c"'), ("snake_case", '"snake_case"*'), ("- a", '"a"*'), ("été", '"été"*'),
    ],
)
def test_lex_grammar(query, want):
    assert lexical.match_string(query) == want


def test_validation():
    for bad in ("a\nb", 'a "b'):
        with pytest.raises(ValueError):
            lexical.validate_lex(bad)
    for bad in ("a -b", '-"a b"'):
        with pytest.raises(ValueError):
            lexical.validate_semantic(bad)
    lexical.validate_semantic("multi-agent is fine")


@pytest.mark.parametrize("word, want", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("relational", "relat"), ("generalizations", "gener"), ("sky", "sky"), ("happy", "happi"), ("roll", "roll"), ("controlling", "control"), ("is", "is"), ("été", "été")])
def test_stems(word, want):
    assert stem(word) == want


FILES = "file string, filepath string, title string, body string, rank int, score double"


def files(spark, rows):
    return spark.createDataFrame([(f"f{i}", f"c/f{i}.md", t, b, 1, 0.5) for i, (t, b) in enumerate(rows)], FILES)


def test_title_beats_body(spark):
    rows = [("harbour", "x " * 20), ("other", "harbour harbour harbour " + "x " * 20), (None, None), ("", ""), ("z", "y " * 30)]
    out = lexical.search(files(spark, rows), [("q", "harbour")]).orderBy("rank").collect()
    assert [r["file"] for r in out] == ["f0", "f1"] and 0 < out[1]["score"] < out[0]["score"] < 1


def test_phrases_prefixes_exclusions(spark):
    rows = [("a", "machine learning is fun"), ("b", "learning machine"), ("c", "machines that learn"), ("d", "Étude of machine-learning and sports")]
    ask = lambda q, **k: {r["file"] for r in lexical.search(files(spark, rows), [("q", q)], **k).collect()}
    assert ask('"machine learning"') == {"f0", "f3"} and ask("machine") == {"f0", "f1", "f2", "f3"} and ask("machine-learning -sport") == {"f0"}
    assert ask("etude") == {"f3"} and ask("machine absent") == set() and ask("machine absent", any_clause=True) == {"f0", "f1", "f2", "f3"} and ask("-machine") == set()
    assert ask('"machine learn"', stems=True) == {"f0", "f3"} and ask("x") == set()
    assert lexical.search(files(spark, rows).limit(0), [("q", "machine")]).count() == 0


def test_bm25_formula(spark):
    r = random.Random(1)
    rows = [(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 4))), " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 30)))) for _ in range(40)]
    got = {x["file"]: x["bm25"] for x in lexical.search(files(spark, rows), [("q", '"a" "b"')], None).collect()}
    docs = {f"f{i}": (["c", f"f{i}", "md"], t.split(), b.split()) for i, (t, b) in enumerate(rows)}
    size = {f: sum(map(len, d)) for f, d in docs.items()}
    avg, want = sum(size.values()) / len(size), {}
    tf = {t: {f: sum(w * col.count(t) for w, col in zip((1.5, 4, 1), d)) for f, d in docs.items()} for t in "ab"}
    for f in docs:
        if tf["a"][f] and tf["b"][f]:
            want[f] = 0
            for t in "ab":
                n = sum(1 for v in tf[t].values() if v)
                idf = max(math.log((len(docs) - n + 0.5) / (n + 0.5)), 1e-6)
                want[f] += idf * tf[t][f] * 2.2 / (tf[t][f] + 1.2 * (0.25 + 0.75 * size[f] / avg))
    assert got.keys() == want.keys() and all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_nearest_equals_brute_force(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    x[5] = 0
    bad = [(900, [1.0] * 7), (901, [float("nan")] * 8), (902, None)]
    v = spark.createDataFrame([(i, [float(a) for a in row]) for i, row in enumerate(x)] + bad, "vec_id long, embedding array<double>")
    q = v.filter("vec_id % 50 = 0 or vec_id > 899").withColumnRenamed("vec_id", "query_id")
    u = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
    for block in (2, 100):
        out = vector.nearest(v, q, 7, dims=8, block=block).collect()
        assert {r["query_id"] for r in out} == set(range(0, 300, 50))
        for i in range(0, 300, 50):
            want = set(np.argsort(1 - u @ u[i], kind="stable")[:7].tolist())
            assert {r["vec_id"] for r in out if r["query_id"] == i} == want
    assert vector.nearest(v.limit(0), q, 7, dims=8).count() == 0 and vector.nearest(v, q.limit(0), 7, dims=8).count() == 0


def test_fusion_worked_value_and_trace(spark):
    lists = spark.createDataFrame([(0, 1, "a", 1, 2.0), (0, 1, "b", 2, 2.0), (0, 2, "b", 1, 1.0), (0, 2, "a", 2, 1.0)], "q int, list_id int, file string, rank int, weight double")
    out = {r["file"]: r["rrf"] for r in fusion.fuse(lists, ["q"]).collect()}
    assert out["a"] == pytest.approx(2 / 61 + 1 / 62 + 0.05) and out["b"] == pytest.approx(2 / 62 + 1 / 61 + 0.05) and out["a"] > out["b"]
    trace = {r["file"]: r["total_score"] for r in fusion.fusion_trace(lists, ["q"]).collect()}
    assert all(trace[f] == pytest.approx(out[f]) for f in out)
    assert fusion.fuse(lists.limit(0), ["q"]).count() == 0


def test_blend_and_signal(spark):
    rows = spark.createDataFrame([(1, 0.5), (3, 0.5), (4, 0.5), (10, 0.5), (11, 0.5)], "rank int, s double")
    got = [r[0] for r in rows.select(fusion.blend(F.col("rank"), F.col("s"))).collect()]
    assert got == pytest.approx([0.75 + 0.125, 0.25 + 0.125, 0.15 + 0.2, 0.06 + 0.2, 0.4 / 11 + 0.3])
    top = spark.createDataFrame([("x", "a", 0.9), ("x", "b", 0.7), ("y", "a", 0.9), ("y", "b", 0.8), ("z", "a", 0.86)], "q string, file string, score double")
    assert {r["q"]: r["strong"] for r in fusion.strong_signal(top, ["q"], "score").collect()} == {"x": True, "y": False, "z": True}


def test_breaks_and_fences():
    text = "a\n# one\nb\n## two\n```\n# no\n```\n\n- x\n1. y\n---\nend"
    at, scores = chunks.break_points(text)
    found = {text[p : p + 5]: s for p, s in zip(at, scores)}
    assert found["\n# on"] == 100 and found["\n## t"] == 90 and found["\n```\n"] == 80 and found["\n---\n"] == 60 and found["\n- x\n"] == 5 and found["\n\n- x"] == 20
    assert [text[a:b] for a, b in chunks.fences(text)] == ["\n```\n# no\n```"]
    assert chunks.fences("```\nopen at the start")  == [] and chunks.fences("x\n```\nopen") == [(1, 10)]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab #\n`-1.", max_size=900))
def test_chunks_cover(text):
    out = chunks.chunk_text(text, 100, 15, 25)
    assert out[0][0] == 0 and out[-1][0] + len(out[-1][1]) == len(text)
    for (p, c), (q, _) in zip(out, out[1:]):
        assert p < q <= p + len(c) <= q + 15 and len(c) <= 100
    assert all(text[p : p + len(c)] == c for p, c in out)


def test_chunk_at_heading_and_tokens():
    text = "x" * 3000 + "\n# head\n" + "y" * 3000
    assert chunks.chunk_text(text)[0][1] == "x" * 3000
    assert all(n <= 100 for *_, n in chunks.chunk_by_tokens("a b " * 3000, 100, 15, 20)) and chunks.count_tokens("ab12, c") == 4
    code = "import os\n\n\ndef a():\n    pass\n\n\nclass B:\n    pass\n"
    assert sorted(syntax.python_breaks(code).values()) == [90.0, 100.0] and syntax.python_breaks("def (") == {}


def test_snippets(spark):
    def snippet(body, query, pos=None, **o):
        df = spark.createDataFrame([(body, query, pos)], "body string, query string, pos int")
        out = df.select(snippets(F.col("body"), F.col("query"), chunk_pos=F.col("pos"), **o).alias("s")).first()["s"]
        return out and out.asDict()

    body = "one\ntwo\nthree target\nfour\nfive\nsix"
    s = snippet(body, "target")
    assert s["line"] == 3 and s["snippet"] == "@@ -2,4 @@ (1 before, 1 after)\ntwo\nthree target\nfour\nfive" and s["lines_after"] == 1 and s["snippet_lines"] == 4
    assert snippet(body, "nothing here")["line"] == 1 and snippet("", "x")["line"] == 1 and snippet(body, None)["line"] == 1 and snippet(None, "x") is None
    assert snippet("a " * 600, "a")["snippet"].endswith("...") and snippet(body, "zz", intent="the five")["line"] == 5
    assert snippet(body, "SIX")["snippet"] == "@@ -5,2 @@ (4 before, 0 after)\nfive\nsix"
    assert snippet("x\n" * 200 + "target\n" + "y\n" * 200, "target", 380)["line"] == 201
    # A chunk that shows only blanks: the whole text is searched.
    assert snippet("target\n" + "\n" * 6000, "target", 3000, chunk_len=1000)["line"] == 1
    assert intent_terms("What is the (API) of SQL, please?") == ["api", "sql", "please"]


def test_numbered(spark):
    assert spark.createDataFrame([("a\nb",)], "t string").select(numbered_lines(F.col("t"), 5)).first()[0] == "5: a\n6: b"


RES, EXP = "query_id string, file string, rank int", "query_id string, file string"


def scores(spark, results, expected, k=3, **o):
    r = spark.createDataFrame([("q", f, i) for i, f in enumerate(results, 1)], RES)
    e = spark.createDataFrame([("q", f) for f in expected], EXP)
    out = metrics.score_results(r, e, k, **o).collect()
    return tuple(round(out[0][c], 6) for c in ("precision_at_k", "recall", "mrr", "f1")) if out else None


def test_scores(spark):
    assert scores(spark, ["a", "b", "c"], ["a"]) == (1, 1, 1, 1)
    assert scores(spark, ["x", "a", "y", "b"], ["A", "/b/"]) == (0.5, 1, 0.5, round(2 * 0.5 / 1.5, 6))
    assert scores(spark, ["x"], ["a"]) == (0, 0, 0, 0) and scores(spark, [], ["a"]) == (0, 0, 0, 0) and scores(spark, ["a"], []) == (0, 0, 0, 0)
    assert scores(spark, ["lode://c/dir/a.md"], ["a.md"], suffixes=True) == (1, 1, 1, 1) and scores(spark, ["lode://c/dir/a.md"], ["dir/a.md"]) == (1, 1, 1, 1)


def test_rank_quality_and_spearman(spark):
    r = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 7)], RES)
    e = spark.createDataFrame([("q", "a"), ("q", "b"), ("p", "z")], EXP)
    out = {x["query_id"]: x for x in metrics.rank_quality(r, e, 5).collect()}
    assert out["q"]["mrr"] == 0.5 and out["q"]["ndcg_at_k"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and out["p"]["ndcg_at_k"] == 0
    s = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 4.0), ("k", 3.0, 5.0), ("k", None, 1.0)], "k string, a double, b double")
    assert metrics.spearman(s, "k", "a", "b").first()["spearman"] == pytest.approx(1.0)


def test_expansion_scores(spark):
    p = spark.createDataFrame([("q", "lex", "red harbour ferry"), ("q", "lex", "unrelated thing"), ("q", "vec", "how to paint")], "query_id string, type string, text string")
    g = spark.createDataFrame([("q", "lex", "the red harbour ferry"), ("q", "lex", "blue bridge")], "query_id string, type string, text string")
    out = {r["type"]: r for r in metrics.expansion_scores(p, g, 0.4).collect()}
    assert (out["lex"]["precision"], out["lex"]["recall"]) == (0.5, 0.5) and out["vec"]["precision"] == 0 and out["overall"]["precision"] == pytest.approx(1 / 3)


SOURCES = {
    "a.ts": (
        "import x from 'y';\n// class No {}\n@deco\nexport class A extends B {\n  private async run(a: number): Promise<void> {\n    if (a) { call(a); }\n    for (const x of y) {\n    }\n  }\n  get size() {\n    return 1;\n  }\n}\ninterface I {\n  a: string;\n}\n"
        "export type T = string | number;\nenum E { A }\nconst f = async (a) => {\n  return `class X {`;\n};\nexport default function g() {}\nconst plain = 3;\nconst call2 = g();\n",
        {"@deco": 100, "  private async run": 90, "  get size": 90, "interface I": 100, "export type": 90, "enum E": 80, "const f": 90, "export default": 90},
    ),
    "b.go": ("package a\n\nimport (\n\t\"fmt\"\n)\n\n/* func no() {} */\ntype S struct {\n\ta int\n}\n\nfunc (s *S) run() {\n\tx := `func no() {`\n}\n", {"import": 60, "type S": 80, "func (s": 90}),
    "c.rs": (
        "use std::io;\npub(crate) mod m {\n    #[derive(Debug)]\n    pub struct S<'a> { x: &'a str }\n    impl<'a> S<'a> {\n        pub async fn run(&self) -> char { '{' }\n    }\n}\npub trait T {}\nenum E { A }\ntype X = u8;\nconst fn k() {}\nlet s = r#\"fn no() {\"#;\n",
        {"pub(crate) mod": 100, "    #[derive": 100, "    impl<": 100, "        pub async fn": 90, "pub trait": 100, "enum E": 80, "type X": 80, "const fn": 90},
    ),
}


@pytest.mark.parametrize("name", sorted(SOURCES))
def test_declarations(name):
    text, want = SOURCES[name]
    got = syntax.breaks_for(name)(text)
    assert {text[p + 1 :].split("\n")[0]: s for p, s in got.items()} == {next(x for x in text.split("\n") if x.startswith(w)): s for w, s in want.items()}
    assert syntax.breaks_for("a.md") is None and syntax.breaks_for(None) is None and syntax.language_of("x/Y.TSX") == "script" and syntax.breaks_for(name)("{{{ \x00 '") == {}


def test_strategies(spark):
    body = "".join(f"function f{i}() {{\n{'  call();' * 12}\n\n{'  call();' * 12}\n}}\n" for i in range(40))
    df = spark.createDataFrame([("a", body, "x/a.js"), ("b", body, None), ("c", body, "a.md")], "k string, t string, p string")
    auto = chunks.chunk_documents(df, "k", "t", strategy="auto", path="p").collect()
    plain = chunks.chunk_documents(df, "k", "t", path="p").collect()
    ends = {k: {r["pos"] + len(r["chunk"]) for r in auto if r["key"] == k} for k in "abc"}
    assert all(body[e : e + 10].startswith("\nfunction") for e in ends["a"] if e < len(body)) and ends["b"] == ends["c"] != ends["a"]
    assert sorted((r["key"], r["pos"]) for r in plain if r["key"] == "a") == sorted(("a", r["pos"]) for r in auto if r["key"] == "b")
    with pytest.raises(ValueError):
        chunks.chunk_documents(df, "k", "t", strategy="tree")


def test_folding(spark):
    words = ["Ệnghỉ", "Άλφα", "йод", "Ångström", "e\u0301te\u0301", "naïve", "ß", "한글", "ﬁ"]
    got = [r["x"] for r in spark.createDataFrame([(w,) for w in words], "t string").select(lexical.fold(F.col("t")).alias("x")).collect()]
    assert got == ["enghi", "αλφα", "иод", "angstrom", "ete", "naive", "ß", "한글", "ﬁ"]


def test_lines_and_windows(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("a",), (None,)], "t string")
    assert [r[0] for r in df.select(lookup.first_lines(F.col("t"), 2)).collect()] == ["a\nb\n\n[... truncated 1 more lines]", "a", None]
    assert models.within_window("one two, three four five six", 6) == "one two" and models.within_window("one two", 6) == "one two" and models.within_window("x", None) == "x"
    assert models.token_batches([5, 1, 50, 2, 4], 12, 3) == [[1, 3, 4], [0], [2]] and models.token_batches([], 5, 5) == []
    o = models.resolve_encoder_options({"dims": 8}, {"LODE_EMBED_BACKEND": "REMOTE", "LODE_EMBED_DIMS": "16", "LODE_EMBED_TIMEOUT_MS": "-3", "LODE_EMBED_PORT": "9000"})
    assert (o["dims"], o["backend"], o["timeout_ms"], o["url"], o["fail_closed"], o["binary"]) == (8, "remote", 30_000, "http://127.0.0.1:9000", True, True)
    assert models.resolve_encoder_options()["backend"] == "local" and models.resolve_encoder_options({"binary": False})["binary"] is False


def test_neighbours_in_blocks(spark, monkeypatch):
    """Ties and several blocks of vectors, against brute force."""
    monkeypatch.setattr(vector, "ROWS", 7)
    r = np.random.default_rng(3)
    x = r.integers(-1, 2, size=(60, 4)).astype(float)  # many equal directions, some zero vectors
    rows = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)], "vec_id long, embedding array<double>")
    got = vector.nearest(rows, rows.select(F.col("vec_id").alias("query_id"), "embedding"), 5, 4).collect()
    n = np.sqrt((x * x).sum(1))
    u = x / np.where(n > 0, n, 1)[:, None]
    d = 1 - u @ u.T
    d[:, n == 0] = 1
    want = {(q, int(i)) for q in range(60) for i in np.lexsort((np.arange(60), np.round(d[q], 12)))[:5]}
    assert {(g["query_id"], g["vec_id"]) for g in got} == want


def test_cells(spark):
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(1, 16)) + 0.3 * r.normal(size=(300, 16)), r.normal(size=(200, 16))])
    rows = spark.createDataFrame([(i, [float(v) for v in y]) for i, y in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [1.0])], "vec_id long, embedding array<double>")
    asked = rows.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = {(g["query_id"], g["vec_id"]) for g in vector.nearest(rows, asked, 10, 16).collect() if g["query_id"] < 900}
    near = {(g["query_id"], g["vec_id"]) for g in vector.near_by_cells(rows, asked, 10, 16, n_cells=12, probes=6, per_block=50).collect()}
    assert len(near & exact) / len(exact) >= 0.9 and len(near) == 10 * len({q for q, _ in near})
    assert vector.near_by_cells(rows.limit(0), asked, 10, 16).count() == 0
