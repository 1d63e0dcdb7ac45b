"""Keyword search: query grammar, postings, matching and BM25.

The score of a row is the sum over the positive clauses of ``idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len / avglen))`` with
``k1 = 1.2`` and ``b = 0.75``; ``tf`` weighs a hit in the file path 1.5, in the title 4 and in the body 1; ``len`` counts the tokens of
the row; ``idf = ln((N - n + 0.5) / (n + 0.5))``, at least 1e-6. All positive clauses must occur, in any column, and no negative one may.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.stem import stem, stemmed
from lodespark.session import cut_lineage, spread

K1, B = 1.2, 0.75
WEIGHTS = {"filepath": 1.5, "title": 4.0, "body": 1.0}
_BROADCAST_TERMS = 200_000



def _folds() -> tuple[str, str]:
    """All letters that decompose into a letter and marks, with those letters; then the marks themselves, which have no counterpart and vanish."""
    parts = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xC0, 0xAC00), *range(0xF900, 0xFB50)])]
    whole = [(c, d[0]) for c, d in parts if len(d) > 1 and unicodedata.category(c)[0] == "L" and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    marks = "".join(c for c in map(chr, range(0x300, 0x370)) if unicodedata.category(c) == "Mn")
    return "".join(c for c, _ in whole) + marks, "".join(d for _, d in whole)


_FROM, _TO = _folds()
_FOLDED = str.maketrans(_FROM[: len(_TO)], _TO, _FROM[len(_TO) :])


@dataclass(frozen=True)
class Clause:
    terms: tuple[str, ...]
    prefix: bool
    negative: bool


def plain_term(term: str) -> str:
    """Letters, digits, apostrophes and underscores, in lower case."""
    return "".join(c for c in term if c in "'_" or unicodedata.category(c)[0] in "LN").lower()


_INNER_HYPHEN = re.compile(r"[^\W_][^\W_]*(?:['-][^\W_]*)*-[^\W_](?:[^\W_]|['-])*")
_PART = re.compile(r'\s*(-?)(?:"([^"]*)"?|([^\s"]+))')


def parse_lex(query: str) -> list[Clause]:
    """Clauses of a lex query: ``word`` is a prefix, ``"a phrase"`` and ``hy-phened`` words are phrases, ``-`` excludes. Without a positive clause there is none."""
    out, at, text = [], 0, query.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m.end() == at:
            at += 1
            continue
        at = m.end()
        minus, phrase, word = m.groups()
        if phrase is not None:
            parts, prefix = phrase.split(), False
        elif _INNER_HYPHEN.fullmatch(word):
            parts, prefix = word.split("-"), False
        else:
            parts, prefix = [word], True
        terms = tuple(t for t in map(plain_term, parts) if t)
        if terms:
            out.append(Clause(terms, prefix, bool(minus)))
    return out if any(not c.negative for c in out) else []


def match_string(query: str) -> str | None:
    """The clauses in the notation of full-text engines, for logs and explanations."""
    clauses = parse_lex(query)
    show = lambda c: '"' + " ".join(c.terms) + '"' + "*" * c.prefix
    if not clauses:
        return None
    return " NOT ".join([" AND ".join(show(c) for c in clauses if not c.negative), *(show(c) for c in clauses if c.negative)])


def validate_lex(query: str) -> None:
    if "\n" in query or "\r" in query:
        raise ValueError("a lex query has one line; give each line its own lex:")
    if query.count('"') % 2:
        raise ValueError('a lex query has an unmatched double quote (")')


def validate_semantic(query: str) -> None:
    if re.search(r'(?:^|\s)-[\w"]', query):
        raise ValueError("vec and hyde queries can't exclude terms; use a lex query")


def fold(text: Column) -> Column:
    """Lower case without marks on letters."""
    return F.lower(F.translate(text, _FROM, _TO))


def terms_of(text: Column) -> Column:
    """Runs of letters and digits of a folded text."""
    return F.array_remove(F.split(fold(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _term_rows(docs: DataFrame, stems: bool) -> DataFrame:
    """``file, len`` and the terms of the three columns as ``cols``: an array of ``col, weight, terms``."""
    own = {c: stemmed(terms_of(F.col(c))) if stems else terms_of(F.col(c)) for c in WEIGHTS}
    rows = docs.select("file", *[x.alias(c) for c, x in own.items()])
    cols = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(w).alias("weight"), F.col(c).alias("terms")) for c, w in WEIGHTS.items()])
    return rows.select("file", sum((F.size(c) for c in WEIGHTS), F.lit(0)).alias("len"), cols.alias("cols"))


def postings(docs: DataFrame, stems: bool = False) -> DataFrame:
    """``file, len, col, weight, pos, term`` from ``docs(file, filepath, title, body)``, where ``len`` counts the tokens of the row. Write it partitioned by a hash of the term to serve many searches."""
    rows = _term_rows(docs, stems).select("file", "len", F.explode("cols").alias("c"))
    return rows.select("file", "len", "c.col", "c.weight", F.posexplode("c.terms").alias("pos", "term"))


def _patterns(queries: list[tuple[str, str]], stems: bool) -> tuple[list, list]:
    """Rows ``pattern, size, prefix, offset, want`` of the distinct clauses, and rows ``query_id, pattern, negative, need`` of the queries."""
    known: dict[tuple, int] = {}
    uses = []
    for qid, text in queries:
        own = []
        for c in parse_lex(text):
            terms = tuple(
                stem(t) if stems else t for term in c.terms for t in re.findall(r"[^\W_]+", term.translate(_FOLDED).lower())
            )
            if terms:
                own.append((known.setdefault((terms, c.prefix), len(known)), c.negative))
        need = sum(not negative for _, negative in own)
        uses += [(qid, p, negative, need) for p, negative in own if need]
    rows = [(n, len(terms), prefix and i == len(terms) - 1, i, t) for (terms, prefix), n in known.items() for i, t in enumerate(terms)]
    return rows, uses


def matching(docs: DataFrame, queries: list[tuple[str, str]], stems: bool = False, any_clause: bool = False) -> DataFrame:
    """``query_id, file, bm25`` of all rows that match, in no order.

    Two passes over the rows: the first for the words there are, and the number of rows and tokens; the second for the hits of those words that
    a query asks for. Equal clauses of many queries are matched once, and only hits of wanted words are shuffled. Hits by clause are counted
    by a partial aggregate, so that a frequent clause passes through no single task.
    """
    spark = docs.sparkSession
    rows, uses = _patterns(queries, stems)
    patterns = spark.createDataFrame(rows, "pattern int, size int, prefix boolean, offset int, want string")
    names = [q for q, _ in queries]
    number = {q: i for i, q in enumerate(names)}
    use = spark.createDataFrame([(number[q], *rest) for q, *rest in uses], "q int, pattern int, negative boolean, need int")
    ids = F.broadcast(spark.createDataFrame(list(enumerate(names)), "q int, query_id string"))
    docs = spread(docs, "file")
    # Each row adds a null word of its own, under which rows and tokens are counted.
    every = _term_rows(docs, stems).select("len", F.explode(F.concat(F.flatten(F.transform("cols", lambda c: c["terms"])), F.array(F.lit(None).cast("string")))).alias("term"))
    words = every.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("term").isNull(), F.col("len"))).alias("len"))
    exact = words.join(F.broadcast(patterns.filter("not prefix")), F.col("term") == F.col("want"))
    lens = sorted({len(r[4]) for r in rows if r[2]})
    heads = words.filter("term is not null").select("term", F.explode(F.array(*[F.substring("term", 1, n) for n in lens]) if lens else F.array().cast("array<string>")).alias("want")).distinct()
    starts = heads.join(F.broadcast(patterns.filter("prefix")), "want")
    columns = ["term", "pattern", "size", "offset"]
    none = F.lit(0).cast("long")
    found = exact.select(*columns, none.alias("n"), none.alias("len")).unionByName(starts.select(*columns, none.alias("n"), none.alias("len"))).distinct()
    total = words.filter("term is null").select("term", F.lit(-1).alias("pattern"), F.lit(0).alias("size"), F.lit(0).alias("offset"), "n", F.coalesce("len", none).alias("len"))
    found = cut_lineage(found.unionByName(total))
    sizes = found.filter("pattern = -1").select("n", "len").first()
    n_total, n_tokens = (sizes["n"], sizes["len"]) if sizes else (0, 0)
    wanted = found.filter("pattern >= 0").select(*columns)
    small = F.broadcast if wanted.count() <= _BROADCAST_TERMS else (lambda df: df)
    hits = postings(docs, stems).join(small(wanted), "term")
    single = hits.filter("size = 1").groupBy("pattern", "file", "len").agg(F.sum("weight").alias("tf"))
    # A place holds one term, so a phrase is there if as many of its terms are as it has.
    place = hits.filter("size > 1").groupBy("pattern", "size", "file", "len", "col", "weight", (F.col("pos") - F.col("offset")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    phrase = place.filter("n = size").groupBy("pattern", "file", "len").agg(F.sum("weight").alias("tf"))
    tf = single.unionByName(phrase)
    per_pattern = F.broadcast(tf.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))  # one row a clause of the queries
    idf = F.greatest(F.log((F.lit(float(n_total)) - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(n_tokens / n_total if n_tokens else 1.0)))
    per_clause = tf.join(per_pattern, "pattern").select("pattern", "file", part.alias("part")).join(F.broadcast(use), "pattern")
    per_query = per_clause.groupBy("q", "file").agg(
        F.sum(F.when(~F.col("negative"), F.col("part")).otherwise(0.0)).alias("bm25"), F.sum((~F.col("negative")).cast("int")).alias("have"), F.max("negative").alias("excluded"), F.max("need").alias("need")
    )
    kept = per_query.filter((~F.col("excluded")) & (F.col("have") >= (F.lit(1) if any_clause else F.col("need"))))
    return kept.join(ids, "q").select("query_id", "file", "bm25")


def search(docs: DataFrame, queries: list[tuple[str, str]], limit: int | None = 20, stems: bool = False, any_clause: bool = False) -> DataFrame:
    """``query_id, file, bm25, score, rank`` of the best rows for each query.

    ``docs``: ``file`` (unique), ``filepath, title, body`` (any may be null), already filtered to the wanted collections, so that a small
    collection is never starved by a large one. ``any_clause`` asks for at least one clause instead of all. ``score`` is
    ``x / (1 + x)``. Ties go by file.
    """
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("bm25", 9).desc(), "file"))
    kept = matching(docs, queries, stems, any_clause).withColumn("rank", rank)
    kept = kept if limit is None else kept.filter(F.col("rank") <= limit)
    return kept.select("query_id", "file", "bm25", score_map(F.col("bm25")).alias("score"), "rank")


def score_map(x: Column) -> Column:
    return F.abs(x) / (1 + F.abs(x))
