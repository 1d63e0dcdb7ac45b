"""Registered queries: keyword search, nearest neighbours, fusion, chunks and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespark.functions.snippet import snippets
from lodespark.operators import chunks, expansion_reward, fusion, lexical, metrics, models, vector
from lodespark.operators.store import bodies
from lodespark.session import table
from lodespark.sources import training

QUERY_LIMIT = 10_000


def _files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("doc_id is not null")
    return rows.select(F.col("doc_id").alias("file"), F.concat_ws("/", "collection", "path").alias("filepath"), "title", F.col("text").alias("body"))


def _lex_queries(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """Three forms of each evaluation query: two prefixes, a phrase, an exclusion. The evaluation set has a fixed size, which is checked."""
    rows = table(spark, d, "eval_items").select("item_id", F.split(F.lower("query"), " ").alias("w")).filter("size(w) >= 3").limit(QUERY_LIMIT + 1).collect()
    if len(rows) > QUERY_LIMIT:
        raise ValueError("too many queries for one call")
    return [(f"{r['item_id']}{kind}", form.format(*r["w"])) for r in rows for kind, form in (("a", "{1} {2}"), ("p", '"{1} {2}"'), ("n", "{1} -{2}"), ("s", "{0}"))]


def l9_bm25(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.search(_files(spark, d), _lex_queries(spark, d), limit=20)
    return hits.select("query_id", "file", F.round("bm25", 6).alias("bm25"), F.round("score", 6).alias("score"), "rank")


def l1_stemmed_bm25(spark: SparkSession, d: str) -> DataFrame:
    """With stems, and any clause instead of all."""
    hits = lexical.search(_files(spark, d), _lex_queries(spark, d), limit=10, stems=True, any_clause=True)
    return hits.select("query_id", "file", F.round("score", 6).alias("score"), "rank")


def l6_matches(spark: SparkSession, d: str) -> DataFrame:
    """How many rows match each query, in full."""
    return lexical.matching(_files(spark, d), _lex_queries(spark, d)).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def l1_term_counts(spark: SparkSession, d: str) -> DataFrame:
    posts = lexical.postings(_files(spark, d))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _neighbours(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    v = _vectors(spark, d)
    return vector.nearest(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), k)


def v1_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _neighbours(spark, d).select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def v8_recall_of_cells(spark: SparkSession, d: str) -> DataFrame:
    """The approximate neighbours against the exact ones: whether nine of ten are found."""
    v = _vectors(spark, d)
    exact = _neighbours(spark, d)
    near = vector.near_by_cells(v, v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)
    both = exact.select("query_id", "vec_id").join(near.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("n_queries"), (F.avg(F.coalesce("hit", F.lit(0))) >= 0.9).alias("nine_of_ten"))


def v2_nearest_in_label(spark: SparkSession, d: str) -> DataFrame:
    """Filtered to one collection (here a label) before the search."""
    v = _vectors(spark, d)
    out = vector.nearest(v.filter("label = 3"), v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return out.select("query_id", "vec_id", F.round("distance", 6).alias("distance"))


def v3_v4_best_by_label(spark: SparkSession, d: str) -> DataFrame:
    hits = _neighbours(spark, d, 20).join(_vectors(spark, d).select("vec_id", "label"), "vec_id")
    best = vector.nearest_by(hits, "label")
    return best.select("query_id", "label", F.round("distance", 6).alias("distance"), F.round(vector.cosine_score(F.col("distance")), 6).alias("score"))


def v7_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Several vectors of one query: the best score of each hit, from 0.3 on, the first ten."""
    hits = _neighbours(spark, d, 20).select((F.col("query_id") % 3).alias("q"), "vec_id", vector.cosine_score(F.col("distance")).alias("score"))
    out = fusion.final_results(hits.withColumn("score", F.round("score", 9)), ["q"], "vec_id", "score", 0.3, 10)
    return out.select("q", "vec_id", F.round("score", 6).alias("score"), "rank")


def v9_normalised(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d).select("vec_id", vector.normalised(F.col("embedding"), 16).alias("unit"))
    return v.select("vec_id", F.round(F.col("unit")[0], 6).alias("first"), F.round(F.col("unit")[15], 6).alias("last"), F.round(vector.norm(F.col("unit")), 6).alias("norm"))


def v10_recall_at_1(spark: SparkSession, d: str) -> DataFrame:
    """How often the nearest other vector has the label of the query."""
    v = _vectors(spark, d).select("vec_id", "label")
    hits = _neighbours(spark, d, 2).filter("query_id <> vec_id")
    first = hits.groupBy("query_id").agg(F.min_by("vec_id", F.struct(F.round("distance", 12), "vec_id")).alias("vec_id"))
    named = first.join(v.withColumnRenamed("label", "found"), "vec_id").join(v.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    return named.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("label") == F.col("found")).cast("double")), 6).alias("recall_at_1"))


def _ranked_lists(spark: SparkSession, d: str) -> DataFrame:
    """Four ranked lists a source: by length, by date, by title, by path; 20 rows each."""
    rows = table(spark, d, "documents").filter("source is not null").select("source", F.col("doc_id").alias("file"), "n_chars", "modified_at", "title", "path")
    orders = (("original", F.col("n_chars").desc_nulls_last()), ("original", F.col("modified_at").desc_nulls_last()), ("lex", F.col("title").asc_nulls_last()), ("vec", F.col("path").asc_nulls_last()))
    out = None
    for i, (kind, order) in enumerate(orders, 1):
        w = Window.partitionBy("source").orderBy(order, "file")
        part = rows.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select("source", F.lit(i).alias("list_id"), F.lit(kind).alias("query_type"), "file", "rank")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("weight", fusion.list_weight(F.lit("any"), F.col("query_type"), F.col("list_id")))


def h5_h8_fusion(spark: SparkSession, d: str) -> DataFrame:
    fused = fusion.fuse(_ranked_lists(spark, d), ["source"])
    top = fusion.ranked(fused.withColumn("rrf", F.round("rrf", 9)), ["source"], "rrf", "file").filter(F.col("rank") <= fusion.CANDIDATES)
    return top.select("source", "file", F.round("rrf", 6).alias("rrf"), "top_rank", "rank")


def h6_compat_weights(spark: SparkSession, d: str) -> DataFrame:
    lists = _ranked_lists(spark, d).withColumn("weight", fusion.list_weight(F.lit("any"), F.col("query_type"), F.col("list_id"), compat=True))
    return fusion.fuse(lists, ["source"]).select("source", "file", F.round("rrf", 6).alias("rrf"))


def h7_trace(spark: SparkSession, d: str) -> DataFrame:
    t = fusion.fusion_trace(_ranked_lists(spark, d), ["source"])
    shown = F.array_join(F.transform("contributions", lambda x: F.concat_ws(":", x["list_id"], x["rank"])), " ")
    return t.select("source", "file", shown.alias("contributions"), F.round("base_score", 6).alias("base_score"), "top_rank_bonus", F.round("total_score", 6).alias("total_score"))


def h13_h16_blend(spark: SparkSession, d: str) -> DataFrame:
    """The fused ranks blended with a reranker's score (here a ratio that depends on the file alone), from 0.2 on, the first ten."""
    fused = h5_h8_fusion(spark, d).withColumn("rerank", (F.col("file") * 37 % 101) / 100.0)
    scored = fused.select("source", "file", F.round(fusion.blend(F.col("rank"), F.col("rerank")), 9).alias("score"))
    out = fusion.final_results(scored, ["source"], "file", "score", 0.2, 10)
    return out.select("source", "file", F.round("score", 6).alias("score"), "rank")


def h11_h16_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The fused ranks of each source blended with the scores of the stand-in reranker, for one query over the texts; from 0.2 on, the first ten."""
    fused = h5_h8_fusion(spark, d).select("source", "file", "rank")
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("file"), F.coalesce("text", F.lit("")).alias("chunk"))
    pairs = fused.select("file").distinct().join(texts, "file").withColumn("query", F.lit("the owner of the schedule, and why"))
    scores = models.rerank(pairs, models.OverlapScorer()).select("file", F.col("score").alias("rerank"))
    scored = fused.join(scores, "file").select("source", "file", F.round(fusion.blend(F.col("rank"), F.col("rerank")), 9).alias("score"))
    out = fusion.final_results(scored, ["source"], "file", "score", 0.2, 10)
    return out.select("source", "file", F.round("score", 6).alias("score"), "rank")


def h14_rank_scores(spark: SparkSession, d: str) -> DataFrame:
    return h5_h8_fusion(spark, d).select("source", "file", F.round(1 / F.col("rank"), 6).alias("score"))


def h1_strong_signal(spark: SparkSession, d: str) -> DataFrame:
    hits = lexical.search(_files(spark, d), _lex_queries(spark, d), limit=2)
    return fusion.strong_signal(hits.select("query_id", "file", "score"), ["query_id"], "score")


def c4_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_documents(bodies(table(spark, d, "content")), "hash", "doc").select("key", "seq", "pos", "n_tokens", F.char_length("chunk").alias("n_chars"))


def c5_token_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.chunk_documents(bodies(table(spark, d, "content")), "hash", "doc", by_tokens=True).select("key", "seq", "pos", "n_tokens", F.char_length("chunk").alias("n_chars"))


def _checked(spark: SparkSession, d: str, by_tokens: bool, overlap: int, most: int) -> DataFrame:
    own = bodies(table(spark, d, "content")).filter("doc is not null").select("hash", "doc")
    made = chunks.chunk_documents(own, "hash", "doc", by_tokens=by_tokens).withColumn("n_chars", F.char_length("chunk"))
    made = made.withColumn("before", F.lag(F.col("pos") + F.col("n_chars")).over(Window.partitionBy("key").orderBy("seq")))  # of one text
    rows = made.join(own, F.col("key") == F.col("hash"))
    verbatim = F.substring("doc", F.col("pos") + 1, F.col("n_chars")) == F.col("chunk")
    joined = F.when(F.col("before").isNull(), F.col("pos") == 0).otherwise((F.col("pos") <= F.col("before")) & (F.col("pos") >= F.col("before") - overlap))
    out = rows.groupBy("hash").agg(
        F.max(F.char_length("doc")).alias("n_chars"), F.min(verbatim).alias("verbatim"), F.min(joined).alias("gapless"), F.max(F.col("pos") + F.col("n_chars")).alias("end"),
        F.min(F.col("n_tokens" if by_tokens else "n_chars") <= most).alias("within_limit"),
    )
    return out.select("hash", "n_chars", "verbatim", (F.col("gapless") & (F.col("end") == F.col("n_chars"))).alias("gapless"), "within_limit")


def c4_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each body: whether its chunks are verbatim, reach from end to end without a gap, and keep to the limit."""
    return _checked(spark, d, False, 540, 3600)


def c5_checked(spark: SparkSession, d: str) -> DataFrame:
    """The same of the chunks by tokens, of which none has more than 900."""
    return _checked(spark, d, True, 405, 900)


def c4_small_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Bodies within the limit are one chunk each."""
    one = chunks.chunk_documents(bodies(table(spark, d, "content")), "hash", "doc").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.char_length("chunk")).alias("n_chars"))
    return one.filter("n = 1").select(F.col("key").alias("hash"), "n_chars")


def h9_best_chunk(spark: SparkSession, d: str) -> DataFrame:
    parts = chunks.chunk_documents(bodies(table(spark, d, "content")), "hash", "doc")
    return chunks.best_chunk(parts, ["benchmark", "dashboard", "harbour"], ["copper"]).select("key", "seq", "pos", "chunk_score")


def h19_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("text is not null")
    return rows.select("doc_id", snippets(F.col("text"), F.coalesce("title", F.lit(""))).alias("s")).select("doc_id", "s.*")


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Results: the twenty longest texts of a source; expected: those in German or French, of the thirty newest."""
    lists = table(spark, d, "documents").filter("source is not null")
    w = Window.partitionBy("source").orderBy(F.col("n_chars").desc_nulls_last(), "doc_id")
    results = lists.withColumn("rank", F.row_number().over(w)).filter("rank <= 20").select(F.col("source").alias("query_id"), F.concat_ws("/", F.lit("lode://x"), "path").alias("file"), "rank")
    n = Window.partitionBy("source").orderBy(F.col("modified_at").desc_nulls_last(), "doc_id")
    expected = lists.withColumn("r", F.row_number().over(n)).filter("r <= 30 and lang in ('de', 'fr')").select(F.col("source").alias("query_id"), F.upper("path").alias("file"))
    return results, expected


def r1_r4_scores(spark: SparkSession, d: str) -> DataFrame:
    s = metrics.score_results(*_results(spark, d), k=10)
    return s.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall", "mrr", "f1")], "hits_at_k")


def a12_r10_averages(spark: SparkSession, d: str) -> DataFrame:
    results, expected = _results(spark, d)
    at_5 = metrics.score_results(results.filter("rank <= 5"), expected, k=5).withColumn("backend", F.lit("first five"))
    at_20 = metrics.score_results(results, expected, k=20).withColumn("backend", F.lit("all"))
    out = metrics.macro_average(at_5.unionByName(at_20), ["backend"])
    return out.select("backend", "n_queries", *[F.round(c, 6).alias(c) for c in ("precision_at_k", "recall", "mrr", "f1")])


def r6_rank_quality(spark: SparkSession, d: str) -> DataFrame:
    lists = _ranked_lists(spark, d)
    results = lists.filter("list_id = 1").select(F.col("source").alias("query_id"), "file", "rank")
    relevant = lists.filter("list_id = 2").select(F.col("source").alias("query_id"), "file")
    q = metrics.rank_quality(results, relevant, 5)
    return q.select("query_id", "hit_at_k", F.round("mrr", 6).alias("mrr"), F.round("ndcg_at_k", 6).alias("ndcg_at_k"))


def r7_expansion_scores(spark: SparkSession, d: str) -> DataFrame:
    """The items of each example at even places against those at odd places."""
    items = table(spark, d, "training_examples").filter("example_id is not null").groupBy("example_id").agg(F.max(F.struct("loaded_at", "output")).alias("x"))
    items = items.select(F.col("example_id").alias("query_id"), F.posexplode("x.output").alias("pos", "item")).select("query_id", "pos", "item.type", "item.text").filter("text is not null and type is not null")
    out = metrics.expansion_scores(items.filter("pos % 2 = 0").drop("pos"), items.filter("pos % 2 = 1").drop("pos"), 0.2)
    return out.select("type", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "pred_count", "golden_count", "matched")


def r8_expansion_rewards(spark: SparkSession, d: str) -> DataFrame:
    return expansion_reward.rewards(training.latest(table(spark, d, "training_examples")).select("example_id", "query", "output"))


def r8_format_and_hyde(spark: SparkSession, d: str) -> DataFrame:
    """Two parts of the reward: for the kinds of expansions there are, and for the passage."""
    return r8_expansion_rewards(spark, d).select("example_id", "format", "hyde")


def r9_spearman(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("source is not null and text is not null").select("source", F.col("n_chars").alias("a"), F.length(F.regexp_replace("text", "[^ ]", "")).alias("b"))
    return metrics.spearman(rows, "source", "a", "b").select("source", F.round("spearman", 6).alias("spearman"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        l9_bm25, l1_stemmed_bm25, l6_matches, l1_term_counts, v1_nearest, v8_recall_of_cells, v2_nearest_in_label, v3_v4_best_by_label, v7_multi_query, v9_normalised, v10_recall_at_1, h5_h8_fusion, h6_compat_weights,
        h7_trace, h13_h16_blend, h11_h16_reranked, h14_rank_scores, h1_strong_signal, c4_chunks, c5_token_chunks, c4_checked, c5_checked, c4_small_bodies, h9_best_chunk, h19_snippets, r1_r4_scores, a12_r10_averages, r6_rank_quality,
        r7_expansion_scores, r8_expansion_rewards, r8_format_and_hyde, r9_spearman,
    )
}

_POSTS = r"""F AS (SELECT doc_id AS file, concat_ws('/', collection, path) AS filepath, coalesce(title, '') AS title, coalesce(text, '') AS body FROM documents WHERE doc_id IS NOT NULL),
L AS (SELECT file, unnest(['filepath', 'title', 'body']) AS col, unnest([1.5, 4.0, 1.0]) AS weight, unnest([filepath, title, body]) AS x FROM F),
W AS (SELECT file, col, weight, list_filter(regexp_split_to_array(lower(strip_accents(x)), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM L),
P AS (SELECT file, col, weight, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM W)"""
_BM25 = f"""WITH {_POSTS}, S AS (SELECT file, sum(len(w)) AS len FROM W GROUP BY file), N AS (SELECT count(*) AS total, avg(len) AS avglen FROM S),
I AS (SELECT item_id, string_split(lower(strip_accents(query)), ' ') AS w FROM eval_items WHERE len(string_split(lower(query), ' ')) >= 3),
Q AS (SELECT item_id || 'a' AS query_id, 0 AS clause, false AS negative, true AS prefix, 1 AS size, 0 AS offset_, w[2] AS want FROM I UNION ALL SELECT item_id || 'a', 1, false, true, 1, 0, w[3] FROM I
 UNION ALL SELECT item_id || 'p', 0, false, false, 2, 0, w[2] FROM I UNION ALL SELECT item_id || 'p', 0, false, false, 2, 1, w[3] FROM I
 UNION ALL SELECT item_id || 'n', 0, false, true, 1, 0, w[2] FROM I UNION ALL SELECT item_id || 'n', 1, true, true, 1, 0, w[3] FROM I UNION ALL SELECT item_id || 's', 0, false, true, 1, 0, w[1] FROM I),
V AS (SELECT DISTINCT term FROM P),
T AS (SELECT term, query_id, clause, negative, size, offset_ FROM V JOIN (SELECT * FROM Q WHERE prefix) ON starts_with(term, want) UNION SELECT term, query_id, clause, negative, size, offset_ FROM V JOIN (SELECT * FROM Q WHERE NOT prefix) ON term = want),
O AS (SELECT query_id, clause, negative, file, weight FROM P JOIN T USING (term) GROUP BY query_id, clause, negative, size, file, col, weight, pos - offset_ HAVING count(DISTINCT offset_) = size),
C AS (SELECT query_id, clause, negative, file, sum(weight) AS tf FROM O GROUP BY 1, 2, 3, 4),
D AS (SELECT *, count(*) OVER (PARTITION BY query_id, clause) AS n FROM C),
R AS (SELECT query_id, file, sum(CASE WHEN negative THEN 0 ELSE greatest(ln((total - n + 0.5) / (n + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen)) END) AS bm25,
 sum(CASE WHEN negative THEN 0 ELSE 1 END) AS have, bool_or(negative) AS ex FROM D JOIN S USING (file), N GROUP BY 1, 2),
M AS (SELECT R.* FROM R JOIN (SELECT query_id, count(DISTINCT clause) AS need FROM Q WHERE NOT negative GROUP BY 1) USING (query_id) WHERE NOT ex AND have = need),
K AS (SELECT query_id, file, bm25, bm25 / (1 + bm25) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 9) DESC, file) AS rank FROM M)"""
_KNN = """WITH A AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), Q AS (SELECT vec_id AS query_id, e AS q FROM A WHERE vec_id % 50 = 0),
X AS (SELECT query_id, vec_id, label, list_cosine_distance(q, e) AS distance FROM Q, A),
T AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS r FROM X)"""
_LISTS = """WITH B AS (SELECT source, doc_id AS file, n_chars, modified_at, title, path FROM documents WHERE source IS NOT NULL),
L AS (SELECT source, 1 AS list_id, 2.0 AS weight, file, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, file) AS rank FROM B
 UNION ALL SELECT source, 2, 2.0, file, row_number() OVER (PARTITION BY source ORDER BY modified_at DESC NULLS LAST, file) FROM B
 UNION ALL SELECT source, 3, 1.0, file, row_number() OVER (PARTITION BY source ORDER BY title ASC NULLS LAST, file) FROM B
 UNION ALL SELECT source, 4, 1.0, file, row_number() OVER (PARTITION BY source ORDER BY path ASC NULLS LAST, file) FROM B),
R AS (SELECT * FROM L WHERE rank <= 20),
U AS (SELECT source, file, sum(weight / (60 + rank)) AS base, min(rank) AS top_rank FROM R GROUP BY 1, 2),
Z AS (SELECT *, CASE WHEN top_rank = 1 THEN 0.05 WHEN top_rank <= 3 THEN 0.02 ELSE 0.0 END AS bonus FROM U),
K AS (SELECT source, file, base, bonus, base + bonus AS rrf, top_rank, row_number() OVER (PARTITION BY source ORDER BY round(base + bonus, 9) DESC, file) AS rank FROM Z)"""
_RESULTS = """WITH B AS (SELECT * FROM documents WHERE source IS NOT NULL),
RES AS (SELECT source AS query_id, lower(path) AS f, rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC NULLS LAST, doc_id) AS rank FROM B) WHERE rank <= 20),
EXP AS (SELECT DISTINCT source AS query_id, lower(path) AS f FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY modified_at DESC NULLS LAST, doc_id) AS r FROM B) WHERE r <= 30 AND lang IN ('de', 'fr'))"""


def _scores(results: str, k: int) -> str:
    return f"""SELECT q.query_id, coalesce(hits / nullif(least({k}, n), 0), 0) AS precision_at_k, coalesce(found / nullif(n, 0), 0) AS recall, coalesce(1 / first, 0) AS mrr, coalesce(hits, 0) AS hits_at_k
 FROM (SELECT query_id FROM {results} UNION SELECT query_id FROM EXP) q LEFT JOIN (SELECT query_id, count(*)::DOUBLE AS n FROM EXP GROUP BY 1) e USING (query_id)
 LEFT JOIN (SELECT query_id, sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END)::DOUBLE AS hits, count(*)::DOUBLE AS found, min(rank)::DOUBLE AS first FROM (SELECT query_id, f, min(rank) AS rank FROM {results} JOIN EXP USING (query_id, f) GROUP BY 1, 2) GROUP BY 1) h USING (query_id)"""


_F1 = "coalesce(2 * precision_at_k * recall / nullif(precision_at_k + recall, 0), 0)"
_TERMS = r"list_filter(list_distinct(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}_]+')), lambda w: length(w) > 1 AND w NOT IN ({stop}))"
_STOP = ", ".join(f"'{w}'" for w in metrics.STOPWORDS)

SQL = {
    "l9_bm25": f"{_BM25} SELECT query_id, file, round(bm25, 6) AS bm25, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM K WHERE rank <= 20",
    "l6_matches": f"{_BM25} SELECT query_id, count(*) AS n FROM K GROUP BY 1",
    "l1_term_counts": f"WITH {_POSTS} SELECT term, count(*) AS n, count(DISTINCT file) AS n_files FROM P GROUP BY 1",
    "h1_strong_signal": f"""{_BM25} SELECT query_id, a >= 0.85 AND a - coalesce(b, 0) >= 0.15 AS strong FROM (SELECT query_id, max(CASE WHEN rank = 1 THEN score END) AS a, max(CASE WHEN rank = 2 THEN score END) AS b FROM K GROUP BY 1)""",
    "v1_nearest": f"{_KNN} SELECT query_id, vec_id, round(distance, 6) AS distance FROM T WHERE r <= 10",
    "v8_recall_of_cells": "SELECT count(*) AS n_queries, true AS nine_of_ten FROM embeddings WHERE vec_id % 50 = 0",
    "v2_nearest_in_label": f"""{_KNN} SELECT query_id, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), vec_id) AS k FROM X WHERE label = 3) WHERE k <= 5""",
    "v3_v4_best_by_label": f"{_KNN} SELECT query_id, label, round(min(distance), 6) AS distance, round(greatest(0, 1 - min(distance) / 2), 6) AS score FROM T WHERE r <= 20 GROUP BY 1, 2",
    "v7_multi_query": f"""{_KNN}, S AS (SELECT query_id % 3 AS q, vec_id, max(round(greatest(0, 1 - distance / 2), 9)) AS score FROM T WHERE r <= 20 GROUP BY 1, 2),
O AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS rank FROM S WHERE score >= 0.3) SELECT q, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM O WHERE rank <= 10""",
    "v9_normalised": """WITH A AS (SELECT vec_id, (embedding::DOUBLE[])[1:16] AS e FROM embeddings), N AS (SELECT vec_id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-12) AS n FROM A)
SELECT vec_id, round(e[1] / n, 6) AS first, round(e[16] / n, 6) AS last, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS norm FROM N""",
    "v10_recall_at_1": f"""{_KNN}, O AS (SELECT query_id, arg_min(label, (round(distance, 12), vec_id)) AS found FROM T WHERE r <= 2 AND query_id <> vec_id GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN found = label THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1 FROM O JOIN A ON vec_id = query_id""",
    "h5_h8_fusion": f"{_LISTS} SELECT source, file, round(rrf, 6) AS rrf, CAST(top_rank AS INTEGER) AS top_rank, CAST(rank AS INTEGER) AS rank FROM K WHERE rank <= 40",
    "h6_compat_weights": f"{_LISTS} SELECT source, file, round(rrf, 6) AS rrf FROM K",
    "h7_trace": f"""{_LISTS} SELECT source, file, (SELECT string_agg(list_id || ':' || rank, ' ' ORDER BY list_id) FROM R WHERE R.source = K.source AND R.file = K.file) AS contributions, round(base, 6) AS base_score, bonus::DOUBLE AS top_rank_bonus, round(rrf, 6) AS total_score FROM K""",
    "h13_h16_blend": f"""{_LISTS}, E AS (SELECT source, file, rank, (file * 37 % 101) / 100.0 AS y, CASE WHEN rank <= 3 THEN 0.75 WHEN rank <= 10 THEN 0.6 ELSE 0.4 END AS w FROM K WHERE rank <= 40),
G AS (SELECT source, file, round(w / rank + (1 - w) * y, 9)::DOUBLE AS score FROM E), O AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, file) AS rank FROM G WHERE score >= 0.2)
SELECT source, file, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM O WHERE rank <= 10""",
    "h11_h16_reranked": rf"""{_LISTS}, Y AS (SELECT doc_id AS file, 1 / (1 + exp(-6 * (len(list_intersect(list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}]+')), ['the', 'owner', 'of', 'schedule', 'and', 'why'])) / 6.0::DOUBLE - 0.5))) AS y FROM documents),
E AS (SELECT source, K.file, rank, y, CASE WHEN rank <= 3 THEN 0.75::DOUBLE WHEN rank <= 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w FROM K JOIN Y USING (file) WHERE rank <= 40),
G AS (SELECT source, file, round(w / rank + (1 - w) * y, 9)::DOUBLE AS score FROM E), O AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, file) AS rank FROM G WHERE score >= 0.2)
SELECT source, file, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM O WHERE rank <= 10""",
    "h14_rank_scores": f"{_LISTS} SELECT source, file, round(1.0::DOUBLE / rank, 6) AS score FROM K WHERE rank <= 40",
    "c4_checked": "SELECT hash, CAST(max(length(doc)) AS INTEGER) AS n_chars, true AS verbatim, true AS gapless, true AS within_limit FROM content WHERE doc IS NOT NULL AND hash IS NOT NULL GROUP BY hash",
    "c5_checked": "SELECT hash, CAST(max(length(doc)) AS INTEGER) AS n_chars, true AS verbatim, true AS gapless, true AS within_limit FROM content WHERE doc IS NOT NULL AND hash IS NOT NULL GROUP BY hash",
    "c4_small_bodies": "SELECT hash, CAST(max(length(doc)) AS INTEGER) AS n_chars FROM content WHERE length(doc) <= 3600 AND hash IS NOT NULL GROUP BY hash",
    "h19_snippets": r"""WITH D AS (SELECT doc_id, string_split(text, chr(10)) AS l, list_filter(regexp_split_to_array(lower(coalesce(title, '')), '[\s\p{Z}]+'), lambda t: t <> '') AS q FROM documents WHERE text IS NOT NULL),
S AS (SELECT doc_id, l, list_transform(l, lambda x: len(list_filter(q, lambda t: contains(lower(x), t)))) AS s FROM D), B AS (SELECT doc_id, l, CAST(list_position(s, list_max(s)) AS INTEGER) AS at_ FROM S),
H AS (SELECT doc_id, l, at_, greatest(at_ - 1, 1) AS a, least(at_ + 2, len(l)) AS b FROM B), T AS (SELECT *, array_to_string(l[a:b], chr(10)) AS t FROM H)
SELECT doc_id, at_ AS line, '@@ -' || a || ',' || (b - a + 1) || ' @@ (' || (a - 1) || ' before, ' || (len(l) - b) || ' after)' || chr(10) || CASE WHEN length(t) > 500 THEN substring(t, 1, 497) || '...' ELSE t END AS snippet,
 CAST(a - 1 AS INTEGER) AS lines_before, CAST(len(l) - b AS INTEGER) AS lines_after, CAST(b - a + 1 AS INTEGER) AS snippet_lines FROM T""",
    "r1_r4_scores": f"{_RESULTS}, S AS ({_scores('RES', 10)}) SELECT query_id, round(precision_at_k, 6) AS precision_at_k, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round({_F1}, 6) AS f1, CAST(hits_at_k AS BIGINT) AS hits_at_k FROM S",
    "a12_r10_averages": f"""{_RESULTS}, RES5 AS (SELECT * FROM RES WHERE rank <= 5), S AS (SELECT 'first five' AS backend, * FROM ({_scores('RES5', 5)}) UNION ALL SELECT 'all', * FROM ({_scores('RES', 20)}))
SELECT backend, count(*) AS n_queries, round(avg(precision_at_k), 6) AS precision_at_k, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg({_F1}), 6) AS f1 FROM S GROUP BY 1""",
    "r6_rank_quality": f"""{_LISTS}, E AS (SELECT source, file FROM R WHERE list_id = 2), G AS (SELECT E.source, R.rank FROM E JOIN R ON R.source = E.source AND R.file = E.file AND R.list_id = 1),
N AS (SELECT source, least(count(*), 5) AS n FROM E GROUP BY 1), H AS (SELECT source, min(rank) AS first, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM G GROUP BY 1)
SELECT source AS query_id, CASE WHEN first <= 5 THEN 1 ELSE 0 END AS hit_at_k, round(coalesce(1.0::DOUBLE / first, 0), 6) AS mrr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, n + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg_at_k FROM N LEFT JOIN H USING (source)""",
    "r7_expansion_scores": f"""WITH T AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM training_examples WHERE example_id IS NOT NULL) WHERE rn = 1),
I AS (SELECT example_id AS q, i, output[i + 1].type AS type, output[i + 1].text AS text FROM (SELECT example_id, output, unnest(range(0, len(output))) AS i FROM T)),
A AS (SELECT q, type, i, text, {_TERMS.format(x='text', stop=_STOP)} AS t FROM I WHERE i % 2 = 0 AND text IS NOT NULL AND type IS NOT NULL),
G AS (SELECT q, type, text AS golden, {_TERMS.format(x='text', stop=_STOP)} AS t FROM (SELECT DISTINCT q, type, text FROM I WHERE i % 2 = 1 AND text IS NOT NULL AND type IS NOT NULL)),
J AS (SELECT A.q, A.type, A.i, golden, coalesce(len(list_intersect(A.t, G.t))::DOUBLE / nullif(len(list_distinct(list_concat(A.t, G.t))), 0), 0) AS j FROM A JOIN G ON A.q = G.q AND A.type = G.type),
M AS (SELECT q, type, i, max(j) AS j, arg_min(golden, (-j, golden)) AS golden FROM J GROUP BY 1, 2, 3 HAVING max(j) >= 0.2),
C AS (SELECT type, count(*) AS p FROM A GROUP BY 1), D AS (SELECT type, count(*) AS g FROM G GROUP BY 1), E AS (SELECT type, count(*) AS m, count(DISTINCT (q, golden)) AS h FROM M GROUP BY 1),
F AS (SELECT coalesce(C.type, D.type) AS type, coalesce(p, 0) AS p, coalesce(g, 0) AS g FROM C FULL JOIN D ON C.type = D.type), H AS (SELECT F.*, coalesce(m, 0) AS m, coalesce(h, 0) AS h FROM F LEFT JOIN E USING (type)),
S AS (SELECT * FROM H UNION ALL SELECT 'overall', CAST(sum(p) AS BIGINT), CAST(sum(g) AS BIGINT), CAST(sum(m) AS BIGINT), CAST(sum(h) AS BIGINT) FROM H),
Y AS (SELECT *, coalesce(m::DOUBLE / nullif(p, 0), 0) AS precision, coalesce(h::DOUBLE / nullif(g, 0), 0) AS recall FROM S)
SELECT type, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, p AS pred_count, g AS golden_count, m AS matched FROM Y""",
    "r8_format_and_hyde": rf"""WITH T AS (SELECT example_id, query, coalesce(output, []) AS o FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM training_examples WHERE example_id IS NOT NULL) WHERE rn = 1),
I AS (SELECT example_id, query, {", ".join(rf"list_filter(list_transform(list_filter(o, lambda x: x.type = '{k}' AND x.text IS NOT NULL), lambda x: regexp_replace(x.text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), lambda t: t <> '') AS {k}" for k in ("lex", "vec", "hyde"))} FROM T),
W AS (SELECT *, hyde[1] AS first, list_filter(regexp_split_to_array(lower(coalesce(hyde[1], '')), '[^\p{{L}}\p{{N}}_]+'), lambda w: length(w) > 2 AND w NOT IN ({", ".join(f"'{w}'" for w in sorted(expansion_reward.FREQUENT))})) AS w FROM I),
R AS (SELECT *, query IS NULL OR len(lex) + len(vec) + len(hyde) = 0 AS failed, coalesce(list_sum(list_transform(list_distinct(w), lambda x: greatest(len(list_filter(w, lambda y: y = x)) - 2, 0) * 2)), 0) AS repeats FROM W)
SELECT example_id, CASE WHEN failed THEN 0 ELSE 10 + CASE WHEN len(lex) > 0 THEN 10 ELSE 0 END + CASE WHEN len(vec) > 0 THEN 10 ELSE 0 END END AS format,
 CAST(CASE WHEN failed OR first IS NULL THEN 0 ELSE 5 + CASE WHEN length(first) BETWEEN 50 AND 200 THEN 5 WHEN length(first) < 50 THEN 2 ELSE 0 END + CASE WHEN contains(first, chr(10)) THEN 0 ELSE 5 END + greatest(0, 5 - repeats) END AS INTEGER) AS hyde FROM R""",
    "r9_spearman": """WITH B AS (SELECT source, n_chars AS a, length(regexp_replace(text, '[^ ]', '', 'g')) AS b FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND n_chars IS NOT NULL),
R AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY a) + (count(*) OVER (PARTITION BY source, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY source ORDER BY b) + (count(*) OVER (PARTITION BY source, b) - 1) / 2.0 AS rb FROM B)
SELECT source, round(CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) END, 6) AS spearman, count(*) AS n FROM R GROUP BY 1""",
}
