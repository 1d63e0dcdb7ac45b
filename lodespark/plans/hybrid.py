"""Hybrid search: keyword and vector lists, fusion, best chunks, reranking and blending."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodespark.functions.snippet import intent_terms
from lodespark.operators import chunks, fusion, lexical, models, vector
from lodespark.plans.query_document import SubQuery
from lodespark.schema import check_space

PER_LIST = 20


@dataclass
class Options:
    limit: int = 10
    min_score: float = 0.0
    candidate_limit: int = fusion.CANDIDATES
    skip_rerank: bool = False
    intent: str | None = None
    compat_weights: bool = False
    explain: bool = False


def vector_hits(vectors: DataFrame, docs: DataFrame, encoder: models.Encoder, texts: list[str], k: int) -> DataFrame:
    """``query_id, file, distance``: the best chunk of each document, for all texts in one pass."""
    spaces = [r[0] for r in vectors.select("space_id").distinct().limit(2).collect()]
    for s in spaces:
        check_space(s, encoder.descriptor.space_id)
    spark = docs.sparkSession
    template = encoder.descriptor.query_template
    x = encoder.encode([template.format(text=t) for t in texts])
    queries = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "query_id long, embedding array<double>")
    # Vectors of the wanted documents only, so that no list is starved by others; then exact neighbours over documents' best chunks.
    own = vectors.join(docs.select("file", "hash"), "hash").select("file", "embedding", F.xxhash64("file", "seq").alias("vec_id"))
    most = own.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
    hits = vector.nearest(own, queries, k * most, encoder.descriptor.dims)
    best = vector.nearest_by(hits.join(own.select("vec_id", "file"), "vec_id"), "file")
    return fusion.ranked(best.withColumn("score", vector.cosine_score(F.col("distance"))), ["query_id"], "score", "file").filter(F.col("rank") <= k)


def ranked_lists(docs: DataFrame, vectors: DataFrame | None, encoder: models.Encoder | None, searches: list[tuple[str, SubQuery]]) -> DataFrame:
    """``list_id, role, source, file, rank, score`` for searches with the role ``original`` or the type of an expansion.

    ``original`` goes to both kinds of index, lex to the keyword index, vec and hyde to the vectors.
    """
    spark = docs.sparkSession
    lex = [(str(i), s.query) for i, (role, s) in enumerate(searches) if role == "original" or s.type == "lex"]
    vec = [(i, s.query) for i, (role, s) in enumerate(searches) if role == "original" or s.type in ("vec", "hyde")]
    roles = spark.createDataFrame([(i, role) for i, (role, _) in enumerate(searches)], "n int, role string")
    out = None
    if lex:
        out = lexical.search(docs, lex, PER_LIST).select((F.col("query_id").cast("int") * 2).alias("list_id"), F.lit("fts").alias("source"), "file", "rank", "score", F.col("query_id").cast("int").alias("n"))
    if vec and vectors is not None and encoder is not None:
        hits = vector_hits(vectors, docs, encoder, [t for _, t in vec], PER_LIST)
        index = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(vec)], "query_id long, n int")
        part = hits.join(F.broadcast(index), "query_id").select((F.col("n") * 2 + 1).alias("list_id"), F.lit("vec").alias("source"), "file", "rank", "score", "n")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no search can run without vectors")
    return out.join(F.broadcast(roles), "n").drop("n")


def hybrid(
    docs: DataFrame, vectors: DataFrame | None, encoder: models.Encoder | None, scorer: models.Scorer | None, query: str, searches: list[tuple[str, SubQuery]], options: Options
) -> DataFrame:
    """``file, score, rank, best_chunk, best_chunk_pos[, contributions, rrf, rerank]``.

    ``docs``: ``file, filepath, title, body, hash``. Only the chunks of the candidates, 40 by default, are made and scored.
    """
    lists = ranked_lists(docs, vectors, encoder, searches)
    ordinal = F.dense_rank().over(Window.orderBy("list_id")) if options.compat_weights else F.lit(1)
    lists = lists.withColumn("weight", fusion.list_weight(F.col("source"), F.col("role"), ordinal, options.compat_weights)).withColumn("q", F.lit(0))
    fused = fusion.fusion_trace(lists, ["q"])
    top = fused.withColumn("rrf", F.round("total_score", 12)).orderBy(F.col("rrf").desc(), "file").limit(options.candidate_limit)
    top = fusion.ranked(top, ["q"], "rrf", "file")
    parts = chunks.chunk_documents(docs.join(F.broadcast(top.select("file")), "file").select("file", "body"), "file", "body")
    best = chunks.best_chunk(parts, query.lower().split(), intent_terms(options.intent))
    cand = top.join(best.select(F.col("key").alias("file"), F.col("chunk").alias("best_chunk"), F.col("pos").alias("best_chunk_pos")), "file", "left")
    if options.skip_rerank or scorer is None:
        scored = cand.withColumn("rerank", F.lit(None).cast("double")).withColumn("score", 1 / F.col("rank"))
    else:
        asked = query if not options.intent else f"{query}\n{options.intent}"
        pairs = cand.select(F.lit(asked).alias("query"), "file", F.coalesce("best_chunk", F.lit("")).alias("chunk"))
        got = models.rerank(pairs, scorer).select("file", F.col("score").alias("rerank"))
        scored = cand.join(got, "file").withColumn("score", fusion.blend(F.col("rank"), F.col("rerank")))
    final = fusion.final_results(scored, ["q"], "file", "score", options.min_score, options.limit)
    keep = ["best_chunk", "best_chunk_pos"] + (["contributions", "rrf", "rerank"] if options.explain else [])
    return final.drop("q").join(scored.select("file", *keep), "file").orderBy("rank")
