"""Retrieval metrics over tables of results and of expected files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STOPWORDS = "the a an is are to for of in and or it this that be with as on by how what do does can you your i".split()


def normal_path(path: Column) -> Column:
    """Without scheme, collection and outer slashes, in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(path, r"^[a-z]+://[^/]*/?", "")), "^/+|/+$", "")


def score_results(results: DataFrame, expected: DataFrame, k: int = 10, suffixes: bool = False) -> DataFrame:
    """``query_id, precision_at_k, recall, mrr, f1, hits_at_k`` for ``results(query_id, file, rank)`` and ``expected(query_id, file)``.

    ``precision_at_k`` divides by the smaller of ``k`` and the number of expected files, not by ``k``. Queries without expected files
    score 0; those without results, too. With ``suffixes`` files also match if one path ends with the other; expected files of a query are few.
    """
    e = expected.select("query_id", normal_path(F.col("file")).alias("e")).distinct()
    r = results.select("query_id", normal_path(F.col("file")).alias("f"), "rank")
    if suffixes:
        hits = r.join(F.broadcast(e.withColumnRenamed("query_id", "q")), (F.col("query_id") == F.col("q")) & (F.endswith("f", "e") | F.endswith("e", "f"))).drop("q")
    else:
        hits = r.join(e.withColumn("f", F.col("e")), ["query_id", "f"])
    per_query = hits.groupBy("query_id", "e").agg(F.min("rank").alias("rank")).groupBy("query_id").agg(
        F.sum((F.col("rank") <= k).cast("int")).alias("hits_at_k"), F.count(F.lit(1)).alias("found"), F.min("rank").alias("first")
    )
    wanted = e.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    queries = r.select("query_id").union(e.select("query_id")).distinct()
    x = queries.join(wanted, "query_id", "left").join(per_query, "query_id", "left").fillna(0, ["n", "hits_at_k", "found"])
    p = F.coalesce(F.try_divide(F.col("hits_at_k"), F.least(F.lit(k), F.col("n"))), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("found"), F.col("n")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * rec, p + rec), F.lit(0.0))
    return x.select("query_id", p.alias("precision_at_k"), rec.alias("recall"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), f1.alias("f1"), F.col("hits_at_k").cast("long").alias("hits_at_k"))


def macro_average(scores: DataFrame, by: list[str]) -> DataFrame:
    cols = ["precision_at_k", "recall", "mrr", "f1"]
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n_queries"), *[F.avg(c).alias(c) for c in cols])


def rank_quality(results: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, hit_at_k, mrr, ndcg_at_k`` with binary relevance and a discount of log2(rank + 1)."""
    hits = results.join(relevant.select("query_id", "file").distinct(), ["query_id", "file"])
    got = hits.groupBy("query_id").agg(F.min("rank").alias("first"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"))
    n = relevant.select("query_id", "file").distinct().groupBy("query_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + F.lit(1.0)))
    x = n.join(got, "query_id", "left")
    return x.select(
        "query_id", F.coalesce((F.col("first") <= k).cast("int"), F.lit(0)).alias("hit_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"),
        (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_at_k"),
    )


def content_terms(text: Column) -> Column:
    """Distinct words of more than one character that aren't stopwords."""
    found = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def expansion_scores(predicted: DataFrame, golden: DataFrame, threshold: float = 0.4) -> DataFrame:
    """``type, precision, recall, f1, pred_count, golden_count, matched`` of predicted against golden expansions, and a row ``overall``.

    Both: ``query_id, type, text``. A prediction matches the golden text of its query and type with the largest Jaccard similarity of content
    terms, if that reaches the threshold; of equals, the least text. Precision is micro-averaged over predictions, recall over distinct golden
    texts. An expansion has few texts a query, so the pairs of a query stay few.
    """
    p = predicted.withColumn("pid", F.row_number().over(Window.partitionBy("query_id", "type").orderBy("text"))).withColumn("pt", content_terms(F.col("text")))
    g = golden.select("query_id", "type", F.col("text").alias("golden")).distinct().withColumn("gt", content_terms(F.col("golden")))
    both = F.size(F.array_intersect("pt", "gt"))
    pairs = p.join(g, ["query_id", "type"]).withColumn("j", F.coalesce(F.try_divide(both, F.size(F.array_union("pt", "gt"))), F.lit(0.0)))
    best = pairs.groupBy("query_id", "type", "pid").agg(F.max("j").alias("j"), F.min_by("golden", F.struct(-F.col("j"), F.col("golden"))).alias("golden")).filter((F.col("j") >= threshold) & (F.col("j") > 0))
    tp = best.groupBy("type").agg(F.count(F.lit(1)).alias("matched"), F.countDistinct("query_id", "golden").alias("hit"))
    out = predicted.groupBy("type").agg(F.count(F.lit(1)).alias("pred_count")).join(g.groupBy("type").agg(F.count(F.lit(1)).alias("golden_count")), "type", "full_outer").join(tp, "type", "left").fillna(0)
    out = out.unionByName(out.agg(F.lit("overall").alias("type"), *[F.sum(c).alias(c) for c in ("pred_count", "golden_count", "matched", "hit")]))
    prec = F.coalesce(F.try_divide(F.col("matched"), F.col("pred_count")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("hit"), F.col("golden_count")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    return out.select("type", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), "pred_count", "golden_count", "matched")


def _mean_ranks(scores: DataFrame, key: str, c: str, blocks: int = 256) -> DataFrame:
    """``key, c, rank``: the mean rank of each value of ``c`` within its key.

    Values are counted by a partial aggregate and put into blocks by size; ranks are summed up over the blocks (few rows a key) and
    then within each, so that no key passes through one task.
    """
    counts = scores.groupBy(key, c).agg(F.count(F.lit(1)).alias("n"))
    ends = scores.groupBy(key).agg(F.min(c).alias("low"), F.max(c).alias("high"))
    share = F.coalesce(F.try_divide(F.col(c).cast("double") - F.col("low"), F.col("high").cast("double") - F.col("low")), F.lit(0.0))
    placed = counts.join(ends, key).select(key, c, "n", F.least(F.floor(share * blocks), F.lit(blocks - 1)).alias("block"))
    sums = placed.groupBy(key, "block").agg(F.sum("n").alias("in_block"))
    upto = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(key, "block", F.coalesce(F.sum("in_block").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy(key, "block").orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("less", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [key, "block"])
    return ranked.select(key, c, (F.col("before") + F.col("less") + (F.col("n") + 1) / 2).alias("rank"))


def spearman(scores: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``key, spearman, n``: rank agreement of two scores within each key; ties have their mean rank. Rows with a null are left out."""
    rows = scores.filter(F.col(key).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()).select(key, a, b)
    pairs = rows.groupBy(key, a, b).agg(F.count(F.lit(1)).alias("n"))
    for c in (a, b):
        pairs = pairs.join(_mean_ranks(rows, key, c).withColumnRenamed("rank", f"rank_{c}"), [key, c])
    x, y, n = F.col(f"rank_{a}"), F.col(f"rank_{b}"), F.col("n")
    # Ranks of any sample have the mean (N + 1) / 2; sums are taken of differences from it, so that they stay small.
    size = rows.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    x, y = x - (F.col("total") + 1) / 2, y - (F.col("total") + 1) / 2
    sums = pairs.join(size, key).groupBy(key).agg(F.sum(n * x * y).alias("xy"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.max("total").alias("n"))
    return sums.select(key, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("spearman"), "n")
