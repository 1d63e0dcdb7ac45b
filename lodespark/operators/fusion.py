"""Reciprocal-rank fusion of ranked lists, blending with reranker scores, and the traces of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 60
CANDIDATES = 40


def ranked(scored: DataFrame, key: list[str], score: str, file: str) -> DataFrame:
    """Adds ``rank``, from 1, within each list; ties go by file."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.col(score).desc(), F.col(file))))


def list_weight(source: Column, query_type: Column, ordinal: Column, compat: bool = False) -> Column:
    """Weight 2 for the lists of the original query, else 1; with ``compat`` for the first two lists in order, whatever they hold."""
    if compat:
        return F.when(ordinal <= 2, 2.0).otherwise(1.0)
    return F.when(query_type == "original", 2.0).otherwise(1.0)


def bonus(rank: Column) -> Column:
    """For a document that is first, or among the first three, in any list."""
    return F.when(rank == 1, 0.05).when(rank <= 3, 0.02).otherwise(0.0)


def fuse(lists: DataFrame, key: list[str], file: str = "file", k: int = K) -> DataFrame:
    """``key..., file, rrf, top_rank`` from rows ``key..., file, rank, weight``, one per list and file."""
    out = lists.groupBy(*key, file).agg(F.sum(F.col("weight") / (k + F.col("rank"))).alias("base"), F.min("rank").alias("top_rank"))
    return out.select(*key, file, (F.col("base") + bonus(F.col("top_rank"))).alias("rrf"), "top_rank")


def fusion_trace(lists: DataFrame, key: list[str], file: str = "file", k: int = K) -> DataFrame:
    """Like ``fuse``, with an array of contributions (list, rank, weight, contribution) in the order of the lists."""
    step = F.struct("list_id", "rank", "weight", (F.col("weight") / (k + F.col("rank"))).alias("contribution"))
    out = lists.groupBy(*key, file).agg(F.array_sort(F.collect_list(step)).alias("contributions"), F.min("rank").alias("top_rank"))
    base = F.aggregate("contributions", F.lit(0.0), lambda acc, x: acc + x["contribution"])
    return out.select(*key, file, "contributions", "top_rank", base.alias("base_score"), bonus(F.col("top_rank")).alias("top_rank_bonus"), (base + bonus(F.col("top_rank"))).alias("total_score"))


def blend(rank: Column, rerank_score: Column) -> Column:
    """The first ranks keep more of their retrieval score: 75 % up to 3, 60 % up to 10, else 40 %."""
    w = F.when(rank <= 3, 0.75).when(rank <= 10, 0.60).otherwise(0.40)
    return w / rank + (1 - w) * rerank_score


def final_results(scored: DataFrame, key: list[str], file: str, score: str, min_score: float, limit: int) -> DataFrame:
    """Once per file (its best row), from the least score on, the first ``limit`` a key, in this order of steps."""
    best = scored.groupBy(*key, file).agg(F.max(score).alias(score)).filter(F.col(score) >= min_score)
    return ranked(best, key, score, file).filter(F.col("rank") <= limit)


def strong_signal(top: DataFrame, key: list[str], score: str, least: float = 0.85, gap: float = 0.15) -> DataFrame:
    """``key..., strong``: whether the best hit stands out so far that expansion can be skipped."""
    r = ranked(top, key, score, "file").filter("rank <= 2")
    first, second = F.max(F.when(F.col("rank") == 1, F.col(score))), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col(score))), F.lit(0.0))
    return r.groupBy(*key).agg(((first >= least) & (first - second >= gap)).alias("strong"))
