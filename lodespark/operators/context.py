"""Contexts that documents inherit from the prefixes of their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def context_table(collections: DataFrame) -> DataFrame:
    """``collection, prefix, text`` from the JSON maps of ``store_collections``; prefixes start with a slash."""
    pairs = collections.select(F.col("name").alias("collection"), F.explode(F.from_json("context", "map<string,string>")).alias("prefix", "text"))
    return pairs.select("collection", F.when(F.col("prefix").startswith("/"), F.col("prefix")).otherwise(F.concat(F.lit("/"), "prefix")).alias("prefix"), "text")


def _matches(docs: DataFrame, contexts: DataFrame, path_boundary: bool) -> DataFrame:
    slashed = F.when(F.col("path").startswith("/"), F.col("path")).otherwise(F.concat(F.lit("/"), "path"))
    d = docs.withColumn("slashed", slashed)
    hit = F.startswith("slashed", "prefix")
    if path_boundary:
        hit = hit & (F.endswith("prefix", F.lit("/")) | (F.col("slashed") == F.col("prefix")) | F.startswith("slashed", F.concat("prefix", F.lit("/"))))
    return d.join(contexts.withColumnRenamed("collection", "c"), (F.col("collection") == F.col("c")) & hit, "left").drop("c")


def inherited_context(docs: DataFrame, contexts: DataFrame, global_context: str | None = None, path_boundary: bool = False) -> DataFrame:
    """``collection, path, context``: the global text, then all matching ones from the shortest prefix to the longest, with blank lines between.

    Without ``path_boundary`` a prefix is a plain string prefix, so that ``/talks`` covers ``/talks-old`` too. Documents without context have null.
    """
    hits = _matches(docs.select("collection", "path"), contexts, path_boundary)
    grouped = hits.groupBy("collection", "path").agg(F.array_sort(F.collect_set(F.when(F.col("text").isNotNull(), F.struct(F.length("prefix").alias("n"), "prefix", "text")))).alias("xs"))
    texts = F.transform("xs", lambda x: x["text"])
    if global_context:
        texts = F.concat(F.array(F.lit(global_context)), texts)
    return grouped.select("collection", "path", F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")).alias("context"))


def nearest_context(docs: DataFrame, contexts: DataFrame, global_context: str | None = None) -> DataFrame:
    """``collection, path, context``: the text of the longest matching prefix, else the global one."""
    hits = _matches(docs.select("collection", "path"), contexts, False)
    best = hits.groupBy("collection", "path").agg(F.max_by("text", F.struct(F.length("prefix"), "prefix")).alias("context"))
    return best.select("collection", "path", F.coalesce("context", F.lit(global_context)).alias("context"))


def owning_collection(paths: DataFrame, collections: DataFrame) -> DataFrame:
    """``file, collection``: the collection with the longest root that contains the file.

    A file meets the roots at each of its parent directories, by equality.
    """
    parts = F.split("file", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    up = paths.select("file", F.explode(parents).alias("root"))
    roots = collections.select(F.col("name").alias("collection"), F.regexp_replace("path", "/+$", "").alias("root")).filter("root <> ''")
    return up.join(roots, "root").groupBy("file").agg(F.max_by("collection", F.struct(F.length("root"), "collection")).alias("collection"))
