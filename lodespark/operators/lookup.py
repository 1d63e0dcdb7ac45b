"""Finding documents by path, id, glob or a near path.

Lookups take a table of queries against all documents, so that one plan serves one name or millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodespark.functions.paths import glob_regex, virtual_path

MAX_BYTES = 10 * 1024
_KEY = 24  #: characters at the end of a path that look-ups by suffix join on, at most


def exact_lookup(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``queries(query)`` of the form ``collection/path``."""
    return docs.withColumn("query", F.concat_ws("/", "collection", "path")).join(queries.select("query").distinct(), "query").select("query", "collection", "path", "hash")


def suffix_lookup(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The first document, by collection and path, whose path ends with the query, letter case aside.

    Paths meet queries by their last characters: as many as the query has, at most 24. A path has one key for each
    length that some query has, so it is an equi-join with a check, not a comparison of all pairs, and a short query lengthens no other's list.
    """
    q = queries.filter("length(query) > 0").select("query", F.lower("query").alias("q")).distinct().withColumn("size", F.least(F.length("q"), F.lit(_KEY)))
    sizes = [r["size"] for r in q.select("size").distinct().collect()]  # 24 at most
    q = q.withColumn("k", F.right("q", F.col("size")))
    keys = F.array(*[F.struct(F.lit(n).alias("size"), F.right("p", F.lit(n)).alias("k")) for n in sizes]) if sizes else F.array().cast("array<struct<size int, k string>>")
    d = docs.select("collection", "path", "hash", F.lower("path").alias("p"))
    d = d.select("collection", "path", "hash", "p", F.explode(keys).alias("x")).select("collection", "path", "hash", "p", "x.size", "x.k")
    hits = d.join(q, ["size", "k"]).filter(F.endswith("p", "q"))
    return hits.groupBy("query").agg(F.min(F.struct("collection", "path", "hash")).alias("x")).select("query", "x.*")


def docid_lookup(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The first document, by collection and path, whose hash starts with the query (six hex digits or more, without ``#``)."""
    q = queries.select("query", F.regexp_replace(F.trim("query"), "^[\"']?#?|[\"']$", "").alias("h")).filter(F.col("h").rlike("^[a-fA-F0-9]{6,}$"))
    q = q.select("query", F.lower("h").alias("h"), F.lower(F.substring("h", 1, 6)).alias("short")).distinct()
    d = docs.select("collection", "path", "hash", F.substring("hash", 1, 6).alias("short"))
    hits = d.join(q, "short").filter(F.startswith("hash", "h"))
    return hits.groupBy("query").agg(F.min(F.struct("collection", "path", "hash")).alias("x")).select("query", "x.*")


def _segments(length: int, parts: int) -> list[tuple[int, int, int]]:
    """(number, start, size) of nearly even parts of a string of that length."""
    base, extra, at, out = length // parts, length % parts, 0, []
    for i in range(parts):
        size = base + (i >= parts - extra)
        out.append((i, at, size))
        at += size
    return out


def fuzzy_lookup(docs: DataFrame, queries: DataFrame, max_distance: int = 3, limit: int = 5) -> DataFrame:
    """``query, path, distance``: the nearest paths within the edit distance, ``limit`` a query.

    A query is cut into ``max_distance + 1`` parts. A path within the distance contains one of them, shifted by no more than the
    distance, so parts and pieces of paths are joined by equality; only then distances are computed. Queries of no more characters than the
    distance have empty parts, which every path of a like length contains.
    """
    parts = max_distance + 1
    q = queries.filter("query is not null").select("query", F.lower("query").alias("q")).distinct().withColumn("n", F.length("q"))
    lengths = [r["n"] for r in q.select("n").distinct().collect()]  # bounded by the longest query
    plan = [(n, i, a, s) for n in lengths for i, a, s in _segments(n, parts)]
    spark = docs.sparkSession
    cuts = F.broadcast(spark.createDataFrame(plan or [(-1, 0, 0, 0)], "n int, part int, at int, size int"))
    qs = q.join(cuts, "n").select("query", "q", "n", "part", F.expr("substring(q, at + 1, size)").alias("piece"))
    d = docs.select("path", F.lower("path").alias("p")).distinct().withColumn("m", F.length("p"))
    near = d.withColumn("n", F.explode(F.sequence(F.col("m") - max_distance, F.col("m") + max_distance))).join(cuts, "n")
    shifted = near.select("path", "p", "n", "part", "at", "size", F.explode(F.array([F.lit(x) for x in range(-max_distance, max_distance + 1)])).alias("shift"))
    shifted = shifted.filter((F.col("at") + F.col("shift") >= 0) & (F.col("at") + F.col("shift") + F.col("size") <= F.length("p")))
    pieces = shifted.select("path", "p", "n", "part", F.expr("substring(p, at + shift + 1, size)").alias("piece"))
    pairs = qs.join(pieces, ["n", "part", "piece"]).select("query", "q", "path", "p").distinct()
    hits = pairs.withColumn("distance", F.levenshtein("q", "p", max_distance)).filter("distance >= 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "path"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query", "path", "distance")


def glob_lookup(docs: DataFrame, pattern: str) -> DataFrame:
    """Documents whose virtual path, path or ``collection/path`` matches the glob."""
    rx = glob_regex(pattern)
    both = F.concat_ws("/", "collection", "path")
    return docs.filter(virtual_path(F.col("collection"), F.col("path")).rlike(rx) | F.col("path").rlike(rx) | both.rlike(rx))


def within_patterns(docs: DataFrame, collections: DataFrame) -> DataFrame:
    """Documents that their collection's ``pattern`` covers and its ``ignore_patterns`` (a JSON array) do not.

    Patterns are compiled once a collection; the documents meet them by an equi-join.
    """
    compiled = F.udf(lambda p: glob_regex(p or "**/*.md"), StringType())
    ignored = F.from_json("ignore_patterns", "array<string>")
    rules = collections.select(
        F.col("name").alias("collection"), compiled("pattern").alias("keep"),
        F.when(ignored.isNotNull(), F.transform(ignored, lambda x: x)).alias("skip"),
    )
    any_of = F.udf(lambda xs: "|".join(glob_regex(x) for x in xs) if xs else None, StringType())
    rules = rules.select("collection", "keep", any_of("skip").alias("skip"))
    hits = docs.join(rules, "collection").filter(F.regexp_like("path", F.col("keep")))
    return hits.filter(F.col("skip").isNull() | ~F.regexp_like("path", F.col("skip"))).drop("keep", "skip")


def multi_get(docs: DataFrame, content: DataFrame, max_bytes: int = MAX_BYTES, max_lines: int | None = None) -> DataFrame:
    """``collection, path, n_bytes, skip_reason, body`` of the given documents; bodies above the limit are skipped with a reason, those of more than ``max_lines`` lines cut with a note."""
    rows = docs.select("collection", "path", "hash").join(content.select("hash", "doc"), "hash").withColumn("n_bytes", F.octet_length("doc"))
    large = F.col("n_bytes") > max_bytes
    reason = F.when(F.col("doc").isNull(), "purged").when(large, F.concat(F.lit("larger than "), F.lit(max_bytes), F.lit(" bytes")))
    return rows.select("collection", "path", "n_bytes", reason.alias("skip_reason"), F.when(~large, first_lines(F.col("doc"), max_lines)).alias("body"))


def first_lines(text: Column, max_lines: int | None) -> Column:
    """The first lines of a text and a note of how many more there are; all of it where no limit is given or reached."""
    if max_lines is None:
        return text
    lines = F.split(text, "\n", -1)
    more = F.size(lines) - max_lines
    cut = F.concat(F.array_join(F.slice(lines, 1, max_lines), "\n"), F.lit("\n\n[... truncated "), more.cast("string"), F.lit(" more lines]"))
    return F.when(more > 0, cut).otherwise(text)


def find_documents(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The best hit of each query: by id, else by exact path, else by suffix."""
    tries = [docid_lookup(docs, queries), exact_lookup(docs, queries), suffix_lookup(docs, queries)]
    out = None
    for priority, hits in enumerate(tries):
        part = hits.select("query", F.lit(priority).alias("priority"), "collection", "path", "hash")
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("query").agg(F.min(F.struct("priority", "collection", "path", "hash")).alias("x"))
    return best.select("query", "x.priority", "x.collection", "x.path", "x.hash")


def body_lines(text, first, count):
    """Lines ``first`` (from 1) to ``first + count - 1`` of a text column."""
    return F.array_join(F.slice(F.split(text, "\n"), first, count), "\n")
