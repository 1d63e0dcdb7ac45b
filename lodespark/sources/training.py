"""Training examples: loading, normalising, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "query string not null, intent string, output array<array<string>>"

# Key words of the query categories, and words that are no entities.
TEMPORAL = ("latest", "recent", "new", "update", "changelog", "changed", "version", "release", "news", "2024", "2025")
COMPARISON = ("difference", "vs", "versus", "compare")
PERSONAL = ("meeting", "notes", "journal", "ideas", "thoughts")
NO_ENTITY = ("the", "a", "an", "is", "are", "to", "for", "of", "in", "and", "or")


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Examples from JSON lines with ``output`` as pairs of type and text; a malformed line fails the read."""
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    return rows.withColumn("output", F.transform("output", lambda x: F.struct(x[0].alias("type"), x[1].alias("text"))))


def latest(examples: DataFrame) -> DataFrame:
    """The latest delivery of each example."""
    rest = [c for c in examples.columns if c not in ("example_id", "loaded_at")]
    return examples.filter("example_id is not null").groupBy("example_id").agg(F.max(F.struct("loaded_at", *rest)).alias("x")).select("example_id", "x.*")


def normalised_pairs(examples: DataFrame) -> DataFrame:
    """``example_id, seq, type, text``: trimmed pairs of known types, blank ones dropped, hyde before lex before vec, otherwise in order."""
    order = F.create_map(*[F.lit(x) for x in ("hyde", 0, "lex", 1, "vec", 2)])
    trim = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    items = latest(examples).select("example_id", F.posexplode("output").alias("pos", "item"))
    items = items.select("example_id", "pos", F.col("item.type").alias("type"), trim(F.col("item.text")).alias("text")).filter("type in ('lex', 'vec', 'hyde') and text <> ''")
    sorted_ = items.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct(order[F.col("type")].alias("o"), "pos", "type", "text"))).alias("xs"))
    return sorted_.select("example_id", F.posexplode("xs").alias("seq", "x")).select("example_id", "seq", "x.type", "x.text")


def _words(query: Column) -> Column:
    return F.filter(F.split(query, r"(?U)\s+"), lambda w: w != "")


def _any(text: Column, keys: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keys:
        out = out | F.contains(text, F.lit(k))
    return out


def _capital(word: Column) -> Column:
    first = F.substring(word, 1, 1)
    return first.rlike(r"^\p{Lu}")


def category(query: Column) -> Column:
    low = F.lower(query)
    words = _words(query)
    return (
        F.when(F.size(words) <= 2, "short_keyword").when(F.exists(words, _capital), "named_entity").when(_any(low, TEMPORAL), "temporal").when(low.startswith("how "), "how_to")
        .when(low.startswith("what "), "what_is").when(_any(low, COMPARISON), "comparison").when(_any(low, PERSONAL), "personal").otherwise("other")
    )


def has_entity(query: Column) -> Column:
    one = lambda w: ~F.lower(w).isin(*NO_ENTITY) & (F.length(w) > 1) & (_capital(w) | w.rlike(r"[.+\-0-9]"))
    return F.exists(_words(query), one)


def statistics(examples: DataFrame) -> DataFrame:
    """One row of counts: length classes, duplicates without regard to case, entities, types present, hyde texts above 200 characters."""
    rows = latest(examples).filter("query is not null")
    n = F.size(_words(F.col("query")))
    has = lambda t: F.coalesce(F.exists("output", lambda x: x["type"] == t), F.lit(False))
    long_hyde = F.coalesce(F.size(F.filter("output", lambda x: (x["type"] == "hyde") & (F.length(x["text"]) > 200))), F.lit(0))
    one = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), one(n <= 2).alias("short"), one((n > 2) & (n <= 5)).alias("medium"), one(n > 5).alias("long"),
        (F.count(F.lit(1)) - F.count_distinct(F.lower("query"))).alias("duplicates"), one(has_entity(F.col("query"))).alias("with_entity"),
        one(has("lex")).alias("with_lex"), one(has("vec")).alias("with_vec"), one(has("hyde")).alias("with_hyde"), F.sum(F.greatest(long_hyde, F.lit(0))).alias("long_hyde"),
    )
