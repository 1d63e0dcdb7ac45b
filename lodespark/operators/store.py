"""The document store as tables: current rows, content by hash, merges, clean-up and pending work.

State lives in parquet directories that are written anew and never changed in place; every function here is a plan over such tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current_documents(index: DataFrame) -> DataFrame:
    """The latest delivery of each ``id``: the greatest ``loaded_at``, then ``modified_at``, then ``hash``; null counts least."""
    rest = [c for c in index.columns if c not in ("id", "loaded_at", "modified_at", "hash")]
    rows = index.filter("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "modified_at", "hash", *rest)).alias("x"))
    return rows.select("id", "x.*")


def active_documents(index: DataFrame) -> DataFrame:
    return current_documents(index).filter("active = 1")


def bodies(content: DataFrame) -> DataFrame:
    """One row per ``hash``; a purged body is null only if no delivery has it."""
    return content.filter("hash is not null").groupBy("hash").agg(F.max("doc").alias("doc"), F.min("created_at").alias("created_at"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def docid(hash_: Column) -> Column:
    return F.substring(hash_, 1, 6)


def orphaned_content(content: DataFrame, docs: DataFrame) -> DataFrame:
    """Content that no active document refers to."""
    return content.join(docs.filter("active = 1").select("hash"), "hash", "left_anti")


def new_content(content: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of ``incoming(text, ...)`` whose text isn't stored yet, once per text: insert-or-ignore."""
    fresh = incoming.filter("text is not null").withColumn("hash", content_hash(F.col("text")))
    return fresh.dropDuplicates(["hash"]).join(content.select("hash"), "hash", "left_anti")


def scan_diff(docs: DataFrame, scan: DataFrame) -> DataFrame:
    """``collection, path, status, old_hash, new_hash`` of a scan against the stored documents.

    ``docs``: ``collection, path, hash, title, active``; ``scan``: ``collection, path, hash, title``, both unique by collection and path.
    Status: ``indexed`` (new, or active again), ``updated`` (other hash or title), ``unchanged``, ``removed`` (active, but no longer
    there). Documents that stay inactive are left out. Only collections that were scanned can lose documents.
    """
    d = docs.select("collection", "path", F.col("hash").alias("old_hash"), F.col("title").alias("old_title"), (F.col("active") == 1).alias("was_active"))
    s = scan.select("collection", "path", F.col("hash").alias("new_hash"), F.col("title").alias("new_title"), F.lit(True).alias("seen"))
    scanned = scan.select("collection").distinct().withColumn("scanned", F.lit(True))
    both = d.join(s, ["collection", "path"], "full_outer").join(scanned, "collection", "left")
    changed = ~(F.col("old_hash").eqNullSafe(F.col("new_hash")) & F.col("old_title").eqNullSafe(F.col("new_title")))
    status = (
        F.when(F.col("seen") & ~F.coalesce("was_active", F.lit(False)), "indexed")
        .when(F.col("seen") & changed, "updated")
        .when(F.col("seen"), "unchanged")
        .when(F.col("was_active") & F.col("scanned"), "removed")
    )
    return both.withColumn("status", status).filter("status is not null").select("collection", "path", "status", "old_hash", "new_hash")


def merge_documents(docs: DataFrame, scan: DataFrame) -> DataFrame:
    """The documents after a scan: upserted by collection and path, those no longer seen deactivated. Write it to a new directory."""
    s = scan.select("collection", "path", F.col("hash").alias("n_hash"), F.col("title").alias("n_title"), F.lit(1).alias("seen"))
    scanned = scan.select("collection").distinct().withColumn("scanned", F.lit(True))
    both = docs.select("collection", "path", "hash", "title", "active").join(s, ["collection", "path"], "full_outer").join(scanned, "collection", "left")
    return both.select(
        "collection", "path", F.coalesce("n_hash", "hash").alias("hash"), F.when(F.col("seen") == 1, F.col("n_title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("seen") == 1, 1).when(F.col("scanned"), 0).otherwise(F.col("active")).alias("active"),
    )


def pending_embeddings(docs: DataFrame, content: DataFrame, vectors: DataFrame, expectations: DataFrame) -> DataFrame:
    """``hash, path, n_bytes`` of active content without a complete set of vectors.

    ``vectors``: one row per stored chunk (``hash``); ``expectations``: ``hash, total_chunks``. Content is pending if it has no vectors, or
    fewer than expected. A job in progress does not make anything pending.
    """
    stored = vectors.groupBy("hash").agg(F.count(F.lit(1)).alias("stored"))
    active = docs.filter("active = 1").groupBy("hash").agg(F.min("path").alias("path"))
    known = active.join(content.filter("doc is not null").select("hash", F.octet_length("doc").alias("n_bytes")), "hash")
    state = known.join(stored, "hash", "left").join(expectations.select("hash", "total_chunks"), "hash", "left")
    return state.filter("stored is null or stored < total_chunks").select("hash", "path", "n_bytes")


def collection_status(docs: DataFrame) -> DataFrame:
    return docs.groupBy("collection").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.when(F.col("active") == 1, 1).otherwise(0)).alias("n_active"), F.max("modified_at").alias("last_modified")
    )


def top_level_directories(docs: DataFrame, contexts: DataFrame) -> DataFrame:
    """Directories at the root of a collection that have no context of their own."""
    dirs = docs.filter("active = 1 and instr(path, '/') > 0").select("collection", F.split("path", "/")[0].alias("directory")).distinct()
    return dirs.join(contexts.select("collection", F.regexp_replace("prefix", "^/+|/+$", "").alias("directory")), ["collection", "directory"], "left_anti")


def newest(cache: DataFrame, at: str, key: str, keep: int = 1000) -> DataFrame:
    """Cache eviction: the ``keep`` newest rows."""
    return cache.orderBy(F.col(at).desc_nulls_last(), F.col(key)).limit(keep)


def renamed_collection(docs: DataFrame, old: str, new: str) -> DataFrame:
    if docs.filter(F.col("collection") == new).limit(1).count():
        raise ValueError(f"collection {new!r} exists")
    return docs.withColumn("collection", F.when(F.col("collection") == old, F.lit(new)).otherwise(F.col("collection")))
