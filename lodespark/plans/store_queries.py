"""Registered queries: the store, look-ups, contexts, aggregates, scalar functions and training-data statistics.

Names start with the rows of the operator inventory that they cover. Query sets are the rows whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodespark.functions.paths import handelized, hidden, virtual_path
from lodespark.functions.snippet import numbered_lines
from lodespark.operators import context, lookup, store
from lodespark.session import table
from lodespark.sources import ingest, training
from lodespark.sources.formats import csv_field, xml_text

#: Bodies stored before this day count as embedded; the clock of staleness.
EMBEDDED_BEFORE, NOW = "2024-06-01", "2026-01-01"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return store.current_documents(table(spark, d, "document_index"))


def _active(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("active = 1")


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return store.bodies(table(spark, d, "content"))


def _scan(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as a scan of files: one row per collection and path."""
    rows = table(spark, d, "documents").filter("text is not null and collection is not null and path is not null")
    return ingest.scanned(rows.select("doc_id", "collection", "path", "text"))


def s2_s4_scan_titles(spark: SparkSession, d: str) -> DataFrame:
    return _scan(spark, d).select("doc_id", "title", "hash")


def s3_handelize(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("id", handelized(F.col("path")).alias("clean_path"))


def s4_titles(spark: SparkSession, d: str) -> DataFrame:
    rows = _active(spark, d).join(_bodies(spark, d).filter("doc is not null"), "hash")
    return rows.select("id", ingest.title_of(F.col("doc"), F.col("path")).alias("title"))


def s8_s9_config_changes(spark: SparkSession, d: str) -> DataFrame:
    """Collections of the index against those of the configuration."""
    c = table(spark, d, "store_collections").select(F.col("name").alias("collection")).distinct().withColumn("configured", F.lit(True))
    used = _active(spark, d).select("collection").distinct().withColumn("used", F.lit(True))
    status = F.when(F.col("configured") & F.col("used"), "kept").when(F.col("configured"), "empty").otherwise("deleted")
    return c.join(used, "collection", "full_outer").select("collection", status.alias("status"))


def sel_p1_p2_active_in_collections(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).filter(F.col("collection").isin("inbox", "salty-tensor")).select("id", "collection", "path")


def sel_p4_default_collections(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "store_collections").filter("include_by_default is null or include_by_default <> 0").select(F.col("name").alias("collection"))
    return _active(spark, d).join(wanted, "collection", "left_semi").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def _path_queries(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).filter("id % 50 = 0")


def sel_p5_exact_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = _path_queries(spark, d).select(F.concat_ws("/", "collection", "path").alias("query"))
    return lookup.exact_lookup(_active(spark, d), q)


def sel_p6_suffix_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = _path_queries(spark, d).select(F.upper(F.element_at(F.split("path", "/"), -1)).alias("query"))
    return lookup.suffix_lookup(_active(spark, d), q)


def sel_p8_docid_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = _path_queries(spark, d).select(F.concat(F.lit("#"), store.docid(F.col("hash"))).alias("query"))
    return lookup.docid_lookup(_active(spark, d), q)


def sel_p10_fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    q = _path_queries(spark, d).select(F.concat(F.substring("path", 3, 10_000), F.lit("x")).alias("query"))
    return lookup.fuzzy_lookup(_active(spark, d), q, 3, 5)


def sel_p11_pattern_match(spark: SparkSession, d: str) -> DataFrame:
    return lookup.within_patterns(_active(spark, d), table(spark, d, "store_collections")).select("id", "collection", "path")


def sel_p11_glob(spark: SparkSession, d: str) -> DataFrame:
    return lookup.glob_lookup(_active(spark, d), "**/{ferry,mirror}/**/*-*[0-9].md").select("id", "path")


def sel_p12_multi_get(spark: SparkSession, d: str) -> DataFrame:
    out = lookup.multi_get(_active(spark, d), _bodies(spark, d))
    return out.select("collection", "path", "n_bytes", "skip_reason", F.md5("body").alias("body_md5"))


def sel_p13_find_documents(spark: SparkSession, d: str) -> DataFrame:
    q = _path_queries(spark, d)
    by_id = q.filter("id % 3 = 0").select(store.docid(F.col("hash")).alias("query"))
    by_path = q.filter("id % 3 = 1").select(F.concat_ws("/", "collection", "path").alias("query"))
    by_name = q.filter("id % 3 = 2").select(F.element_at(F.split("path", "/"), -1).alias("query"))
    return lookup.find_documents(_active(spark, d), by_id.union(by_path).union(by_name))


def sel_p14_body_lines(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).filter("doc is not null").select("hash", lookup.body_lines(F.col("doc"), 3, 4).alias("lines"))


def sel_p15_list_files(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).filter((F.col("collection") == "transient-corpus") & F.col("path").startswith("f")).select("path", "title", "hash").orderBy("path")


def sel_p17_visible_paths(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter(~hidden(F.col("path"))).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def j3_documents_with_content(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).join(_bodies(spark, d), "hash").select("id", "hash", F.char_length("doc").alias("n_chars"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks: those of bodies that came before the cut, one for each 3,600 characters."""
    old = _bodies(spark, d).filter(F.col("doc").isNotNull() & (F.col("created_at") < F.lit(f"{EMBEDDED_BEFORE} 00:00:00").cast("timestamp")))
    n = F.ceil(F.char_length("doc") / 3600)
    return old.filter("length(doc) > 0").select("hash", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("seq"))


def _expectations(spark: SparkSession, d: str) -> DataFrame:
    """One chunk more than stored for hashes that start with a zero, as a broken-off job leaves it."""
    n = F.ceil(F.char_length("doc") / 3600) + F.when(F.col("hash").startswith("0"), 1).otherwise(0)
    return _bodies(spark, d).filter("doc is not null").select("hash", n.alias("total_chunks"))


def j4_e1_pending(spark: SparkSession, d: str) -> DataFrame:
    return store.pending_embeddings(_docs(spark, d), _bodies(spark, d), _vectors(spark, d), _expectations(spark, d))


def a3_pending_count(spark: SparkSession, d: str) -> DataFrame:
    return j4_e1_pending(spark, d).agg(F.count_distinct("hash").alias("n_pending"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))


def j6_orphaned_content(spark: SparkSession, d: str) -> DataFrame:
    return store.orphaned_content(_bodies(spark, d), _docs(spark, d)).select("hash")


def j7_orphaned_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stored chunks, here one for each 3,600 characters of every body, of which no active document has the hash."""
    n = F.ceil(F.char_length("doc") / 3600)
    stored = _bodies(spark, d).filter("length(doc) > 0").select("hash", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("seq"))
    return stored.join(_active(spark, d).select("hash"), "hash", "left_anti").groupBy("hash").agg(F.count(F.lit(1)).alias("n_vectors"))


def j8_stored_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).join(_vectors(spark, d), "hash", "left_semi").select("id", "hash")


def _as_stored(spark: SparkSession, d: str) -> DataFrame:
    """The corpus as stored before the scan: every seventh file is missing, every fifth had another title, every eleventh is inactive; and a few files are gone since."""
    s = _scan(spark, d)
    old = s.filter("doc_id % 7 <> 0").select(
        "collection", "path", "hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old title")).otherwise(F.col("title")).alias("title"), F.when(F.col("doc_id") % 11 == 0, 0).otherwise(1).alias("active")
    )
    gone = s.filter("doc_id % 13 = 0").select("collection", F.concat("path", F.lit(".old")).alias("path"), "hash", "title", F.lit(1).alias("active"))
    return old.unionByName(gone)


def j9_m2_scan_diff(spark: SparkSession, d: str) -> DataFrame:
    return store.scan_diff(_as_stored(spark, d), _scan(spark, d)).select("collection", "path", "status")


def m4_scan_counters(spark: SparkSession, d: str) -> DataFrame:
    return j9_m2_scan_diff(spark, d).groupBy("collection", "status").agg(F.count(F.lit(1)).alias("n"))


def m2_merged_documents(spark: SparkSession, d: str) -> DataFrame:
    return store.merge_documents(_as_stored(spark, d), _scan(spark, d))


def m1_new_content(spark: SparkSession, d: str) -> DataFrame:
    return store.new_content(_bodies(spark, d), table(spark, d, "documents").select("text")).select("hash")


def m6_renamed_collection(spark: SparkSession, d: str) -> DataFrame:
    return store.renamed_collection(_docs(spark, d), "inbox", "inbox-2").groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def m7_collections_without_context(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "store_collections")
    return c.select(F.col("name").alias("collection")).distinct().join(context.context_table(c).select("collection"), "collection", "left_anti")


def j10_x1_inherited_context(spark: SparkSession, d: str) -> DataFrame:
    return context.inherited_context(_active(spark, d), context.context_table(table(spark, d, "store_collections")), "All notes.")


def x2_nearest_context(spark: SparkSession, d: str) -> DataFrame:
    return context.nearest_context(_active(spark, d), context.context_table(table(spark, d, "store_collections")), "All notes.")


def k6_context_listing(spark: SparkSession, d: str) -> DataFrame:
    return context.context_table(table(spark, d, "store_collections")).orderBy("collection", F.length("prefix").desc(), "prefix")


def x16_owning_collection(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "store_collections")
    files = _active(spark, d).select(F.concat(F.lit("/srv/vault/"), "collection", F.lit("/"), "path").alias("file")).distinct()
    return context.owning_collection(files, c.filter("path is not null"))


def a1_collection_status(spark: SparkSession, d: str) -> DataFrame:
    return store.collection_status(_docs(spark, d)).withColumn("last_modified", F.unix_micros("last_modified"))


def a2_active_by_collection(spark: SparkSession, d: str) -> DataFrame:
    out = _active(spark, d).groupBy("collection").agg(F.count(F.lit(1)).alias("n"), F.max("modified_at").alias("m"))
    return out.orderBy(F.col("m").desc_nulls_last(), "collection").select("collection", "n", F.unix_micros("m").alias("last_modified"))


def a4_vector_counts(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).groupBy("hash").agg(F.count(F.lit(1)).alias("n_vectors"))


def a5_first_path(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).groupBy("hash").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_documents"))


def a6_days_stale(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).groupBy("collection").agg(F.datediff(F.lit(NOW).cast("date"), F.max("modified_at").cast("date")).alias("days_stale"))


def a7_collection_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _active(spark, d).groupBy("collection").agg(F.count(F.lit(1)).alias("n"))


def a8_directories_without_context(spark: SparkSession, d: str) -> DataFrame:
    return store.top_level_directories(_docs(spark, d), context.context_table(table(spark, d, "store_collections")))


def k4_latest_delivery(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "document_index").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("id").desc()).limit(1)
    return last.select("id", F.unix_micros("loaded_at").alias("loaded_at"))


def k5_cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    return store.newest(table(spark, d, "events"), "ts", "event_id", 1000).select("event_id")


def d1_distinct_files(spark: SparkSession, d: str) -> DataFrame:
    """The first document of each hash, in the order of collection and path."""
    first = F.row_number().over(Window.partitionBy("hash").orderBy("collection", "path", "id"))
    return _active(spark, d).withColumn("r", first).filter("r = 1").select("hash", "collection", "path")


def f1_wrong_hashes(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("hash") == store.content_hash(F.col("doc"))
    return table(spark, d, "content").filter("doc is not null").groupBy(ok.alias("hash_is_right")).agg(F.count(F.lit(1)).alias("n"))


def f1_cache_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.sha2(F.concat(F.lit("expandQuery"), F.to_json(F.struct(F.col("query").alias("query")))), 256)
    return table(spark, d, "eval_items").select("item_id", key.alias("cache_key"))


def f2_docids(spark: SparkSession, d: str) -> DataFrame:
    """The short ids of all hashes, and how many hashes share each."""
    ids = _docs(spark, d).filter("hash is not null").select(store.docid(F.col("hash")).alias("docid"), "hash").distinct()
    return ids.groupBy("docid").agg(F.count(F.lit(1)).alias("n_hashes"), F.min("hash").alias("first_hash"))


def f3_title_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").filter("title is not null and path is not null")
    ascii_only = lambda c: F.regexp_replace(c, "[^ -~]", "?")
    return rows.select("doc_id", F.levenshtein(ascii_only("title"), ascii_only("path")).alias("distance"))


def f6_virtual_paths(spark: SparkSession, d: str) -> DataFrame:
    v = virtual_path(F.col("collection"), F.col("path"))
    rows = _docs(spark, d).select("id", v.alias("v"))
    return rows.select("id", F.regexp_extract("v", "^[a-z]+://([^/]+)/?(.*)$", 1).alias("collection"), F.regexp_extract("v", "^[a-z]+://([^/]+)/?(.*)$", 2).alias("path"))


def f7_lengths(spark: SparkSession, d: str) -> DataFrame:
    return _bodies(spark, d).filter("doc is not null").select("hash", F.char_length("doc").alias("n_chars"), F.octet_length("doc").alias("n_bytes"))


def f8_numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select("item_id", numbered_lines(F.col("content"), 10).alias("numbered"))


def f8_numbered_bodies(spark: SparkSession, d: str) -> DataFrame:
    """The lines of all bodies, numbered; a purged body stays null."""
    return _bodies(spark, d).select("hash", numbered_lines(F.col("doc"), 10).alias("numbered"))


def f9_s12_escapes(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d)
    return rows.select("id", csv_field(F.col("title")).alias("csv"), xml_text(F.coalesce("title", F.lit(""))).alias("xml"))


def s12_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents as lines of CSV, in one column."""
    row = F.concat_ws(",", F.concat(F.lit("#"), store.docid(F.col("hash"))), csv_field(F.col("path")), csv_field(F.col("title")))
    return _active(spark, d).select("id", row.alias("line"))


def f13_age_days(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).filter("modified_at is not null and created_at is not null")
    return rows.select("id", F.datediff(F.col("modified_at").cast("date"), F.col("created_at").cast("date")).alias("days"))


def f14_context_maps(spark: SparkSession, d: str) -> DataFrame:
    return context.context_table(table(spark, d, "store_collections")).select("collection", "prefix", "text")


def x7_index_status(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    return docs.agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum(F.when(F.col("active") == 1, 1).otherwise(0)).alias("n_active"),
        F.count_distinct(F.when(F.col("active") == 1, F.col("hash"))).alias("n_hashes"), F.count_distinct("collection").alias("n_collections"),
    )


def x14_training_pairs(spark: SparkSession, d: str) -> DataFrame:
    return training.normalised_pairs(table(spark, d, "training_examples"))


def x15_training_statistics(spark: SparkSession, d: str) -> DataFrame:
    return training.statistics(table(spark, d, "training_examples"))


def x15_query_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = training.latest(table(spark, d, "training_examples")).filter("query is not null")
    return rows.groupBy(training.category(F.col("query")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def e11_tumbling_counts(spark: SparkSession, d: str) -> DataFrame:
    """An extension of ours: counts and sums of events by hour and type."""
    w = F.window("ts", "1 hour")
    out = table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', w.start)").alias("window_start"), "event_type", "n", "total")


QUERIES = {
    f.__name__: f
    for f in (
        s2_s4_scan_titles, s3_handelize, s4_titles, s8_s9_config_changes, sel_p1_p2_active_in_collections, sel_p4_default_collections, sel_p5_exact_lookup, sel_p6_suffix_lookup, sel_p8_docid_lookup, sel_p10_fuzzy_lookup,
        sel_p11_pattern_match, sel_p11_glob, sel_p12_multi_get, sel_p13_find_documents, sel_p14_body_lines, sel_p15_list_files, sel_p17_visible_paths, j3_documents_with_content, j4_e1_pending, a3_pending_count, j6_orphaned_content,
        j7_orphaned_vectors, j8_stored_chunks, j9_m2_scan_diff, m4_scan_counters, m2_merged_documents, m1_new_content, m6_renamed_collection, m7_collections_without_context, j10_x1_inherited_context,
        x2_nearest_context, k6_context_listing, x16_owning_collection, a1_collection_status, a2_active_by_collection, a4_vector_counts, a5_first_path, a6_days_stale, a7_collection_sizes,
        a8_directories_without_context, k4_latest_delivery, k5_cache_eviction, d1_distinct_files, f1_wrong_hashes, f1_cache_keys, f2_docids, f3_title_distance, f6_virtual_paths, f7_lengths, f8_numbered_lines, f8_numbered_bodies,
        f9_s12_escapes, s12_csv_rows, f13_age_days, f14_context_maps, x7_index_status, x14_training_pairs, x15_training_statistics, x15_query_categories, e11_tumbling_counts,
    )
}
