"""Registered queries of the operators for packing, splitting, copies and near-duplicates, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm.copies import formatting_copies
from lodespark.llm.neardup import near_duplicate_groups, near_duplicate_pairs
from lodespark.llm.pack import batch_items, container_fills, pack_items
from lodespark.llm.split import split_documents
from lodespark.session import cut_lineage, table


def p2_packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_items(batch_items(table(spark, d, "tokenized_batches")), table(spark, d, "batch_budgets"))


def p2_fills(spark: SparkSession, d: str) -> DataFrame:
    return container_fills(p2_packed(spark, d), table(spark, d, "batch_budgets"))


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    """By class: items and tokens as they came in, containers, and whether none is above its capacity, no item is lost or cut without need, and their number is the least possible."""
    items, budgets = batch_items(table(spark, d, "tokenized_batches")), table(spark, d, "batch_budgets")
    packed = cut_lineage(pack_items(items, budgets))
    fills = container_fills(packed, budgets).groupBy("work_class", "capacity").agg(F.count(F.lit(1)).alias("n_containers"), F.max("fill").alias("largest"), F.sum("fill").alias("tokens"))
    whole = packed.groupBy("work_class", "batch_id", "item_idx").agg(F.count(F.lit(1)).alias("pieces"), F.sum("piece_length").alias("length"), F.max(F.col("piece_start") + F.col("piece_length")).alias("ends"))
    whole = whole.join(items.withColumnRenamed("length", "own"), ["batch_id", "item_idx", "work_class"]).join(budgets.select("work_class", "max_batch_tokens"), "work_class")
    kept = (F.col("length") == F.col("own")) & (F.col("ends") == F.col("own")) & (F.col("pieces") == F.greatest(F.ceil(F.col("own") / F.col("max_batch_tokens")), F.lit(1)))
    per = whole.groupBy("work_class").agg(F.count(F.lit(1)).alias("n_items"), F.min(kept).alias("items_whole"))
    out = per.join(fills, "work_class")
    return out.select("work_class", "n_items", "tokens", "n_containers", (F.col("largest") <= F.col("capacity")).alias("within_capacity"), "items_whole")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(table(spark, d, "content"), "hash", "doc", limit=3600, overlap=540, with_text=False)
    return pieces.select(F.col("key").alias("hash")).distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(table(spark, d, "content"), "hash", "doc", limit=3600, overlap=540)
    return pieces.withColumnRenamed("key", "hash")


def p3_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of each body above the limit: its length, and whether the pieces are verbatim, within the limit, gapless, and overlap by 540."""
    content = table(spark, d, "content").filter("hash is not null and doc is not null").select("hash", "doc").dropDuplicates(["hash"])
    own = F.struct("seq", "start_pos", "end_pos", "piece")
    pieces = F.sort_array(F.collect_list(own))  # of one text, so no more than the text itself and its overlaps
    rows = p3_pieces(spark, d).groupBy("hash").agg(pieces.alias("p")).join(content, "hash")
    verbatim = F.forall("p", lambda x: F.substring(F.col("doc"), x["start_pos"] + 1, x["end_pos"] - x["start_pos"]) == x["piece"])
    joints = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: a["end_pos"] - b["start_pos"] == 540)
    ends = (F.get("p", F.lit(0))["start_pos"] == 0) & (F.element_at("p", -1)["end_pos"] == F.char_length("doc"))
    return rows.select(
        "hash", F.char_length("doc").alias("n_chars"), verbatim.alias("verbatim"), F.forall("p", lambda x: F.char_length(x["piece"]) <= 3600).alias("within_limit"),
        (ends & F.forall(joints, lambda x: x)).alias("gapless"), (F.size("p") >= F.ceil((F.char_length("doc") - 540) / 3060)).alias("enough"),
    )


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return formatting_copies(table(spark, d, "training_examples"), "example_id", "query", "loaded_at")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).filter("key > first_key").select(F.col("first_key").alias("first_example_id"), F.col("key").alias("example_id"))


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One record per distinct query, with the number of its copies."""
    return _copies(spark, d).filter("key = first_key").select(F.col("key").alias("example_id"), "n_copies")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = near_duplicate_pairs(table(spark, d, "content"), "hash", "doc", similarity=0.70, shingle=3)
    return pairs.select(F.col("key_a").alias("hash_a"), F.col("key_b").alias("hash_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Of each body of three words or more: the least hash of its group, and how many other texts (word for word) it is linked to."""
    found = cut_lineage(near_duplicate_groups(table(spark, d, "content"), "hash", "doc", similarity=0.70, shingle=3))
    first = found.groupBy("group_id").agg(F.min("key").alias("first_hash"), F.count(F.lit(1)).alias("n_members"))
    return found.join(first, "group_id").select(F.col("key").alias("hash"), "first_hash", "n_members", "n_links")


QUERIES = {
    "p2_packed": p2_packed,
    "p2_fills": p2_fills,
    "p2_totals": p2_totals,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p3_checked": p3_checked,
    "p4_found": p4_found,
    "p4_records": p4_records,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
}

_NORMAL_QUERIES = r"""
WITH q AS (SELECT example_id, any_value(query) AS q FROM training_examples WHERE example_id IS NOT NULL AND query IS NOT NULL GROUP BY example_id),
l AS (SELECT example_id, q, list_filter(regexp_split_to_array(q, '\r\n|\r|\n'), lambda x: regexp_replace(x, '[\s\p{Z}]', '', 'g') <> '') AS l FROM q),
t AS (SELECT example_id, q, l, len(l) >= 2 AND len(list_filter(l, lambda x: NOT regexp_matches(x, '^[\s\p{Z}]*(lex|vec|hyde|intent)[\s\p{Z}]*:', 'i'))) = 0 AS typed FROM l),
n AS (SELECT example_id, CASE WHEN typed THEN 'typed ' || array_to_string(list_sort(list_transform(l, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}]', '', 'g'))), ' ')
             ELSE regexp_replace(lower(q), '[^\p{L}\p{N}]', '', 'g') END AS n FROM t),
g AS (SELECT n, min(example_id) AS f, count(*) AS c FROM n GROUP BY n)
"""

_SIMILAR = r"""
w AS (SELECT hash, list_filter(regexp_split_to_array(lower(any_value(doc)), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
           FROM content WHERE doc IS NOT NULL AND hash IS NOT NULL GROUP BY hash),
s AS (SELECT DISTINCT hash, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 3),
n AS (SELECT hash, count(*) AS n FROM s GROUP BY hash),
c AS (SELECT a.hash AS hash_a, b.hash AS hash_b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.hash < b.hash GROUP BY 1, 2),
p AS (SELECT hash_a, hash_b FROM c JOIN n x ON x.hash = hash_a JOIN n y ON y.hash = hash_b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9)
"""

SQL = {
    "p2_totals": """
WITH b AS (SELECT batch_id, any_value(work_class ORDER BY created_at) AS work_class, any_value(token_ids ORDER BY created_at) AS t, any_value(lengths ORDER BY created_at) AS l, any_value(pad_token_id ORDER BY created_at) AS pad
           FROM tokenized_batches WHERE batch_id IS NOT NULL GROUP BY batch_id),
i AS (SELECT batch_id, work_class, pad, unnest(t) AS x, unnest(list_resize(coalesce(l, []), len(t), NULL)) AS recorded FROM b),
s AS (SELECT work_class, CASE WHEN x IS NULL THEN coalesce(recorded, 0) ELSE coalesce(list_max(list_transform(x, lambda v, k: CASE WHEN v = pad THEN 0 ELSE k END)), 0) END AS length FROM i)
SELECT work_class, count(*) AS n_items, CAST(sum(length) AS BIGINT) AS tokens, CAST(ceil(sum(length) / any_value(max_batch_tokens)) AS BIGINT) AS n_containers, true AS within_capacity, true AS items_whole
FROM s JOIN batch_budgets USING (work_class) GROUP BY work_class
""",
    "p3_checked": "SELECT hash, CAST(length(any_value(doc)) AS INTEGER) AS n_chars, true AS verbatim, true AS within_limit, true AS gapless, true AS enough FROM content WHERE hash IS NOT NULL AND length(doc) > 3600 GROUP BY hash",
    "p5_groups": f"""
WITH RECURSIVE {_SIMILAR}, e AS (SELECT hash_a AS a, hash_b AS b FROM p UNION SELECT hash_b, hash_a FROM p),
r AS (SELECT hash AS a, hash AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
f AS (SELECT a AS hash, min(b) AS first_hash, count(DISTINCT b) AS n_members FROM r GROUP BY a),
k AS (SELECT hash, array_to_string(w, ' ') AS k FROM w),
m AS (SELECT e.a AS hash, count(DISTINCT y.k) AS n_links FROM e JOIN k x ON x.hash = e.a JOIN k y ON y.hash = e.b WHERE x.k <> y.k GROUP BY 1)
SELECT hash, first_hash, n_members, coalesce(n_links, 0) AS n_links FROM f LEFT JOIN m USING (hash)
""",
    "p3_found": "SELECT DISTINCT hash FROM content WHERE length(doc) > 3600",
    "p4_found": _NORMAL_QUERIES + "SELECT f AS first_example_id, example_id FROM n JOIN g USING (n) WHERE example_id > f",
    "p4_records": _NORMAL_QUERIES + "SELECT f AS example_id, c AS n_copies FROM g",
    "p5_found": f"WITH {_SIMILAR} SELECT hash_a, hash_b FROM p",
}
