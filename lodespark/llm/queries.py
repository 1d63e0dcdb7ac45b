"""Registered queries of the operators for model training texts, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm import curation
from lodespark.llm.leaks import leaked_items
from lodespark.llm.mixing import distinct_texts, mix_sources, source_name
from lodespark.llm.pairs import PLACEHOLDERS, copied_coverage, defective_pairs
from lodespark.llm.pii import find_pii, redact_pii, restore_pii, tag_pii
from lodespark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return defective_pairs(table(spark, d, "training_examples"))


def p1_summary(spark: SparkSession, d: str) -> DataFrame:
    return p1_found(spark, d).groupBy("defect").agg(F.count(F.lit(1)).alias("n_examples"))


def p1_plain_defects(spark: SparkSession, d: str) -> DataFrame:
    """The defects that need no knowledge of languages: empty and copied."""
    return p1_found(spark, d).filter("defect in ('empty', 'copied')")


def p1_copied_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How much of each output is copied from its query in runs of four words or more."""
    return copied_coverage(table(spark, d, "training_examples"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "content", window=10, radius=1)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each item that leaked: in how many documents, and at how many places."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_windows").alias("n_windows"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Of each source the target and the actual share, and the exponent that makes its share of all tokens the target."""
    shares = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]
    return shares.withColumns({c: F.round(c, 9) for c in ("target_share", "exponent", "actual_share")})


def p7_entropy_shares(spark: SparkSession, d: str) -> DataFrame:
    """The same sources without targets: one exponent for all, at which the weights have 0.9 of the largest entropy."""
    shares = mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"), target_entropy=0.9)[1]
    return shares.select("source", F.round("target_share", 6).alias("target_share"), F.round("exponent", 6).alias("exponent"), "budget_tokens", "available_tokens", (F.col("most_repeats") <= F.col("max_repeats")).alias("within_limit"))


def p7_available(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts and their tokens by source."""
    goals = table(spark, d, "mix_targets").select(source_name(F.col("source")).alias("source"))
    return distinct_texts(table(spark, d, "documents"), goals).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("tokens").alias("tokens"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(table(spark, d, "documents"), table(spark, d, "given_names"))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every text as it was, from its redacted form and the values that were found in it, in their order."""
    return restore_pii(tag_pii(table(spark, d, "documents"), table(spark, d, "given_names")))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders."""
    return redact_pii(table(spark, d, "documents"), table(spark, d, "given_names"))


QUERIES = {
    **curation.QUERIES,
    "p1_found": p1_found,
    "p1_summary": p1_summary,
    "p1_plain_defects": p1_plain_defects,
    "p1_copied_coverage": p1_copied_coverage,
    "p6_found": p6_found,
    "p6_items": p6_items,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_entropy_shares": p7_entropy_shares,
    "p7_available": p7_available,
    "p8_found": p8_found,
    "p8_redacted": p8_redacted,
    "p8_restored": p8_restored,
}

_TEXTS = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') AS source, text,
                  len(regexp_extract_all(text, '\p{L}+|\p{Nd}+|[^\s\p{Z}\p{L}\p{Nd}]')) AS tokens FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
g AS (SELECT regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') AS source, target_share, CAST(coalesce(max_repeats, 1) AS BIGINT) AS max_repeats
      FROM mix_targets WHERE source IS NOT NULL AND target_share IS NOT NULL),
o AS (SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source, max(tokens) AS tokens, md5('0:' || md5(text)) AS ord FROM t
      WHERE tokens > 0 AND source IN (SELECT source FROM g) GROUP BY text),
h AS (SELECT source, count(*) AS n_texts, CAST(sum(tokens) AS BIGINT) AS have FROM o GROUP BY source),
"""
_MIXED = _TEXTS + r"""
u AS (SELECT source, have, max_repeats, target_share / sum(target_share) OVER () AS w, have / sum(have) OVER () AS p FROM g JOIN h USING (source) WHERE target_share > 0 AND max_repeats > 0),
b AS (SELECT *, CAST(floor(w * (SELECT min(have * max_repeats / w) FROM u) + 1e-6) AS BIGINT) AS budget FROM u),
c AS (SELECT doc_id, source, tokens, budget // have + CAST(sum(tokens) OVER (PARTITION BY source ORDER BY ord) <= budget % have AS BIGINT) AS repeats FROM o JOIN b USING (source)),
"""
SQL = {
    **curation.SQL,
    "p1_copied_coverage": r"""
WITH x AS (SELECT example_id, query, output FROM training_examples WHERE example_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY loaded_at DESC) = 1),
q AS (SELECT example_id, list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM x WHERE query IS NOT NULL),
i AS (SELECT example_id, unnest(output).text AS text FROM x WHERE output IS NOT NULL),
n AS (SELECT example_id, row_number() OVER () AS item, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM i WHERE text IS NOT NULL),
qg AS (SELECT DISTINCT example_id, unnest(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) AS g FROM q WHERE len(w) >= 4),
ng AS (SELECT example_id, item, unnest(range(1, len(w) - 2)) AS k, unnest(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) AS g FROM n WHERE len(w) >= 4),
c AS (SELECT DISTINCT example_id, item, k + s AS place FROM ng JOIN qg USING (example_id, g), range(4) r(s)),
t AS (SELECT example_id, sum(len(w)) AS n_words FROM n GROUP BY example_id)
SELECT example_id, CAST(any_value(n_words) AS BIGINT) AS n_words, count(*) AS n_copied FROM c JOIN t USING (example_id) GROUP BY example_id
""",
    "p6_found": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE content IS NOT NULL),
dw AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
ew AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM e WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM dw JOIN ew USING (g)
""",
    "p6_items": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
e AS (SELECT item_id, list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM eval_items WHERE content IS NOT NULL),
dw AS (SELECT doc_id, unnest(range(1, len(w) - 8)) AS place, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM d WHERE len(w) >= 10),
ew AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM e WHERE len(w) >= 10)
SELECT item_id, count(DISTINCT doc_id) AS n_documents, count(*) AS n_windows FROM dw JOIN ew USING (g) GROUP BY item_id
""",
    "p8_restored": "SELECT doc_id, text FROM documents",
    "p1_plain_defects": rf"""
WITH x AS (SELECT example_id, query, output FROM training_examples WHERE example_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY loaded_at DESC) = 1),
l AS (SELECT *, list_filter(regexp_split_to_array(query, '\r\n|\r|\n'), lambda q: regexp_replace(q, '[\s\p{{Z}}]', '', 'g') <> '') AS lines FROM x),
k AS (SELECT example_id, query, coalesce(list_transform(list_filter(output, lambda o: o.text IS NOT NULL), lambda o: o.text), []) AS t FROM l
      WHERE query IS NULL OR NOT (len(lines) >= 2 AND len(list_filter(lines, lambda q: NOT regexp_matches(q, '^[\s\p{{Z}}]*(lex|vec|hyde|intent)[\s\p{{Z}}]*:', 'i'))) = 0)),
i AS (SELECT example_id, query, unnest(t) AS text FROM k),
w AS (SELECT example_id, list_filter(regexp_split_to_array(lower(query), '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '') AS q,
             list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '') AS w,
             list_filter(regexp_split_to_array(lower(regexp_replace(text, '^[^\p{{L}}\p{{N}}_]*(?:q|query|question|prompt|input|user|search|frage|anfrage|suche|pregunta|consulta|question|requête|recherche|问题|查询|提问)\s*[:：\-–—=>]+', '', 'i')), '[^\p{{L}}\p{{N}}]+'), lambda v: v <> '') AS bare FROM i),
r AS (SELECT * FROM w WHERE len(w) > 0 AND array_to_string(w, ' ') NOT IN ({", ".join(f"'{p}'" for p in sorted(PLACEHOLDERS))})),
c AS (SELECT example_id, bool_and(len(q) > 0 AND (len(list_filter(w, lambda v: NOT list_contains(q, v))) = 0 OR (len(bare) > 0 AND len(list_filter(bare, lambda v: NOT list_contains(q, v))) = 0))) AS copied FROM r GROUP BY example_id)
SELECT example_id, CASE WHEN copied IS NULL THEN 'empty' ELSE 'copied' END AS defect FROM k LEFT JOIN c USING (example_id) WHERE copied IS NULL OR copied
""",
    "p7_mix": _MIXED + "r AS (SELECT * FROM c WHERE repeats > 0) SELECT doc_id, source, tokens, repeats FROM r",
    "p7_shares": _MIXED + r"""
s AS (SELECT source, CAST(sum(tokens * repeats) AS BIGINT) AS used, max(repeats) AS most FROM c WHERE repeats > 0 GROUP BY source)
SELECT source, round(target_share, 9) AS target_share, round(CASE WHEN p < 1 THEN ln(w) / ln(p) WHEN p = 1 THEN 1 END, 9) AS exponent, coalesce(budget, 0) AS budget_tokens, coalesce(used, 0) AS used_tokens,
       round(coalesce(used, 0) / (SELECT sum(used) FROM s), 9) AS actual_share, coalesce(h.have, 0) AS available_tokens, coalesce(n_texts, 0) AS n_texts, g.max_repeats, coalesce(most, 0) AS most_repeats
FROM g LEFT JOIN h USING (source) LEFT JOIN b USING (source) LEFT JOIN s USING (source)
""",
    "p7_entropy_shares": _TEXTS + r"""
n AS (SELECT list(have / total) AS p FROM (SELECT have, sum(have) OVER () AS total FROM h JOIN g USING (source) WHERE max_repeats > 0)),
e AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high UNION ALL
      SELECT i + 1, CASE WHEN fits THEN mid ELSE low END, CASE WHEN fits THEN high ELSE mid END FROM (
          SELECT i, low, high, mid, -list_sum(list_transform(w, lambda x: x / list_sum(w) * ln(x / list_sum(w)))) >= 0.9 * ln(len(w)) AS fits FROM (
              SELECT i, low, high, (low + high) / 2 AS mid, list_transform(p, lambda x: x ** ((low + high) / 2)) AS w FROM e, n WHERE i < 60))),
k AS (SELECT low AS t FROM e WHERE i = 60),
v AS (SELECT source, have, max_repeats, t, have ** t / sum(have ** t) OVER () AS w FROM h JOIN g USING (source), k WHERE max_repeats > 0),
b AS (SELECT *, CAST(floor(w * (SELECT min(have * max_repeats / w) FROM v) + 1e-6) AS BIGINT) AS budget FROM v)
SELECT source, round(coalesce(w, 0), 6) AS target_share, round(t, 6) AS exponent, coalesce(budget, 0) AS budget_tokens, coalesce(h.have, 0) AS available_tokens,
       true AS within_limit FROM g LEFT JOIN h USING (source) LEFT JOIN b USING (source)
""",
    "p7_available": r"""
WITH t AS (SELECT doc_id, regexp_replace(lower(trim(source)), '[\s\-]+', '_', 'g') AS source, text,
                  len(regexp_extract_all(text, '\p{L}+|\p{Nd}+|[^\s\p{Z}\p{L}\p{Nd}]')) AS tokens FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
o AS (SELECT text, arg_min(source, doc_id) AS source, max(tokens) AS tokens FROM t
      WHERE tokens > 0 AND source IN (SELECT source FROM mix_targets) GROUP BY text)
SELECT source, count(*) AS n_texts, CAST(sum(tokens) AS BIGINT) AS tokens FROM o GROUP BY source
""",
}
