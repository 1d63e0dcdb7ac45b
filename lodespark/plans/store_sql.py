"""SQL of the store queries, as DuckDB runs it on the same tables."""

from __future__ import annotations

from lodespark.plans.store_queries import EMBEDDED_BEFORE, NOW

_D = r"""D AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST, modified_at DESC NULLS LAST, hash DESC NULLS LAST) AS rn
      FROM document_index WHERE id IS NOT NULL) WHERE rn = 1)"""
_C = "C AS (SELECT hash, max(doc) AS doc, min(created_at) AS created_at FROM content WHERE hash IS NOT NULL GROUP BY hash)"
_V = f"""V AS (SELECT hash, unnest(range(0, CAST(ceil(length(doc) / 3600.0) AS BIGINT))) AS seq FROM C
      WHERE doc IS NOT NULL AND length(doc) > 0 AND created_at < TIMESTAMPTZ '{EMBEDDED_BEFORE} 00:00:00+00')"""
_X = """X AS (SELECT name AS collection, CASE WHEN key LIKE '/%' THEN key ELSE '/' || key END AS prefix, json_extract_string(context, '$."' || key || '"') AS text
      FROM (SELECT name, context, unnest(json_keys(context)) AS key FROM store_collections WHERE context IS NOT NULL))"""
_TITLE = r"""regexp_replace(regexp_extract({t}, '(?m)^##?\s+(.+)$', 1), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"""
_STEM = r"regexp_extract(regexp_replace({p}, '\.[^.]+$', ''), '([^/]*)$', 1)"


def _title(t: str, p: str) -> str:
    title, stem = _TITLE.format(t=t), _STEM.format(p=p)
    return f"CASE WHEN lower({p}) LIKE '%.md' AND {title} <> '' THEN {title} ELSE {stem} END"


_S = rf"""S AS (SELECT doc_id, collection, path, sha256(text) AS hash, {_title('text', 'path')} AS title FROM documents
      WHERE text IS NOT NULL AND collection IS NOT NULL AND path IS NOT NULL AND regexp_matches(text, '[^\s\p{{Z}}]'))"""
_OLD = f"""{_S}, O AS (SELECT collection, path, hash, CASE WHEN doc_id % 5 = 0 THEN 'old title' ELSE title END AS title, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS active FROM S WHERE doc_id % 7 <> 0
      UNION ALL SELECT collection, path || '.old', hash, title, 1 FROM S WHERE doc_id % 13 = 0)"""
_DIFF = f"""WITH {_OLD}, B AS (SELECT coalesce(O.collection, S.collection) AS collection, coalesce(O.path, S.path) AS path, O.hash AS oh, O.title AS ot, coalesce(O.active, 0) AS a, S.hash AS nh, S.title AS nt, S.path IS NOT NULL AS seen
      FROM O FULL JOIN S ON O.collection = S.collection AND O.path = S.path),
T AS (SELECT collection, path, CASE WHEN seen AND a = 0 THEN 'indexed' WHEN seen AND (oh <> nh OR ot IS DISTINCT FROM nt) THEN 'updated' WHEN seen THEN 'unchanged'
      WHEN a = 1 AND collection IN (SELECT collection FROM S) THEN 'removed' END AS status FROM B)"""
_Q = "A AS (SELECT * FROM D WHERE active = 1), Q AS (SELECT * FROM A WHERE id % 50 = 0)"
_T = r"""T AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM training_examples WHERE example_id IS NOT NULL) WHERE rn = 1)"""
_TRIM = r"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_WORDS = r"list_filter(regexp_split_to_array(query, '[\s\p{Z}]+'), lambda w: w <> '')"
_CLEAN = r"regexp_replace(regexp_replace({x}, '[^\p{{L}}\p{{N}}$]+', '-', 'g'), '^-+|-+$', '', 'g')"
_HEX = r"""array_to_string(list_transform(range(1, length({x}) + 1), lambda i: CASE WHEN regexp_matches({x}[i], '[\p{{So}}\p{{Sk}}]')
      THEN CASE WHEN i > 1 AND regexp_matches({x}[i - 1], '[\p{{So}}\p{{Sk}}]') THEN '-' ELSE '' END || printf('%x', unicode({x}[i])) ELSE {x}[i] END), '')"""
_DOCID = "substring(hash, 1, 6)"
_CSV = r"""CASE WHEN {x} IS NULL THEN '' WHEN regexp_matches({x}, '[,"\n]') THEN '"' || replace({x}, '"', '""') || '"' ELSE {x} END"""

SQL = {
    "s2_s4_scan_titles": f"WITH {_S} SELECT doc_id, title, hash FROM S",
    "s3_handelize": f"""WITH {_D}, P AS (SELECT id, path, string_split(replace(lower(replace(path, '___', '/')), '/', '/'), '/') AS s FROM D),
H AS (SELECT id, path, list_transform(s, lambda x: {_HEX.format(x='x')}) AS s FROM P),
E AS (SELECT id, path, s, regexp_extract(s[len(s)], '(\\.[a-z0-9]+)$', 1) AS ext FROM H),
N AS (SELECT id, path, list_append(list_transform(s[1:len(s) - 1], lambda x: {_CLEAN.format(x='x')}), {_CLEAN.format(x="substring(s[len(s)], 1, length(s[len(s)]) - length(ext))")} || ext) AS s FROM E)
SELECT id, CASE WHEN regexp_matches(regexp_replace(regexp_extract(path, '([^/]+)/*$', 1), '\\.[^.]+$', ''), '[\\p{{L}}\\p{{N}}\\p{{So}}\\p{{Sk}}$]') THEN array_to_string(list_filter(s, lambda x: x <> ''), '/') END AS clean_path FROM N""",
    "s4_titles": f"WITH {_D}, {_C} SELECT id, {_title('C.doc', 'D.path')} AS title FROM D JOIN C USING (hash) WHERE active = 1 AND doc IS NOT NULL",
    "s8_s9_config_changes": f"""WITH {_D}, U AS (SELECT DISTINCT collection FROM D WHERE active = 1), N AS (SELECT DISTINCT name FROM store_collections)
SELECT coalesce(name, collection) AS collection, CASE WHEN collection IS NULL THEN 'empty' WHEN name IS NULL THEN 'deleted' ELSE 'kept' END AS status FROM N FULL JOIN U ON name = collection""",
    "sel_p1_p2_active_in_collections": f"WITH {_D} SELECT id, collection, path FROM D WHERE active = 1 AND collection IN ('inbox', 'salty-tensor')",
    "sel_p4_default_collections": f"""WITH {_D} SELECT collection, count(*) AS n FROM D WHERE active = 1 AND collection IN (SELECT name FROM store_collections WHERE include_by_default IS NULL OR include_by_default <> 0) GROUP BY collection""",
    "sel_p5_exact_lookup": f"WITH {_D}, {_Q} SELECT a.collection || '/' || a.path AS query, a.collection, a.path, a.hash FROM A a WHERE a.collection || '/' || a.path IN (SELECT collection || '/' || path FROM Q)",
    "sel_p6_suffix_lookup": f"""WITH {_D}, {_Q}, K AS (SELECT DISTINCT upper(string_split(path, '/')[-1]) AS query FROM Q)
SELECT query, x.collection, x.path, x.hash FROM (SELECT query, min({{'collection': collection, 'path': path, 'hash': hash}}) AS x FROM K JOIN A ON suffix(lower(path), lower(query)) GROUP BY query)""",
    "sel_p8_docid_lookup": f"""WITH {_D}, {_Q}, K AS (SELECT DISTINCT {_DOCID} AS h FROM Q)
SELECT '#' || h AS query, x.collection, x.path, x.hash FROM (SELECT h, min({{'collection': collection, 'path': path, 'hash': hash}}) AS x FROM K JOIN A ON starts_with(hash, h) GROUP BY h)""",
    "sel_p10_fuzzy_lookup": f"""WITH {_D}, {_Q}, K AS (SELECT DISTINCT substring(path, 3) || 'x' AS query FROM Q), P AS (SELECT DISTINCT path FROM A),
L AS (SELECT query, path, CAST(levenshtein(lower(query), lower(path)) AS INTEGER) AS distance FROM K JOIN P ON abs(length(query) - length(path)) <= 3)
SELECT query, path, distance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, path) AS r FROM L WHERE distance <= 3) WHERE r <= 5""",
    "sel_p11_pattern_match": rf"""WITH {_D}, R AS (SELECT name, coalesce(pattern, '**/*.md') AS p, CAST(ignore_patterns AS VARCHAR[]) AS s FROM store_collections),
G AS (SELECT name, list_transform(list_concat([p], coalesce(s, [])), lambda g: '^' || replace(replace(replace(replace(replace(g, '.', '\.'), '**/', '<1>'), '**', '<2>'), '*', '[^/]*'), '<1>', '(?:.*/)?') || '$') AS g FROM R)
SELECT id, collection, path FROM D JOIN G ON name = collection WHERE active = 1 AND regexp_matches(path, replace(g[1], '<2>', '.*'))
 AND len(list_filter(g[2:], lambda x: regexp_matches(path, replace(x, '<2>', '.*')))) = 0""",
    "sel_p11_glob": rf"""WITH {_D}, V AS (SELECT id, path, unnest([path, collection || '/' || path, 'lode://' || collection || '/' || path]) AS v FROM D WHERE active = 1)
SELECT DISTINCT id, path FROM V WHERE regexp_matches(v, '^(?:.*/)?(?:ferry|mirror)/(?:.*/)?[^/]*-[^/]*[0-9]\.md$')""",
    "sel_p12_multi_get": f"""WITH {_D}, {_C} SELECT collection, path, CAST(strlen(doc) AS INTEGER) AS n_bytes, CASE WHEN doc IS NULL THEN 'purged' WHEN strlen(doc) > 10240 THEN 'larger than 10240 bytes' END AS skip_reason,
 CASE WHEN strlen(doc) <= 10240 THEN md5(doc) END AS body_md5 FROM D JOIN C USING (hash) WHERE active = 1""",
    "sel_p13_find_documents": f"""WITH {_D}, {_Q}, K AS (SELECT DISTINCT CASE id % 3 WHEN 0 THEN {_DOCID} WHEN 1 THEN collection || '/' || path ELSE string_split(path, '/')[-1] END AS query FROM Q),
H AS (SELECT query, 0 AS priority, collection, path, hash FROM K JOIN A ON regexp_matches(query, '^[a-fA-F0-9]{{6,}}$') AND starts_with(hash, lower(query))
 UNION ALL SELECT query, 1, collection, path, hash FROM K JOIN A ON query = collection || '/' || path
 UNION ALL SELECT query, 2, collection, path, hash FROM K JOIN A ON suffix(lower(path), lower(query)))
SELECT query, x.priority, x.collection, x.path, x.hash FROM (SELECT query, min({{'priority': priority, 'collection': collection, 'path': path, 'hash': hash}}) AS x FROM H GROUP BY query)""",
    "sel_p14_body_lines": f"WITH {_C} SELECT hash, array_to_string(string_split(doc, chr(10))[3:6], chr(10)) AS lines FROM C WHERE doc IS NOT NULL",
    "sel_p15_list_files": f"WITH {_D} SELECT path, title, hash FROM D WHERE active = 1 AND collection = 'transient-corpus' AND path LIKE 'f%'",
    "sel_p17_visible_paths": f"WITH {_D} SELECT collection, count(*) AS n FROM D WHERE len(list_filter(string_split(path, '/'), lambda s: s LIKE '.%')) = 0 GROUP BY collection",
    "j3_documents_with_content": f"WITH {_D}, {_C} SELECT id, hash, CAST(length(doc) AS INTEGER) AS n_chars FROM D JOIN C USING (hash) WHERE active = 1",
    "j4_e1_pending": (_PENDING := f"""WITH {_D}, {_C}, {_V}, E AS (SELECT hash, ceil(length(doc) / 3600.0) + CASE WHEN hash LIKE '0%' THEN 1 ELSE 0 END AS total FROM C WHERE doc IS NOT NULL),
N AS (SELECT hash, count(*) AS stored FROM V GROUP BY hash), P AS (SELECT hash, min(path) AS path FROM D WHERE active = 1 GROUP BY hash)
SELECT P.hash, P.path, CAST(strlen(doc) AS INTEGER) AS n_bytes FROM P JOIN C USING (hash) LEFT JOIN N USING (hash) LEFT JOIN E USING (hash) WHERE doc IS NOT NULL AND (stored IS NULL OR stored < total)"""),
    "a3_pending_count": f"SELECT count(DISTINCT hash) AS n_pending, CAST(coalesce(sum(n_bytes), 0) AS BIGINT) AS n_bytes FROM ({_PENDING})",
    "j6_orphaned_content": f"WITH {_D}, {_C} SELECT hash FROM C WHERE hash NOT IN (SELECT hash FROM D WHERE active = 1 AND hash IS NOT NULL)",
    "j7_orphaned_vectors": f"WITH {_D}, {_C} SELECT hash, CAST(ceil(length(doc) / 3600) AS BIGINT) AS n_vectors FROM C WHERE length(doc) > 0 AND hash NOT IN (SELECT hash FROM D WHERE active = 1 AND hash IS NOT NULL)",
    "j8_stored_chunks": f"WITH {_D}, {_C}, {_V} SELECT id, hash FROM D WHERE active = 1 AND hash IN (SELECT hash FROM V)",
    "j9_m2_scan_diff": f"{_DIFF} SELECT collection, path, status FROM T WHERE status IS NOT NULL",
    "m4_scan_counters": f"{_DIFF} SELECT collection, status, count(*) AS n FROM T WHERE status IS NOT NULL GROUP BY 1, 2",
    "m2_merged_documents": f"""WITH {_OLD} SELECT coalesce(O.collection, S.collection) AS collection, coalesce(O.path, S.path) AS path, coalesce(S.hash, O.hash) AS hash,
 CASE WHEN S.path IS NOT NULL THEN S.title ELSE O.title END AS title, CASE WHEN S.path IS NOT NULL THEN 1 WHEN O.collection IN (SELECT collection FROM S) THEN 0 ELSE O.active END AS active
 FROM O FULL JOIN S ON O.collection = S.collection AND O.path = S.path""",
    "m1_new_content": "SELECT DISTINCT sha256(text) AS hash FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT hash FROM content WHERE hash IS NOT NULL)",
    "m6_renamed_collection": f"WITH {_D} SELECT CASE WHEN collection = 'inbox' THEN 'inbox-2' ELSE collection END AS collection, count(*) AS n FROM D GROUP BY 1",
    "m7_collections_without_context": f"WITH {_X} SELECT DISTINCT name AS collection FROM store_collections WHERE name NOT IN (SELECT collection FROM X)",
    "j10_x1_inherited_context": f"""WITH {_D}, {_X}, A AS (SELECT DISTINCT collection, path FROM D WHERE active = 1),
H AS (SELECT DISTINCT a.collection, a.path, prefix, text FROM A a LEFT JOIN X x ON a.collection = x.collection AND starts_with('/' || ltrim(a.path, '/'), prefix))
SELECT collection, path, 'All notes.' || coalesce(chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY length(prefix), prefix, text), '') AS context FROM H GROUP BY 1, 2""",
    "x2_nearest_context": f"""WITH {_D}, {_X}, A AS (SELECT DISTINCT collection, path FROM D WHERE active = 1),
H AS (SELECT a.collection, a.path, prefix, text FROM A a LEFT JOIN X x ON a.collection = x.collection AND starts_with('/' || ltrim(a.path, '/'), prefix))
SELECT collection, path, coalesce(arg_max(text, (length(prefix), prefix)), 'All notes.') AS context FROM H GROUP BY 1, 2""",
    "k6_context_listing": f"WITH {_X} SELECT collection, prefix, text FROM X",
    "x16_owning_collection": f"""WITH {_D}, F AS (SELECT DISTINCT '/srv/vault/' || collection || '/' || path AS file FROM D WHERE active = 1),
R AS (SELECT name, regexp_replace(path, '/+$', '') AS root FROM store_collections WHERE path IS NOT NULL)
SELECT file, arg_max(name, (length(root), name)) AS collection FROM F JOIN R ON root <> '' AND (file = root OR starts_with(file, root || '/')) GROUP BY file""",
    "a1_collection_status": f"WITH {_D} SELECT collection, count(*) AS n_documents, CAST(sum(CASE WHEN active = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_active, epoch_us(max(modified_at)) AS last_modified FROM D GROUP BY collection",
    "a2_active_by_collection": f"WITH {_D} SELECT collection, count(*) AS n, epoch_us(max(modified_at)) AS last_modified FROM D WHERE active = 1 GROUP BY collection",
    "a4_vector_counts": f"WITH {_C}, {_V} SELECT hash, count(*) AS n_vectors FROM V GROUP BY hash",
    "a5_first_path": f"WITH {_D} SELECT hash, min(path) AS path, count(*) AS n_documents FROM D WHERE active = 1 GROUP BY hash",
    "a6_days_stale": f"WITH {_D} SELECT collection, CAST(date_diff('day', CAST(max(modified_at) AT TIME ZONE 'UTC' AS DATE), DATE '{NOW}') AS INTEGER) AS days_stale FROM D WHERE active = 1 GROUP BY collection",
    "a7_collection_sizes": f"WITH {_D} SELECT collection, count(*) AS n FROM D WHERE active = 1 GROUP BY collection",
    "a8_directories_without_context": f"""WITH {_D}, {_X} SELECT DISTINCT collection, string_split(path, '/')[1] AS directory FROM D WHERE active = 1 AND contains(path, '/')
 AND (collection, string_split(path, '/')[1]) NOT IN (SELECT collection, trim(prefix, '/') FROM X)""",
    "k4_latest_delivery": "SELECT id, epoch_us(loaded_at) AS loaded_at FROM document_index ORDER BY document_index.loaded_at DESC NULLS LAST, id DESC LIMIT 1",
    "k5_cache_eviction": "SELECT event_id FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 1000",
    "d1_distinct_files": f"WITH {_D} SELECT hash, collection, path FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY collection, path, id) AS r FROM D WHERE active = 1) WHERE r = 1",
    "f1_wrong_hashes": "SELECT hash = sha256(doc) AS hash_is_right, count(*) AS n FROM content WHERE doc IS NOT NULL GROUP BY 1",
    "f1_cache_keys": """SELECT item_id, sha256('expandQuery' || '{"query":' || CAST(to_json(query) AS VARCHAR) || '}') AS cache_key FROM eval_items""",
    "f2_docids": f"WITH {_D} SELECT {_DOCID} AS docid, count(DISTINCT hash) AS n_hashes, min(hash) AS first_hash FROM D WHERE hash IS NOT NULL GROUP BY 1",
    "f3_title_distance": "SELECT doc_id, CAST(levenshtein(regexp_replace(title, '[^ -~]', '?', 'g'), regexp_replace(path, '[^ -~]', '?', 'g')) AS INTEGER) AS distance FROM documents WHERE title IS NOT NULL AND path IS NOT NULL",
    "f6_virtual_paths": f"WITH {_D} SELECT id, collection, path FROM D",
    "f7_lengths": f"WITH {_C} SELECT hash, CAST(length(doc) AS INTEGER) AS n_chars, CAST(strlen(doc) AS INTEGER) AS n_bytes FROM C WHERE doc IS NOT NULL",
    "f8_numbered_lines": "SELECT item_id, array_to_string(list_transform(string_split(content, chr(10)), lambda x, i: CAST(i + 9 AS VARCHAR) || ': ' || x), chr(10)) AS numbered FROM eval_items",
    "f8_numbered_bodies": f"WITH {_C} SELECT hash, array_to_string(list_transform(string_split(doc, chr(10)), lambda x, i: CAST(i + 9 AS VARCHAR) || ': ' || x), chr(10)) AS numbered FROM C",
    "f9_s12_escapes": f"""WITH {_D} SELECT id, {_CSV.format(x='title')} AS csv, replace(replace(replace(replace(replace(coalesce(title, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM D""",
    "s12_csv_rows": f"WITH {_D} SELECT id, '#' || {_DOCID} || ',' || {_CSV.format(x='path')} || ',' || {_CSV.format(x='title')} AS line FROM D WHERE active = 1",
    "f13_age_days": f"""WITH {_D} SELECT id, CAST(date_diff('day', CAST(created_at AT TIME ZONE 'UTC' AS DATE), CAST(modified_at AT TIME ZONE 'UTC' AS DATE)) AS INTEGER) AS days FROM D WHERE modified_at IS NOT NULL AND created_at IS NOT NULL""",
    "f14_context_maps": f"WITH {_X} SELECT collection, prefix, text FROM X",
    "x7_index_status": f"""WITH {_D} SELECT count(*) AS n_documents, CAST(sum(CASE WHEN active = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_active, count(DISTINCT CASE WHEN active = 1 THEN hash END) AS n_hashes, count(DISTINCT collection) AS n_collections FROM D""",
    "x14_training_pairs": f"""WITH {_T}, I AS (SELECT example_id, i, output[i].type AS type, {_TRIM.format(x='output[i].text')} AS text FROM (SELECT example_id, output, unnest(range(1, len(output) + 1)) AS i FROM T))
SELECT example_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY CASE type WHEN 'hyde' THEN 0 WHEN 'lex' THEN 1 ELSE 2 END, i) - 1 AS INTEGER) AS seq, type, text FROM I WHERE type IN ('lex', 'vec', 'hyde') AND text <> ''""",
    "x15_training_statistics": rf"""WITH {_T}, W AS (SELECT *, {_WORDS} AS w FROM T WHERE query IS NOT NULL)
SELECT count(*) AS total, CAST(sum(CASE WHEN len(w) <= 2 THEN 1 ELSE 0 END) AS BIGINT) AS short, CAST(sum(CASE WHEN len(w) > 2 AND len(w) <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS medium,
 CAST(sum(CASE WHEN len(w) > 5 THEN 1 ELSE 0 END) AS BIGINT) AS long, count(*) - count(DISTINCT lower(query)) AS duplicates,
 CAST(sum(CASE WHEN len(list_filter(w, lambda x: lower(x) NOT IN ('the', 'a', 'an', 'is', 'are', 'to', 'for', 'of', 'in', 'and', 'or') AND length(x) > 1 AND (regexp_matches(x, '^\p{{Lu}}') OR regexp_matches(x, '[.+\-0-9]')))) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_entity,
 CAST(sum(CASE WHEN len(list_filter(output, lambda x: x.type = 'lex')) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_lex, CAST(sum(CASE WHEN len(list_filter(output, lambda x: x.type = 'vec')) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_vec,
 CAST(sum(CASE WHEN len(list_filter(output, lambda x: x.type = 'hyde')) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_hyde, CAST(sum(coalesce(len(list_filter(output, lambda x: x.type = 'hyde' AND length(x.text) > 200)), 0)) AS BIGINT) AS long_hyde FROM W""",
    "x15_query_categories": rf"""WITH {_T}, W AS (SELECT lower(query) AS q, {_WORDS} AS w FROM T WHERE query IS NOT NULL)
SELECT CASE WHEN len(w) <= 2 THEN 'short_keyword' WHEN len(list_filter(w, lambda x: regexp_matches(x, '^\p{{Lu}}'))) > 0 THEN 'named_entity' WHEN regexp_matches(q, 'latest|recent|new|update|changelog|changed|version|release|news|2024|2025') THEN 'temporal'
 WHEN q LIKE 'how %' THEN 'how_to' WHEN q LIKE 'what %' THEN 'what_is' WHEN regexp_matches(q, 'difference|vs|versus|compare') THEN 'comparison' WHEN regexp_matches(q, 'meeting|notes|journal|ideas|thoughts') THEN 'personal' ELSE 'other' END AS category, count(*) AS n FROM W GROUP BY 1""",
    "e11_tumbling_counts": "SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
