"""DuckDB formulations for :mod:`riskframe.plans.q_corpus`."""
from __future__ import annotations

from riskframe import config as C
from riskframe.plans import bound
from riskframe.plans.q_corpus import REQUEST_CHARS
from riskframe.plans.sqlfrag import q, str_list


def lang_expr(t: str) -> str:
    tokens = f"list_distinct(regexp_extract_all(lower({t}), {q(C.LANG_TOKEN_PATTERN)}, 0))"
    de = (f"(len(list_intersect({tokens}, {str_list(C.DE_MARKERS)})) + "
          f"CASE WHEN regexp_matches({t}, {q('[' + C.GERMAN_CHARS + ']')}) THEN 2 ELSE 0 END)")
    en = f"len(list_intersect({tokens}, {str_list(C.EN_MARKERS)}))"
    return (f"CASE WHEN len({tokens}) = 0 THEN 'other' WHEN {de} = 0 AND {en} = 0 THEN 'other' "
            f"WHEN {de} > {en} THEN 'de' WHEN {en} > {de} THEN 'en' ELSE 'other' END")


KEY = ("trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', '', 'g'), "
       "'\\s+', ' ', 'g'))")

DOCS = f"""d AS (SELECT *, CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS priority, {KEY} AS dedup_key,
                 length(trim(text)) >= 3 AND length({KEY}) > 0 AS valid FROM documents)"""

LANG_CROSSTAB = f"""
SELECT lang, {lang_expr('text')} AS language, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY ALL"""

DEDUP = f"""
WITH {DOCS},
r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY priority, doc_id) AS rn,
             count(*) OVER (PARTITION BY dedup_key) AS copies FROM d WHERE valid)
SELECT substr(sha1(dedup_key), 1, 16) AS id, doc_id, source, {lang_expr('text')} AS language,
       CAST(copies AS BIGINT) AS copies FROM r WHERE rn = 1"""

MANIFEST = f"""
WITH {DOCS},
l AS (SELECT d.*, labels.toxic AS label FROM d LEFT JOIN labels ON d.doc_id = labels.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY priority, doc_id) AS rn FROM l WHERE valid),
raw AS (SELECT source, count(*) AS raw_rows, count(*) FILTER (WHERE valid) AS valid_rows FROM d GROUP BY source),
k AS (SELECT source, count(*) AS kept, count(*) FILTER (WHERE label = 1) AS attacks,
             count(*) FILTER (WHERE label = 0) AS benign FROM r WHERE rn = 1 GROUP BY source)
SELECT raw.source, CAST(raw_rows AS BIGINT) AS raw_rows, CAST(raw_rows - valid_rows AS BIGINT) AS short_dropped,
       CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(valid_rows - coalesce(kept, 0) AS BIGINT) AS duplicates_dropped,
       CAST(coalesce(attacks, 0) AS BIGINT) AS attacks, CAST(coalesce(benign, 0) AS BIGINT) AS benign
FROM raw LEFT JOIN k ON raw.source = k.source"""

CAP = """
SELECT doc_id, source FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) AS rn
  FROM documents) WHERE rn <= 20"""

INTENT = ("CASE WHEN " + " OR ".join(f"contains(lower(text), {q(p)})" for p in bound.RULES.suspicious)
          + " THEN 'HIGH' WHEN " + " OR ".join(f"contains(lower(text), {q(p)})" for p in bound.MEDIUM_PHRASES)
          + " THEN 'MEDIUM' ELSE 'LOW' END")

SLICES = f"""
WITH x AS (SELECT d.source, {lang_expr('d.text')} AS language,
                  CASE WHEN l.toxic = 1 THEN 'harmful' ELSE 'benign' END AS attack_class, l.toxic AS label,
                  ({INTENT.replace('(text)', '(d.text)')}) <> 'LOW' AS flagged
           FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT attack_class, language, source, GROUPING(attack_class, language, source) AS gid,
             CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE label = 1) AS BIGINT) AS n_attack,
             CAST(count(*) FILTER (WHERE flagged) AS BIGINT) AS n_flagged
      FROM x GROUP BY GROUPING SETS ((attack_class), (language), (source), ()))
SELECT CASE WHEN gid = 3 THEN 'attack_class' WHEN gid = 5 THEN 'language' WHEN gid = 6 THEN 'source' ELSE 'all' END AS slice_kind,
       CASE WHEN gid = 3 THEN attack_class WHEN gid = 5 THEN language WHEN gid = 6 THEN source END AS slice_value,
       n, n_attack, n_flagged FROM m"""

VALIDATION = f"""
WITH x AS (SELECT source, text FROM documents UNION ALL
           SELECT 'conversation', r.text FROM conversations p LEFT JOIN conversations r
           ON r.conv_id = p.conv_id AND r.turn = p.turn + 1 AND r.role = 'assistant' WHERE p.role = 'user')
SELECT source, CASE WHEN text IS NULL THEN 'missing' WHEN length(text) < {REQUEST_CHARS[0]} THEN 'too_short'
                    WHEN length(text) > {REQUEST_CHARS[1]} THEN 'too_long' ELSE 'accepted' END AS status,
       CAST(count(*) AS BIGINT) AS n FROM x GROUP BY ALL"""

TODO_SQL = "SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)"

BUILD_SUITE = f"""
WITH d0 AS (SELECT d.*, l.toxic AS label, CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INTEGER) AS priority
            FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source
              ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) AS rn FROM d0) WHERE rn <= 45),
k AS (SELECT *, {KEY} AS dedup_key FROM capped),
v AS (SELECT * FROM k WHERE length(trim(text)) >= 3 AND length(dedup_key) > 0),
w AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY priority, doc_id) AS r2 FROM v),
kept AS (SELECT substr(sha1(dedup_key), 1, 16) AS id, doc_id, source, label, {lang_expr('text')} AS language
         FROM w WHERE r2 = 1),
bc AS (SELECT * FROM kept WHERE label <> 0
       UNION ALL
       SELECT id, doc_id, source, label, language FROM (
         SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42')) AS r3 FROM kept WHERE label = 0)
       WHERE r3 <= 120)
SELECT id, doc_id, source, label, language, md5(id || ':42') AS shuffle_key FROM bc"""

UNCAPPED = f"""
WITH k AS (SELECT d.*, coalesce(l.toxic, 0) AS label, CAST(regexp_extract(d.source, '(\\d+)$', 1) AS INTEGER) AS priority, {KEY} AS dedup_key
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
w AS (SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY priority, doc_id) AS rn FROM k
      WHERE length(trim(text)) >= 3 AND length(dedup_key) > 0)
SELECT substr(sha1(dedup_key), 1, 16) AS id, doc_id, source, label, {lang_expr('text')} AS language,
       md5(substr(sha1(dedup_key), 1, 16) || ':42') AS shuffle_key FROM w WHERE rn = 1"""

REQUEST_IDS = """
WITH p AS (SELECT page_id, trim(regexp_extract(url, '[^/]*$', 0)) AS raw,
                  substr(sha256('page:' || CAST(page_id AS VARCHAR)), 1, 32) AS minted FROM pages),
q AS (SELECT page_id, minted, CASE WHEN length(raw) > 0 AND length(raw) <= 64 AND regexp_full_match(raw, '[A-Za-z0-9._:-]+')
                               THEN raw ELSE minted END AS request_id FROM p)
SELECT page_id, request_id, request_id = minted AS minted FROM q"""

ORACLE = {
    "request_ids": REQUEST_IDS,
    "build_suite_uncapped": UNCAPPED,
    "build_suite": BUILD_SUITE,
    "language_tag_crosstab": LANG_CROSSTAB,
    "dedup_first_wins": DEDUP,
    "suite_manifest": MANIFEST,
    "source_cap_sample": CAP,
    "slice_report": SLICES,
    "request_validation": VALIDATION,
    "incremental_todo": TODO_SQL,
}
