"""DuckDB formulations for :mod:`riskframe.plans.q_reports`."""
from __future__ import annotations

from riskframe.plans import bound, o_corpus, o_eval, o_ops, o_vectors
from riskframe.plans import q_reports as Q
from riskframe.plans import sqlfrag as S

LOAD = """
SELECT 'documents' AS source, 'ok' AS status, false AS has_reason, (SELECT count(*) FROM documents) AS n_rows, 0 AS priority
UNION ALL SELECT 'missing', 'skipped', true, 0, NULL
UNION ALL SELECT 'conversations', 'ok', false, (SELECT count(*) FROM conversations), 1"""

LABELS = """
SELECT CAST(coalesce(quality, 1) = 0 OR toxic = 1 AS INTEGER) AS label,
    CASE WHEN quality = 0 THEN 'jailbreak' WHEN toxic = 1 THEN 'harmful' ELSE 'benign' END AS attack_class, count(*) AS n FROM labels GROUP BY ALL"""

ANCHORS = """
WITH b AS (SELECT item_id, text, item_id % 3 AS k, CAST(row_number() OVER (PARTITION BY item_id % 3 ORDER BY item_id, text) - 1 AS INTEGER) AS i FROM benchmark)
SELECT CASE k WHEN 0 THEN 'safe' ELSE 'threat' END AS set, CASE k WHEN 0 THEN 'safe' WHEN 1 THEN 'jailbreak' ELSE 'harmful' END AS class, i AS anchor_id, text FROM b
UNION ALL SELECT 'listed', 'listed', NULL, trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')) FROM benchmark"""

RULES = f"""
SELECT 'loaded' AS pack, {S.symbolic_case('text', bound.RULES)} AS violation, count(*) AS n FROM documents GROUP BY ALL
UNION ALL SELECT 'missing', 'SYMBOLIC_POLICY_MISSING', count(*) FROM documents"""

INTERVALS = f"""
SELECT lang, printf('%.3f [%.3f, %.3f]', point, ci_lo, ci_hi) AS auc FROM ({o_eval.ORACLE['bootstrap_auc_ci']})"""

_RISK = lambda v: f"CASE WHEN {v} >= 60 THEN 'HIGH' WHEN {v} >= 20 THEN 'MEDIUM' ELSE 'LOW' END"
_PAIRS = f"""
{o_ops.REUSE.replace("SELECT event_id, h AS prompt_hash, hit, origin AS origin_id FROM r", ", res AS (SELECT event_id, h, hit, origin AS origin_id FROM r)")},
cw AS (SELECT w.event_type, res.h, {_RISK('w.value')} = {_RISK('c.value')} AS same, w.value AS warm_ms, c.value AS cold_ms
    FROM res JOIN events w ON res.event_id = w.event_id JOIN events c ON res.origin_id = c.event_id WHERE res.hit)"""

AGREEMENT = f"""{_PAIRS},
p AS (SELECT event_type, h, count(*) AS n, count(*) FILTER (same) AS s FROM cw GROUP BY ALL)
SELECT event_type, count(*) AS n_prompts, CAST(sum(n) AS BIGINT) AS n_hits, CAST(sum(s) AS BIGINT) AS n_same, count(*) FILTER (n = s) AS n_prompts_agree FROM p GROUP BY event_type"""

QUALITY = f"""
WITH v AS ({o_vectors.ORACLE['operational_vs_strict_confusion']}),
w AS ({_PAIRS} SELECT count(*)::DOUBLE AS n_hits, avg(same::INTEGER) AS agreement, avg(cold_ms) / avg(warm_ms) AS speedup FROM cw)
{" UNION ALL ".join(f"SELECT view AS section, '{m}' AS metric, round({m}, 6) AS value FROM v" for m in ("accuracy", "precision", "recall", "f1", "fpr"))}
{"".join(f" UNION ALL SELECT 'cold_warm', '{m}', round({m}, 6) FROM w" for m in ("n_hits", "agreement", "speedup"))}"""

_NEED = "['" + "', '".join(Q.REQUIRED_FIELDS) + "']"
FIELDS = f"""
WITH h AS (SELECT event_type, coalesce(json_keys(props), []) AS have FROM events),
d AS (SELECT event_type, 'missing' AS kind, unnest(list_filter({_NEED}, lambda f: NOT list_contains(have, f))) AS field FROM h
    UNION ALL SELECT event_type, 'extra', unnest(list_filter(have, lambda f: NOT list_contains({_NEED}, f))) FROM h)
SELECT event_type, kind, field, count(*) AS n FROM d GROUP BY ALL"""

OVERLAP = """
WITH l AS (SELECT DISTINCT lang, unnest(regexp_extract_all(text, '[a-z]+ [a-z]+ [a-z]+')) AS p FROM documents)
SELECT a.lang AS list_a, b.lang AS list_b, count(*) AS n_shared FROM l a JOIN l b ON a.p = b.p AND a.lang < b.lang GROUP BY ALL"""

LIMITED = f"""
SELECT id, source, label, language FROM ({o_corpus.UNCAPPED}) ORDER BY shuffle_key, id LIMIT {Q.LIMIT}"""

_NZ, _OUT = S.normalize_ctes("documents", "text")
NORMALISED = f"WITH {_NZ} SELECT doc_id, sha256(normalized) AS normalised_sha256 FROM {_OUT}"

ORACLE = {
    "source_load_report": LOAD,
    "attack_labels": LABELS,
    "anchor_packs": ANCHORS,
    "rule_pack_verdicts": RULES,
    "interval_labels": INTERVALS,
    "cold_warm_agreement": AGREEMENT,
    "decision_quality_report": QUALITY,
    "missing_fields": FIELDS,
    "pattern_overlap": OVERLAP,
    "limited_suite": LIMITED,
    "normalised_text": NORMALISED,
}
