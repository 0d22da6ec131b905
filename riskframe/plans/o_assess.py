"""DuckDB formulation for :mod:`riskframe.plans.q_assess`."""
from __future__ import annotations

from riskframe.plans import bound, o_vectors
from riskframe.plans import sqlfrag as S

_RED, _RED_OUT = S.redaction_ctes("documents", "text", "doc_id, text")
_NZ, _NZ_OUT = S.normalize_ctes(_RED_OUT, "clean_text")
_JUDGED = """CASE WHEN hazard = 'DANGEROUS' THEN 'llama_guard_arbitration'
  WHEN hazard = 'SAFE' THEN CASE WHEN tp THEN 'llama_guard_override_restricted' ELSE 'llama_guard_override_capped' END
  WHEN judge_verdict = 'DANGEROUS' THEN 'semantic_judge' WHEN judge_verdict = 'AMBIGUOUS' THEN 'semantic_judge_ambiguous'
  WHEN judge_verdict = 'SAFE' THEN CASE WHEN tp THEN 'semantic_judge_override_restricted' ELSE 'semantic_judge_override_capped' END
  ELSE 'judge_failure_fail_closed' END"""

CASCADE = f"""
WITH {_RED},
{_NZ},
ve AS (SELECT doc_id, sha256(text) AS h, {S.symbolic_case('normalized', bound.RULES)} AS violation FROM {_NZ_OUT}),
ca AS (SELECT sha256(d.text) AS h, max(toxic) AS t FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1 OR quality = 1 GROUP BY 1),
{o_vectors.SIG},
{o_vectors._PC},
{o_vectors._cascade_body()},
x AS (SELECT ve.doc_id, ve.violation, ca.t, v0.*, CASE label % 3 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'DANGEROUS' END AS hazard
      FROM ve LEFT JOIN ca ON ve.h = ca.h LEFT JOIN v0 ON v0.vec_id = ve.doc_id),
y AS (SELECT *, CASE WHEN t IS NOT NULL THEN 'cache' WHEN violation IS NOT NULL THEN 'veto' WHEN fast_src IS NOT NULL THEN 'fast'
                     WHEN vec_id IS NULL THEN 'open' WHEN f_judge THEN 'judge' ELSE 'fused' END AS stage, {_JUDGED} AS judged FROM x),
z AS (SELECT doc_id, CASE stage WHEN 'cache' THEN CASE WHEN t = 1 THEN 'HIGH' ELSE 'LOW' END WHEN 'open' THEN 'LOW' WHEN 'fused' THEN f_risk
               WHEN 'judge' THEN CASE WHEN judged IN ('llama_guard_arbitration', 'semantic_judge', 'judge_failure_fail_closed') THEN 'HIGH' ELSE 'MEDIUM' END
               ELSE 'HIGH' END AS risk,
             CASE stage WHEN 'cache' THEN CASE WHEN t = 1 THEN 'cache_locked_high' ELSE 'cache' END WHEN 'veto' THEN 'symbolic_rule'
               WHEN 'fast' THEN fast_src WHEN 'open' THEN 'clean_pass' WHEN 'judge' THEN judged ELSE f_src END AS source,
             round(CASE stage WHEN 'cache' THEN CASE WHEN t = 1 THEN 1.0 ELSE 0.05 END WHEN 'open' THEN 0.0 WHEN 'judge' THEN w_score
               WHEN 'fused' THEN w_score ELSE 1.0 END, 6) AS semantic_score,
             CASE WHEN stage IN ('judge', 'fused') THEN f_topic ELSE 'UNKNOWN' END AS topicality,
             stage = 'judge' AS judge_invoked, stage = 'veto' AS symbolic_triggered,
             CASE WHEN stage IN ('judge', 'fused') THEN triggering_class END AS triggering_class FROM y)
SELECT *, CASE risk WHEN 'HIGH' THEN 'BLOCK' WHEN 'MEDIUM' THEN 'RESTRICT' ELSE 'ALLOW' END AS decision FROM z"""

ORACLE = {"assess_cascade": CASCADE}
