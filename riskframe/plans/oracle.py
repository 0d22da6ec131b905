"""DuckDB formulations of the registered queries (the correctness gate)."""
from __future__ import annotations

from riskframe.plans import bound
from riskframe.plans import sqlfrag as S


def _symbolic_veto_by_source() -> str:
    red, red_out = S.redaction_ctes("documents", "text", "doc_id, source")
    nz, nz_out = S.normalize_ctes(red_out, "clean_text")
    return f"""
WITH {red},
{nz},
v AS (SELECT source, redacted_items, {S.symbolic_case('normalized', bound.RULES)} AS violation FROM {nz_out})
SELECT source,
       CAST(count(*) AS BIGINT) AS n_docs,
       CAST(sum(CASE WHEN len(redacted_items) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pii_docs,
       CAST(sum(len(redacted_items)) AS BIGINT) AS n_pii_items,
       CAST(sum(CASE WHEN violation = 'JAILBREAK_DETECTED' THEN 1 ELSE 0 END) AS BIGINT) AS n_jailbreak,
       CAST(sum(CASE WHEN violation = 'INSTRUCTION_OVERRIDE_DETECTED' THEN 1 ELSE 0 END) AS BIGINT) AS n_override,
       CAST(sum(CASE WHEN violation = 'HARD_BAN_DETECTED' THEN 1 ELSE 0 END) AS BIGINT) AS n_hard_ban,
       CAST(sum(CASE WHEN violation IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_vetoed
FROM v GROUP BY source"""


def _pii_redact_regex() -> str:
    red, red_out = S.redaction_ctes("documents", "text", "doc_id")
    return f"""
WITH {red}
SELECT doc_id,
       CAST(len(redacted_items) AS BIGINT) AS n_items,
       array_to_string(redacted_items, '|') AS items,
       CAST(length(clean_text) AS BIGINT) AS clean_len,
       sha256(clean_text) AS clean_sha256
FROM {red_out}"""


ORACLE = {
    "symbolic_veto_by_source": _symbolic_veto_by_source(),
    "pii_redact_regex": _pii_redact_regex(),
}

from riskframe.plans import o_eval  # noqa: E402

ORACLE.update(o_eval.ORACLE)

from riskframe.plans import o_corpus  # noqa: E402

ORACLE.update(o_corpus.ORACLE)

from riskframe.plans import o_vectors  # noqa: E402

ORACLE.update(o_vectors.ORACLE)

from riskframe.plans import o_ops  # noqa: E402

ORACLE.update(o_ops.ORACLE)

from riskframe.plans import o_detect  # noqa: E402

ORACLE.update(o_detect.ORACLE)

from riskframe.plans import o_more  # noqa: E402

ORACLE.update(o_more.ORACLE)

from riskframe.plans import o_fields  # noqa: E402

ORACLE.update(o_fields.ORACLE)

from riskframe.plans import o_assess  # noqa: E402

ORACLE.update(o_assess.ORACLE)

from riskframe.plans import o_learn  # noqa: E402

ORACLE.update(o_learn.ORACLE)

from riskframe.plans import o_stores  # noqa: E402

ORACLE.update(o_stores.ORACLE)

from riskframe.plans import o_reports  # noqa: E402

ORACLE.update(o_reports.ORACLE)
