"""Prompt screening over a text table: PII masks, normalisation, symbolic
veto (the Stage-1 prefix of the cascade) and request validation."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.config import RulePack
from riskframe.functions import rules as R
from riskframe.functions import text as X


def screen_prompts(df: DataFrame, text_col: str = "text", rules: RulePack | None = None,
                   unicode_forms: bool = True) -> DataFrame:
    """Adds ``clean_text``, ``redacted_items``, ``pii_found``, ``normalized``
    and ``violation``.  Row-local: no shuffle, one scan."""
    df = X.with_redaction(df, text_col)
    df = df.withColumn("pii_found", F.size("redacted_items") > 0)
    df = df.withColumn("normalized", X.normalize_prompt("clean_text", unicode_forms))
    # normalized text is already lower-case (lower is idempotent on it)
    return df.withColumn("violation", R.symbolic_violation("normalized", rules, lowered=True))


def veto_tally(screened: DataFrame, key: str = "source") -> DataFrame:
    """Per-key tally of masked and vetoed prompts (partial aggregation
    map-side, one shuffle of at most #keys rows per task)."""
    v = F.col("violation")
    return (screened.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if("pii_found").alias("n_pii_docs"),
        F.sum(F.size("redacted_items").cast("long")).alias("n_pii_items"),
        F.count_if(v == "JAILBREAK_DETECTED").alias("n_jailbreak"),
        F.count_if(v == "INSTRUCTION_OVERRIDE_DETECTED").alias("n_override"),
        F.count_if(v == "HARD_BAN_DETECTED").alias("n_hard_ban"),
        F.count_if(v.isNotNull()).alias("n_vetoed")))


def validate_requests(df: DataFrame, text_col: str = "text", lo: int = C.MIN_PROMPT_CHARS,
                      hi: int = C.MAX_PROMPT_CHARS) -> DataFrame:
    """accepted/rejected split as a ``reason`` column (null = accepted)."""
    n = F.length(F.col(text_col))
    reason = (F.when(F.col(text_col).isNull(), "missing")
              .when(n < lo, "too_short")
              .when(n > hi, "too_long"))
    return df.withColumn("reject_reason", reason)
