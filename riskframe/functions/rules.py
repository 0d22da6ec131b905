"""Symbolic rule matching (P5) and the phrase-intent tagger."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.config import RulePack


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alternation(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def any_substring(c, keywords) -> Column:
    c = _col(c)
    out = F.lit(False)
    for k in keywords:
        out = out | (F.instr(c, k) > 0)
    return out


def symbolic_violation(normalized, rules: RulePack | None = None, lowered: bool = False) -> Column:
    """First matching kind on already-normalised text, else null:
    jailbreak regex -> instruction-override regex -> hard-ban substring.
    A pack that failed to load fails closed with SYMBOLIC_POLICY_MISSING."""
    rules = rules or RulePack()
    if not rules.loaded:
        return F.lit("SYMBOLIC_POLICY_MISSING")
    t = _col(normalized) if lowered else F.lower(_col(normalized))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    if rules.jailbreak:
        out = out.when(t.rlike(alternation(rules.jailbreak)), "JAILBREAK_DETECTED")
    if rules.override:
        out = out.when(t.rlike(alternation(rules.override)), "INSTRUCTION_OVERRIDE_DETECTED")
    if rules.hard_ban:
        out = out.when(any_substring(t, rules.hard_ban), "HARD_BAN_DETECTED")
    # One scan with the union of every rule decides "no violation" for the
    # bulk of rows; only rows that match something evaluate the priority
    # order above.  Exact: any kind matching implies the union matches.
    union = rules.jailbreak + rules.override + [_quote(k) for k in rules.hard_ban]
    if not union:
        return out
    return F.when(t.rlike(alternation(union)), out)


def _quote(literal: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in literal)


def phrase_intent(text, rules: RulePack | None = None, medium=("how to", "steps")) -> Column:
    """HIGH on a suspicious phrase, MEDIUM on one of ``medium``, else LOW."""
    rules = rules or RulePack()
    t = F.lower(_col(text))
    return (F.when(any_substring(t, rules.suspicious), "HIGH")
            .when(any_substring(t, medium), "MEDIUM")
            .otherwise("LOW"))


def load_rule_pack(spark, path: str) -> RulePack:
    """Reads a JSON rule file (lists per kind).  A missing or unreadable
    file yields a pack with ``loaded=False`` (fail closed), which is not the
    same as an empty list of rules."""
    try:
        row = spark.read.option("multiLine", True).json(path).first()
    except Exception:  # noqa: BLE001 - absence is a state, not an error
        return RulePack(jailbreak=[], override=[], hard_ban=[], suspicious=[], loaded=False)
    d = row.asDict() if row is not None else {}
    need = ("jailbreak_patterns", "instruction_override_patterns", "hard_ban_keywords")
    if any(d.get(k) is None for k in need):
        return RulePack(jailbreak=[], override=[], hard_ban=[], suspicious=[], loaded=False)
    return RulePack(jailbreak=list(d["jailbreak_patterns"]),
                    override=list(d["instruction_override_patterns"]),
                    hard_ban=list(d["hard_ban_keywords"]),
                    suspicious=list(d.get("suspicious_phrases") or []), loaded=True)
