"""The decision cascade as column expressions.

Each stage is a CASE over signal columns; stages that need a model or a
judge read *tables* (detector scores, judge verdicts) joined by id, so the
expensive part stays a pluggable input and the decisions stay JVM-side.
A fusion policy artifact compiles to a plain arithmetic expression.
"""
from __future__ import annotations

import json

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import config as C

RESOURCES = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "resources")
EXAMPLE_POLICY = os.path.join(RESOURCES, "fusion_policy_example.json")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _risk_struct(risk, source, judge=False) -> Column:
    return F.struct(F.lit(risk).alias("risk"), F.lit(source).alias("source"),
                    F.lit(judge).alias("judge_required"))


# --- C1 fast path ----------------------------------------------------------------

def fast_path(meta, threat, th: C.Thresholds = C.Thresholds()) -> Column:
    """Escalate-only: meta >= t_meta -> HIGH, else anchor >= t_high -> HIGH,
    else null (continue)."""
    return (F.when(_col(meta) >= th.meta, _risk_struct("HIGH", "fast_path_meta_intent"))
            .when(_col(threat) >= th.high, _risk_struct("HIGH", "fast_path_anchor_critical")))


# --- C3 fuse_signals ------------------------------------------------------------------

def topicality(domain_aligned) -> Column:
    d = _col(domain_aligned)
    return F.when(d.isNull(), "UNKNOWN").when(d, "IN_DOMAIN").otherwise("OUT_OF_DOMAIN")


def fuse_signals(meta, threat, is_educational, domain_aligned=None, fusion_available=None,
                 fusion_score=None, fusion_high=None, fusion_medium=None, domain_mode: str = "off",
                 th: C.Thresholds = C.Thresholds()) -> Column:
    """Returns struct(risk, source, judge_required, topicality)."""
    topic = topicality(domain_aligned) if domain_aligned is not None else F.lit("UNKNOWN")
    edu = F.coalesce(_col(is_educational), F.lit(False))
    c = F.when(_col(meta) >= th.meta, _risk_struct("HIGH", "semantic_meta_intent"))
    if domain_mode == "enforcing":
        c = c.when(topic == "OUT_OF_DOMAIN", _risk_struct("MEDIUM", "domain_guardrail"))
    if fusion_available is not None:
        fa = F.coalesce(_col(fusion_available), F.lit(False))
        s, hi, md = _col(fusion_score), _col(fusion_high), _col(fusion_medium)
        c = (c.when(fa & (s >= hi), _risk_struct("HIGH", "fusion_threat_critical"))
             .when(fa & (s >= md) & edu, _risk_struct("MEDIUM", "fusion_educational_safe_harbor"))
             .when(fa & (s >= md), _risk_struct("MEDIUM", "fusion_judge_pending", True))
             .when(fa, _risk_struct("LOW", "fusion_clean_pass")))
    t = _col(threat)
    c = (c.when(t >= th.high, _risk_struct("HIGH", "vector_threat_critical"))
         .when((t >= th.medium) & edu, _risk_struct("MEDIUM", "educational_safe_harbor"))
         .when(t >= th.medium, _risk_struct("MEDIUM", "judge_pending", True))
         .otherwise(_risk_struct("LOW", "clean_pass")))
    return F.struct(c["risk"].alias("risk"), c["source"].alias("source"),
                    c["judge_required"].alias("judge_required"), topic.alias("topicality"))


# --- C4 band, C5/C6 arbitration -------------------------------------------------------------

def upper_ambiguous_band(score, t_med, t_high) -> Column:
    band = _col(t_high) - _col(t_med)
    return F.when(band <= 0, F.lit(True)).otherwise(_col(score) >= _col(t_med) + band / 2.0)


def judge_arbitration(verdict, threat_present, may_clear_to_low: bool = False) -> Column:
    """Chat-judge verdict -> struct(risk, source).  A null verdict means
    the judge was offline: fail closed to HIGH."""
    v = _col(verdict)
    tp = F.coalesce(_col(threat_present), F.lit(False))

    def rs(r, s):
        return F.struct(F.lit(r).alias("risk"), F.lit(s).alias("source"))
    safe = (F.when(tp, rs("MEDIUM", "semantic_judge_override_restricted"))
            .otherwise(rs("MEDIUM", "semantic_judge_override_capped"))) if not may_clear_to_low else \
        F.when(tp, rs("MEDIUM", "semantic_judge_override_restricted")).otherwise(rs("LOW", "semantic_judge_override"))
    return (F.when(v == "DANGEROUS", rs("HIGH", "semantic_judge"))
            .when(v == "SAFE", safe)
            .when(v == "AMBIGUOUS", rs("MEDIUM", "semantic_judge_ambiguous"))
            .otherwise(rs("HIGH", "judge_failure_fail_closed")))


def hazard_arbitration(verdict, threat_present, may_clear_to_low: bool = False) -> Column:
    """Hazard-classifier verdict (SAFE / DANGEROUS; any other value fails
    closed as DANGEROUS); null = unavailable (the caller then falls back to
    :func:`judge_arbitration`)."""
    v = _col(verdict)
    tp = F.coalesce(_col(threat_present), F.lit(False))

    def rs(r, s):
        return F.struct(F.lit(r).alias("risk"), F.lit(s).alias("source"))
    safe = F.when(tp, rs("MEDIUM", "llama_guard_override_restricted"))
    safe = safe.otherwise(rs("LOW", "llama_guard_override") if may_clear_to_low
                          else rs("MEDIUM", "llama_guard_override_capped"))
    return F.when(v == "SAFE", safe).when(v.isNotNull(), rs("HIGH", "llama_guard_arbitration"))


def arbitrate(hazard, judge, threat_present, may_clear_to_low: bool = False) -> Column:
    """C6 then C5: the hazard classifier decides where it answered (a null
    verdict means it was unavailable), else the chat judge."""
    return F.coalesce(hazard_arbitration(hazard, threat_present, may_clear_to_low),
                      judge_arbitration(judge, threat_present, may_clear_to_low))


# --- C11/C12/C13 fusion policy ------------------------------------------------------------------

def load_policy(path: str = EXAMPLE_POLICY) -> dict:
    """Load and validate an artifact (required fields, equal lengths)."""
    with open(path, encoding="utf-8") as f:
        pol = json.load(f)
    need = ["feature_order", "scaler_mean", "scaler_scale", "coefficients", "intercept",
            "threshold_high", "threshold_medium"]
    missing = [k for k in need if k not in pol]
    if missing:
        raise ValueError(f"fusion artifact missing {missing}")
    n = len(pol["feature_order"])
    for k in ("scaler_mean", "scaler_scale", "coefficients"):
        if len(pol[k]) != n:
            raise ValueError(f"fusion artifact: {k} has {len(pol[k])} values, expected {n}")
    for cls, p in (pol.get("per_class") or {}).items():
        for k in ("scaler_mean", "scaler_scale", "coefficients"):
            if len(p[k]) != n:
                raise ValueError(f"fusion artifact class {cls}: {k} length mismatch")
    return pol


def sigmoid(z) -> Column:
    """Logistic with the input clamped at +-60 (0.0 / 1.0 beyond)."""
    z = _col(z)
    return (F.when(z < -C.SIGMOID_CLAMP, F.lit(0.0)).when(z > C.SIGMOID_CLAMP, F.lit(1.0))
            .otherwise(1.0 / (1.0 + F.exp(-z))))


def linear_score(features: dict, order, means, scales, coefs, intercept) -> Column:
    """C11: ``intercept + sum coef*(x-mean)/scale`` (scale 0 -> term 0), as
    literals folded into one expression."""
    z = F.lit(float(intercept))
    for name, mu, sc, w in zip(order, means, scales, coefs):
        term = F.lit(0.0) if not sc else F.lit(float(w)) * ((_col(features[name]) - F.lit(float(mu))) / F.lit(float(sc)))
        z = z + term
    return z


def fused_score(features: dict, pol: dict) -> Column:
    return sigmoid(linear_score(features, pol["feature_order"], pol["scaler_mean"], pol["scaler_scale"],
                                pol["coefficients"], pol["intercept"]))


def fusion_available(features: dict, pol: dict) -> Column:
    """Available only when every feature is present (never imputed)."""
    ok = F.lit(True)
    for name in pol["feature_order"]:
        ok = ok & _col(features[name]).isNotNull()
    return ok


def fusion_detail(features: dict, pol: dict) -> Column:
    """The first missing detector in declared order (null when all
    are present)."""
    return F.coalesce(*[F.when(_col(features[n]).isNull(), F.lit(f"{n} unavailable"))
                        for n in pol["feature_order"]], F.lit(None).cast("string"))


def per_class_verdict(features: dict, pol: dict) -> Column:
    """Score every class policy; the winner is the max of
    (tier, score/threshold_high), first in artifact order on ties.  Returns
    struct(triggering_class, score, tier, threshold_high, threshold_medium)."""
    per = pol.get("per_class") or {}
    cands = []
    for i, (cls, p) in enumerate(per.items()):
        s = sigmoid(linear_score(features, pol["feature_order"], p["scaler_mean"], p["scaler_scale"],
                                 p["coefficients"], p["intercept"]))
        hi, md = float(p["threshold_high"]), float(p["threshold_medium"])
        tier = F.when(s >= hi, 2).when(s >= md, 1).otherwise(0)
        ratio = (s / F.lit(hi)) if hi else F.lit(0.0)
        cands.append(F.struct(tier.alias("tier"), ratio.alias("ratio"), F.lit(-i).alias("neg_order"),
                              F.lit(cls).alias("triggering_class"), s.alias("score"),
                              F.lit(hi).alias("threshold_high"), F.lit(md).alias("threshold_medium")))
    if not cands:
        return F.lit(None)
    return F.array_max(F.array(*cands))


# --- C8 the whole decision ------------------------------------------------------------------------

def assess(df: DataFrame, features: dict, pol: dict, meta, threat, is_educational, domain_aligned=None, cached=None,
           violation=None, hazard=None, judge=None, domain_mode: str = "advisory", may_clear_to_low: bool = False,
           th: C.Thresholds = C.Thresholds()) -> DataFrame:
    """The stages in order, each only where those before it left a row
    open — cached verdict, symbolic veto, fast path, fusion of all signals
    (per-class policy where every detector answered, else the anchor bands),
    and for the ambiguous band the hazard classifier, then the judge.

    ``cached`` is a struct (risk, score) or null, ``violation`` the veto kind
    or null, ``hazard``/``judge`` verdicts or null (did not answer).  Adds
    risk, source, semantic_score, topicality, judge_invoked,
    symbolic_triggered and triggering_class; the score is the one that drove
    the decision, and a row without signals scores 0.  Row-local; the shared
    intermediate results are columns of their own projections."""
    names = df.columns
    none = F.lit(None).cast("string")
    d = df.withColumns({
        "__c": _col(cached) if cached is not None else F.lit(None).cast("struct<risk:string,score:double>"),
        "__v": _col(violation) if violation is not None else none,
        "__w": per_class_verdict(features, pol), "__ok": fusion_available(features, pol), "__fast": fast_path(meta, threat, th)})
    w = {c: F.col(f"__w.{c}") for c in ("score", "threshold_high", "threshold_medium", "triggering_class")}
    ok = F.col("__ok")
    d = d.withColumn("__fused", fuse_signals(meta, threat, is_educational, domain_aligned if domain_mode != "off" else None, ok,
                                             w["score"], w["threshold_high"], w["threshold_medium"], domain_mode, th))
    d = d.withColumn("__upper", F.when(ok, upper_ambiguous_band(w["score"], w["threshold_medium"], w["threshold_high"])).otherwise(
        upper_ambiguous_band(threat, F.lit(th.medium), F.lit(th.high))))
    d = d.withColumn("__arb", arbitrate(hazard if hazard is not None else none, judge if judge is not None else none, "__upper", may_clear_to_low))
    is_cached, is_vetoed, is_fast = F.col("__c.risk").isNotNull(), F.col("__v").isNotNull(), F.col("__fast").isNotNull()
    d = d.withColumn("__stage", F.when(is_cached, "cache").when(is_vetoed, "veto").when(is_fast, "fast")
                     .when(F.col("__fused.judge_required"), "judge").otherwise("fused"))
    at = F.col("__stage")
    deep = at.isin("judge", "fused")
    locked = F.when(F.col("__c.risk") == "HIGH", "cache_locked_high").otherwise("cache")
    return d.select(
        *names,
        F.when(at == "cache", F.col("__c.risk")).when(at == "judge", F.col("__arb.risk")).when(at == "fused", F.col("__fused.risk")).otherwise("HIGH").alias("risk"),
        F.when(at == "cache", locked).when(at == "veto", "symbolic_rule").when(at == "fast", F.col("__fast.source"))
        .when(at == "judge", F.col("__arb.source")).otherwise(F.col("__fused.source")).alias("source"),
        F.when(at == "cache", F.col("__c.score")).when(~deep, 1.0).otherwise(F.coalesce(F.when(ok, w["score"]).otherwise(_col(threat)), F.lit(0.0)))
        .alias("semantic_score"),
        F.when(deep, F.col("__fused.topicality")).otherwise("UNKNOWN").alias("topicality"), (at == "judge").alias("judge_invoked"),
        (at == "veto").alias("symbolic_triggered"), F.when(deep & ok, w["triggering_class"]).alias("triggering_class"))


# --- C16, N17, N18, N15, N16 -----------------------------------------------------------------

def anchor_detector(symbolic, threat, meta) -> Column:
    """Symbolic hit -> 1.0 else max(threat, meta)."""
    return F.when(F.coalesce(_col(symbolic), F.lit(False)), F.lit(1.0)).otherwise(
        F.greatest(_col(threat), _col(meta)))


def one_sided_probability(signed) -> Column:
    """S > 0 -> s, else 1 + s."""
    s = _col(signed)
    return F.when(s > 0, s).otherwise(1.0 + s)


def two_logit_probability(safe_logit, unsafe_logit) -> Column:
    """Softmax over {safe, unsafe} -> P(unsafe)."""
    a, b = _col(safe_logit), _col(unsafe_logit)
    m = F.greatest(a, b)
    return F.exp(b - m) / (F.exp(a - m) + F.exp(b - m))


def multilabel_max(logits, positive_idx: list, multi_label: bool) -> Column:
    """Max probability over positive labels, sigmoid per label
    (multi-label) or softmax across labels."""
    lg = _col(logits)
    pos = F.array(*[F.element_at(lg, i + 1) for i in positive_idx])
    if multi_label:
        return F.array_max(F.transform(pos, lambda x: 1.0 / (1.0 + F.exp(-x))))
    m = F.array_max(lg)
    den = F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))
    return F.array_max(F.transform(pos, lambda x: F.exp(x - m) / den))


def parse_chat_verdict(raw) -> Column:
    """Strip a code fence, read JSON ``verdict`` upper-cased; anything
    outside SAFE/DANGEROUS/AMBIGUOUS or unparsable -> DANGEROUS."""
    t = F.trim(_col(raw))
    t = F.regexp_replace(t, r"^```(?:json)?\s*", "")
    t = F.regexp_replace(t, r"\s*```$", "")
    v = F.upper(F.trim(F.get_json_object(t, "$.verdict")))
    return F.when(v.isin("SAFE", "DANGEROUS", "AMBIGUOUS"), v).otherwise(F.lit("DANGEROUS"))


def parse_hazard_verdict(raw) -> Column:
    """SAFE or DANGEROUS (first line 'safe'; anything else fails closed)
    and the S1..S13 codes — the vocabulary of every arbitration."""
    first = F.lower(F.trim(F.split(F.coalesce(_col(raw), F.lit("")), "\n")[0]))
    verdict = F.when(first == "safe", F.lit("SAFE")).otherwise(F.lit("DANGEROUS"))
    cats = F.regexp_extract_all(F.coalesce(_col(raw), F.lit("")), F.lit(C.HAZARD_CATEGORY_PATTERN), 0)
    return F.struct(verdict.alias("verdict"), cats.alias("categories"))


# --- C9 / C10 output checks -----------------------------------------------------------------

SEVERITY = {"ALLOW": 0, "RESTRICT": 1, "BLOCK": 2}


def severity(decision) -> Column:
    d = _col(decision)
    return F.when(d == "BLOCK", 2).when(d == "RESTRICT", 1).when(d == "ALLOW", 0)


def assess_output(pii_found, judge_verdict=None, grounding_score=None,
                  least_grounding: float = C.GROUNDING_THRESHOLD) -> Column:
    """PII leak -> BLOCK; judge DANGEROUS -> BLOCK; grounding below
    ``least_grounding`` -> BLOCK; else ALLOW.  Returns struct(decision, source)."""
    def rs(d, s):
        return F.struct(F.lit(d).alias("decision"), F.lit(s).alias("source"))
    c = F.when(F.coalesce(_col(pii_found), F.lit(False)), rs("BLOCK", "pii_leakage"))
    if judge_verdict is not None:
        c = c.when(_col(judge_verdict) == "DANGEROUS", rs("BLOCK", "semantic_judge_output"))
    if grounding_score is not None:
        c = c.when(_col(grounding_score) < least_grounding, rs("BLOCK", "semantic_grounding_check"))
    return c.otherwise(rs("ALLOW", "clean_pass"))


def combined_decision(prompt_decision, output_decision) -> Column:
    """The more severe of the two; the output is only consulted when
    the prompt was not blocked (callers pass null then)."""
    p, o = _col(prompt_decision), _col(output_decision)
    return F.when(o.isNull(), p).when(severity(o) > severity(p), o).otherwise(p)


def positive_prediction(risk, source, strict: bool) -> Column:
    """strict = HIGH only; operational = HIGH or MEDIUM; scoping sources
    (domain guardrail) never count as a safety positive."""
    r, s = _col(risk), _col(source)
    hit = (r == "HIGH") if strict else r.isin("HIGH", "MEDIUM")
    return hit & (s != "domain_guardrail")


