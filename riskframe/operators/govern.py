"""Governance joins: credential grants (J1), tenants (J2), the tenant policy
matrix with its two-level fallback (J3), config validation (S8) and the
prompt/response pairing (J14).

Grant and tenant tables grow with customers and can be large, so they are
plain equi-joins (AQE turns them into broadcasts when measured small).  The
policy matrix is configuration whose size is fixed by the config itself; it
compiles to literal lookups.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import config as C


def validate_grants(grants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keep entries whose capability is one of the known tiers and whose
    hash is present; return (valid, rejected-with-reason).  One bad entry
    never affects its siblings."""
    reason = (F.when(F.col("key_hash").isNull() | (F.length("key_hash") == 0), "missing key hash")
              .when(~F.col("capability").isin(*C.CAPABILITIES), "invalid capability")
              .when(F.col("tenant").isNull() | (F.length("tenant") == 0), "missing tenant"))
    g = grants.withColumn("reject_reason", reason)
    return g.where(F.col("reject_reason").isNull()).drop("reject_reason"), g.where(F.col("reject_reason").isNotNull())


def resolve_principal(requests: DataFrame, grants: DataFrame, hash_col: str = "credential_hash") -> DataFrame:
    """Left join on the credential hash; unmatched or missing credential
    -> anonymous GENERAL in the default tenant."""
    g = grants.select(F.col("key_hash").alias("__kh"), F.col("capability").alias("__cap"),
                      F.col("tenant").alias("__ten"), F.col("key_id").alias("key_id"))
    j = requests.join(g, requests[hash_col] == g["__kh"], "left")
    auth = F.col("__kh").isNotNull()
    return (j.withColumn("authenticated", auth)
            .withColumn("capability", F.when(auth, F.col("__cap")).otherwise(F.lit("GENERAL")))
            .withColumn("tenant", F.when(auth, F.col("__ten")).otherwise(F.lit(C.DEFAULT_TENANT)))
            .drop("__kh", "__cap", "__ten"))


def apply_tenants(df: DataFrame, tenants: DataFrame) -> DataFrame:
    """Attach tenant status/limits; unknown tenants get the default
    config (active, no override).  ``tenant_status`` = 'suspended' rows are
    rejected by the caller."""
    valid = tenants.where(F.col("status").isin("active", "suspended"))
    t = valid.select(F.col("tenant_id").alias("__tid"), F.col("status").alias("tenant_status"),
                     F.col("rate_limit_rpm").alias("tenant_rpm"))
    j = df.join(t, df["tenant"] == t["__tid"], "left").drop("__tid")
    return j.withColumn("tenant_status", F.coalesce("tenant_status", F.lit("active")))


def policy_frame(spark: SparkSession, policy: dict | None = None) -> DataFrame:
    """Exploded ``(tenant, capability, risk, action)`` rows of a nested
    policy map; entries with an unknown action are dropped (S8)."""
    policy = policy if policy is not None else C.DEFAULT_POLICY
    rows = [(t, cap, risk, act) for t, caps in policy.items() for cap, risks in caps.items()
            for risk, act in risks.items() if act in C.ACTIONS]
    return spark.createDataFrame(rows, "p_tenant string, p_capability string, p_risk string, p_action string")


SEP = "\u0001"


def _key(*cols) -> Column:
    return F.concat_ws(SEP, *cols)


def policy_decision(df: DataFrame, policy: dict | None = None, default_action: str = C.DEFAULT_ACTION,
                    tenant: str = "tenant", capability: str = "capability", risk: str = "risk") -> DataFrame:
    """Adds ``tenant_resolved``, ``action`` and ``reason``.

    Tenant fallback: a tenant without its own policy resolves to the
    'default' tenant (the reason says so).  A capability the resolved
    tenant does not define, or a risk level missing under it, goes to the
    global ``default_action`` — not to the default tenant's row.  No usable
    policy at all fails safe to BLOCK.

    The matrix is configuration, so it compiles to map/set literals looked
    up row by row (JVM-side, no join)."""
    policy = policy if policy is not None else C.DEFAULT_POLICY
    if not policy or C.DEFAULT_TENANT not in policy:
        return df.withColumn("action", F.lit("BLOCK")).withColumn(
            "reason", F.lit("System Error: Policies not loaded"))
    rows = [(t, c, r, a) for t, caps in policy.items() for c, risks in caps.items()
            for r, a in risks.items() if a in C.ACTIONS]
    tenants = sorted(policy)
    caps = sorted({f"{t}{SEP}{c}" for t, cs in policy.items() for c in cs})
    rule_map = F.create_map(*[x for t, c, r, a in rows for x in (F.lit(f"{t}{SEP}{c}{SEP}{r}"), F.lit(a))])
    tr = F.when(F.col(tenant).isin(*tenants), F.col(tenant)).otherwise(F.lit(C.DEFAULT_TENANT))
    df = df.withColumn("tenant_resolved", tr)
    cap_ok = _key(F.col("tenant_resolved"), F.col(capability)).isin(*caps)
    act = F.try_element_at(rule_map, _key(F.col("tenant_resolved"), F.col(capability), F.col(risk))) \
        if rows else F.lit(None).cast("string")
    note = F.when(F.col("tenant_resolved") == F.col(tenant), F.col("tenant_resolved")).otherwise(
        F.concat(F.col(tenant), F.lit(" -> "), F.col("tenant_resolved"), F.lit(" (fallback)")))
    action = F.when(~cap_ok, F.lit(default_action)).otherwise(F.coalesce(act, F.lit(default_action)))
    reason = F.when(~cap_ok, F.concat(F.lit("Role '"), F.col(capability), F.lit("' not defined for tenant '"),
                                      note, F.lit("'"))).otherwise(
        F.concat(F.lit("Policy applied for "), F.col(capability), F.lit(" (Risk: "), F.col(risk),
                 F.lit(", Tenant: "), note, F.lit(")")))
    return df.withColumn("action", action).withColumn("reason", reason)


def pair_turns(conv: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
               text: str = "text", prompt_role: str = "user", response_role: str = "assistant") -> DataFrame:
    """Each prompt turn with the response turn right after it (null
    when there is none).  Equi-join on (conversation, turn+1)."""
    p = conv.where(F.col(role) == prompt_role).select(conv_id, turn, F.col(text).alias("prompt"))
    r = conv.where(F.col(role) == response_role).select(
        F.col(conv_id).alias("__cid"), (F.col(turn) - 1).alias("__t"), F.col(text).alias("response"))
    return p.join(r, (p[conv_id] == r["__cid"]) & (p[turn] == r["__t"]), "left").drop("__cid", "__t")
