"""SQL text fragments for the DuckDB cross-check queries.

These are the reference formulations the Spark plans are compared against;
they are built from the same fixed values in :mod:`riskframe.config`.
"""
from __future__ import annotations

from riskframe import config as C


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def str_list(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def alternation(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def redaction_ctes(src: str, text: str, keep: str, prefix: str = "pii") -> tuple[str, str]:
    """CTE chain applying the PII masks label by label.  Returns (ctes, last
    cte name); the last CTE has ``clean_text`` and ``redacted_items``."""
    ctes = [f"{prefix}0 AS (SELECT {keep}, {text} AS t0, []::VARCHAR[] AS items0 FROM {src})"]
    for i, (label, pat) in enumerate(C.PII_PATTERNS, start=1):
        mask = q(f"[REDACTED:{label}]")
        ctes.append(
            f"{prefix}{i}m AS (SELECT *, regexp_extract_all(t{i-1}, {q(pat)}, 0) AS m{i} FROM {prefix}{i-1})")
        ctes.append(
            f"{prefix}{i} AS (SELECT * EXCLUDE (t{i-1}, items{i-1}, m{i}), "
            f"list_reduce(m{i}, lambda acc, x: replace(acc, x, {mask}), t{i-1}) AS t{i}, "
            f"list_concat(items{i-1}, list_transform(m{i}, lambda x: {q(label + ':')} || x)) AS items{i} "
            f"FROM {prefix}{i}m)")
    n = len(C.PII_PATTERNS)
    ctes.append(f"{prefix}_out AS (SELECT * EXCLUDE (t{n}, items{n}), t{n} AS clean_text, "
                f"items{n} AS redacted_items FROM {prefix}{n})")
    return ",\n".join(ctes), f"{prefix}_out"


WORD = r"[\pL\pN_]"


def normalize_ctes(src: str, text: str, out: str = "norm", prefix: str = "nz") -> tuple[str, str]:
    """N1 in SQL.  The spaced-letter join has no look-ahead in RE2, so it is
    done per character (only on rows that contain such a run)."""
    homo_src = "".join(a for a, _ in C.HOMOGLYPHS) + C.ZERO_WIDTH_CHARS
    homo_dst = "".join(b for _, b in C.HOMOGLYPHS)
    gate = r"(^|[^\pL\pN_])[a-z] [a-z]([^\pL\pN_]|$)"
    c1 = (f"{prefix}1 AS (SELECT *, regexp_replace(translate(lower(nfc_normalize({text})), "
          f"{q(homo_src)}, {q(homo_dst)}), '\\s+', ' ', 'g') AS {prefix}_t FROM {src})")
    char_expr = (
        "array_to_string(list_transform(cs, lambda ch, i: CASE WHEN ch = ' ' AND i > 1 AND i < len(cs) "
        "AND regexp_full_match(cs[i-1], '[a-z]') AND regexp_full_match(cs[i+1], '[a-z]') "
        f"AND (i = 2 OR NOT regexp_full_match(cs[i-2], '{WORD}')) "
        f"AND (i + 1 = len(cs) OR NOT regexp_full_match(cs[i+2], '{WORD}')) "
        "THEN '' ELSE ch END), '')")
    c2 = (f"{prefix}2 AS (SELECT *, CASE WHEN regexp_matches({prefix}_t, {q(gate)}) "
          f"THEN string_split({prefix}_t, '') END AS cs FROM {prefix}1)")
    c2b = (f"{prefix}2b AS (SELECT * EXCLUDE (cs), CASE WHEN cs IS NULL THEN {prefix}_t "
           f"ELSE {char_expr} END AS {prefix}_s FROM {prefix}2)")
    c3 = (f"{out} AS (SELECT * EXCLUDE ({prefix}_t, {prefix}_s), trim({prefix}_s) AS normalized "
          f"FROM {prefix}2b)")
    return ",\n".join([c1, c2, c2b, c3]), out


def symbolic_case(t: str, pack: C.RulePack | None = None) -> str:
    pack = pack or C.RulePack()
    jb = q(alternation(pack.jailbreak))
    ov = q(alternation(pack.override))
    hb = " OR ".join(f"contains(lower({t}), {q(k)})" for k in pack.hard_ban)
    return (f"CASE WHEN regexp_matches(lower({t}), {jb}) THEN 'JAILBREAK_DETECTED' "
            f"WHEN regexp_matches(lower({t}), {ov}) THEN 'INSTRUCTION_OVERRIDE_DETECTED' "
            f"WHEN {hb} THEN 'HARD_BAN_DETECTED' END")


def _mixed(z: str, shift: int, factor: int) -> str:
    """(z ^ z >> shift) * factor modulo 2^64, on UBIGINT."""
    return f"((xor({z}, {z} >> {shift})::UHUGEINT * {factor}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


def poisson_draws(src: str, id_expr: str, replicates: int, seed: int) -> str:
    """``rw``: the rows of ``src`` once per replicate ``rep`` with their
    Poisson(1) weight ``w``."""
    cdf = C.poisson1_cdf(20)
    w = " + ".join(f"CASE WHEN u > {c!r} THEN 1 ELSE 0 END" for c in cdf)
    return f"""r0 AS (SELECT b.*, r.rep, ((('0x' || substr(md5(CAST({id_expr} AS VARCHAR) || ':{seed}'), 1, 15))::BIGINT::UHUGEINT
                  + (r.rep + 1)::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z0
        FROM {src} b CROSS JOIN range(0, {replicates}) r(rep)),
r1 AS (SELECT *, {_mixed('z0', 30, 0xBF58476D1CE4E5B9)} AS z1 FROM r0),
r2 AS (SELECT *, {_mixed('z1', 27, 0x94D049BB133111EB)} AS z2 FROM r1),
ru AS (SELECT *, CAST(xor(z2, z2 >> 31) >> 12 AS DOUBLE) / 4503599627370496.0 AS u FROM r2),
rw AS (SELECT *, ({w}) AS w FROM ru)"""


def interval(values: str, alpha: float) -> str:
    """ci_lo and ci_hi from the sorted list ``values`` of ``m`` values."""
    return (f"{values}[CAST(floor({alpha / 2.0} * m) AS BIGINT) + 1] AS ci_lo, "
            f"{values}[least(CAST(floor({1.0 - alpha / 2.0} * m) AS BIGINT), m - 1) + 1] AS ci_hi")
