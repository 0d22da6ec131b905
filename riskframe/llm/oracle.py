"""DuckDB SQL for the queries of this package that SQL can express."""
from __future__ import annotations

from riskframe.llm import filter_audit, fim, jaccard, lm_score, quality, secret_scan

_WORD = r"[^\x20\x09-\x0D]+"


def _quality() -> str:
    sizes = list(quality.COVERAGE_LIMITS)
    covers = ",\n".join(f"""cover_{n} AS (
      SELECT k.rid, sum(length(k.w)) AS c FROM w k JOIN (
        SELECT DISTINCT rid, unnest(range(i, i + {n})) AS i FROM (
          SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
          FROM (SELECT rid, i, list(w) OVER win AS g, count(*) OVER win AS m FROM w
                WINDOW win AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING))
          WHERE m = {n}) WHERE c > 1) h ON k.rid = h.rid AND k.i = h.i GROUP BY k.rid)""" for n in sizes)
    first = sizes[0]
    repeat = f"""repeats AS (
      SELECT rid, count(DISTINCT i) AS c FROM (
        SELECT rid, unnest(range(i, i + {first})) AS i FROM (
          SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c
          FROM (SELECT rid, i, list(w) OVER win AS g, count(*) OVER win AS m FROM w
                WINDOW win AS (PARTITION BY rid ORDER BY i ROWS BETWEEN CURRENT ROW AND {first - 1} FOLLOWING))
          WHERE m = {first}) WHERE c > 1) GROUP BY rid)"""
    joins = "\n".join(f"LEFT JOIN cover_{n} c{n} USING (rid)" for n in sizes)
    cols = ", ".join(f"coalesce(c{n}.c, 0)::BIGINT AS cover_{n}" for n in sizes)
    bad = " OR ".join([f"dup_line_chars > {quality.LINE_LIMIT} * line_chars"]
                      + [f"cover_{n} > {most} * word_chars" for n, most in quality.COVERAGE_LIMITS.items()])
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    lists AS (SELECT rid, regexp_extract_all(text, '{_WORD}') AS ws FROM d),
    w AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM lists),
    words AS (SELECT rid, count(*) AS n, sum(length(w)) AS c FROM w GROUP BY rid),
    l AS (SELECT * FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{_WORD}')),
    ll AS (SELECT rid, line, count(*) AS n FROM l GROUP BY rid, line),
    lines AS (SELECT rid, sum(n - 1) AS dup, sum((n - 1) * length(line)) AS dup_chars, sum(n * length(line)) AS chars FROM ll GROUP BY rid),
    {repeat},
    {covers},
    m AS (SELECT doc_id, coalesce(words.n, 0)::BIGINT AS n_words, coalesce(words.c, 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(repeats.c, 0)::BIGINT AS n_repeat_words,
        coalesce(lines.dup_chars, 0)::BIGINT AS dup_line_chars, coalesce(lines.chars, 0)::BIGINT AS line_chars, {cols}
      FROM d LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid) {joins}),
    b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT *, NOT base_failed AND NOT ({bad}) AS kept FROM b"""


def _secrets() -> str:
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    hits = "\nUNION ALL\n".join(
        f"SELECT rid, '{k}' AS kind, {i} AS ord, string_split_regex(text, {lit(p)}) AS gaps, regexp_extract_all(text, {lit(p)}) AS hits, "
        f"regexp_extract_all(text, {lit(p)}, {g}) AS vals, {least} AS least FROM d"
        for i, (k, _, p, g, least) in enumerate(secret_scan.RULES))
    joined = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord, e) {cond}, '')"
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    h AS ({hits}),
    x AS (SELECT rid, kind, ord, least, unnest(range(1, len(hits) + 1)) AS i, gaps, hits, vals FROM h WHERE len(hits) > 0),
    p AS (SELECT rid, kind, ord, least, length(vals[i]) AS n, length(hits[i]) AS len,
        list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda g: length(g))), 0) AS s FROM x),
    f AS (SELECT rid, kind, ord, s::BIGINT AS s, (s + len)::BIGINT AS e FROM p WHERE n >= least),
    a AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex, {joined(f"FILTER (kind IN ({base}))")} AS base, {joined("")} AS spans FROM f GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN a USING (rid)"""


def _near() -> str:
    return rf"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {jaccard.WORDS} THEN [ws]
        ELSE list_transform(range(1, len(ws) - {jaccard.WORDS - 2}), lambda i: ws[i:i + {jaccard.WORDS - 1}]) END) AS g FROM d),
    n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
    p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY a.rid, b.rid),
    l AS (SELECT p.a, p.b, p.c = x.n AND p.c = y.n AS same FROM p JOIN n x ON x.rid = p.a JOIN n y ON y.rid = p.b
        WHERE p.c >= {jaccard.THRESHOLD} * (x.n + y.n - p.c) - 1e-9),
    r AS (SELECT rid AS a, rid AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
    cls AS (SELECT r.a AS rid, min(d.doc_id) AS class_id FROM r JOIN d ON d.rid = r.b GROUP BY r.a),
    k AS (SELECT l.a AS rid, count(DISTINCT y.text) FILTER (y.text <> x.text) AS n_links, count(*) FILTER (l.same) AS copies
        FROM l JOIN d x ON x.rid = l.a JOIN d y ON y.rid = l.b GROUP BY l.a)
    SELECT d.doc_id, cls.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links, (1 + coalesce(k.copies, 0))::BIGINT AS n_copies
    FROM d JOIN cls USING (rid) LEFT JOIN k USING (rid)"""


def _backoff() -> str:
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    w AS (SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d),
    b AS (SELECT rid, i, w, lag(w) OVER (PARTITION BY rid ORDER BY i) AS h, lag(w, 2) OVER (PARTITION BY rid ORDER BY i) AS g FROM w),
    own1 AS (SELECT rid, w, count(*) AS c FROM w GROUP BY rid, w),
    all1 AS (SELECT w, sum(c) AS c FROM own1 GROUP BY w),
    own2 AS (SELECT rid, h, w, count(*) AS c FROM b WHERE h IS NOT NULL GROUP BY rid, h, w),
    all2 AS (SELECT h, w, sum(c) AS c FROM own2 GROUP BY h, w),
    own3 AS (SELECT rid, g, h, w, count(*) AS c FROM b WHERE g IS NOT NULL GROUP BY rid, g, h, w),
    all3 AS (SELECT g, h, w, sum(c) AS c FROM own3 GROUP BY g, h, w),
    m AS (SELECT rid, count(*) AS n FROM w GROUP BY rid),
    c AS (SELECT b.rid, b.h IS NOT NULL AS has2, b.g IS NOT NULL AS has3, a1.c - o1.c AS c1, ah.c - oh.c AS ch,
            a2.c - o2.c AS c2, ag.c - og.c AS cgh, a3.c - o3.c AS c3, (SELECT sum(n) FROM m) - m.n AS rest
        FROM b JOIN m USING (rid) JOIN own1 o1 ON o1.rid = b.rid AND o1.w = b.w JOIN all1 a1 ON a1.w = b.w
        LEFT JOIN own1 oh ON oh.rid = b.rid AND oh.w = b.h LEFT JOIN all1 ah ON ah.w = b.h
        LEFT JOIN own2 o2 ON o2.rid = b.rid AND o2.h = b.h AND o2.w = b.w LEFT JOIN all2 a2 ON a2.h = b.h AND a2.w = b.w
        LEFT JOIN own2 og ON og.rid = b.rid AND og.h = b.g AND og.w = b.h LEFT JOIN all2 ag ON ag.h = b.g AND ag.w = b.h
        LEFT JOIN own3 o3 ON o3.rid = b.rid AND o3.g = b.g AND o3.h = b.h AND o3.w = b.w
        LEFT JOIN all3 a3 ON a3.g = b.g AND a3.h = b.h AND a3.w = b.w),
    s AS (SELECT rid, has3 AND c3 > 0 AS top, CASE WHEN has3 AND c3 > 0 THEN ln(c3::DOUBLE / cgh) ELSE
        (CASE WHEN has3 THEN ln({lm_score.ALPHA}) ELSE 0 END) + CASE WHEN has2 AND c2 > 0 THEN ln(c2::DOUBLE / ch) ELSE
        (CASE WHEN has2 THEN ln({lm_score.ALPHA}) ELSE 0 END) + (CASE WHEN c1 > 0 THEN ln(c1::DOUBLE / rest) ELSE -ln(rest + 1) END) END END AS x FROM c),
    f AS (SELECT rid, count(*) AS n, count(*) FILTER (top) AS n_top, sum(x) AS x FROM s GROUP BY rid)
    SELECT doc_id, coalesce(f.n, 0)::BIGINT AS n_words, coalesce(f.n_top, 0)::BIGINT AS n_top, round(coalesce(f.x, 0), 4) AS log_score,
        round(f.x / f.n, 6) AS mean_log_score FROM d LEFT JOIN f USING (rid)"""


def _audit() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
    g AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
    l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        (CASE WHEN len(ws) < {filter_audit.MIN_WORDS} THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT_PERCENT} * len(ws) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > {filter_audit.MAX_CAPITAL_PERCENT} * length(d.text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN g.least < d.doc_id THEN 16 ELSE 0 END) AS mask
      FROM d JOIN g ON g.text = d.text LEFT JOIN l ON l.doc_id = d.doc_id),
    f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
    o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
      FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
    s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0)::INTEGER AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS k)),
    r AS (SELECT part, filter_order, step, bit,
        count(*) FILTER (mask & earlier = 0 AND mask & bit = 0) AS kept, count(*) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS removed,
        count(*) FILTER (mask & earlier <> 0 AND mask & bit <> 0) AS redundant, count(*) FILTER (mask = bit) AS unique_fails,
        count(*) FILTER (mask & earlier = 0 AND mask & bit <> 0 AND good = 1) AS good_lost,
        count(*) FILTER (mask & earlier = 0 AND mask & bit <> 0 AND toxic = 1) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
        (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""


def _middle() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
    k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
    c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fim.RATE} THEN 'plain'
             WHEN h4 % 100 < {fim.SPM} THEN 'spm' ELSE 'psm' END AS form FROM k),
    p AS (SELECT *, array_to_string(u[1:a], '') AS head, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS tail FROM c),
    o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END AS output FROM p)
    SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(head) END::BIGINT AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars, sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o"""


ORACLE = {"op2_quality_rules": _quality(), "op4_secret_scan": _secrets(), "op6_ngram_jaccard": _near(), "op8_lm_score_order3": _backoff(),
          "op11_filter_audit": _audit(), "op12_fill_in_middle": _middle()}
