"""Text scalars: normalisation, dedup key, language tag, hashes, PII masks,
request-field sanitising.

All of these are Column -> Column functions built from JVM built-ins.  The
only Python on the path is Unicode normalisation (Spark has no NFKC/NFKD
built-in); it is an Arrow-batched pandas UDF that receives ``null`` for every
pure-ASCII row (ASCII is invariant under both forms), so ASCII text never
crosses into Python.
"""
from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskframe import config as C

NON_ASCII = "[^\\x00-\\x7F]"
# Characters that no Unicode normalisation form changes and that cannot
# compose with a neighbour: C0/C1 controls, ASCII and the precomposed Latin-1
# letters.  Text made only of these skips the Python helper entirely.
NFKC_MAYBE_CHANGES = "[^\\x00-\\x9F\\xC0-\\xFF]"


def _fold_char(ch: str) -> str:
    d = unicodedata.normalize("NFKD", ch)
    return "".join(c for c in d if not unicodedata.combining(c))


# Accent folding of the Latin-1 supplement derived from the Unicode database
# (not transcribed): characters folding to exactly one character are handled
# by a native ``translate``; any other non-ASCII character routes the row to
# the Python helper.
_L1 = [chr(c) for c in range(0x80, 0x100) if len(_fold_char(chr(c))) == 1]
LATIN1_FROM = "".join(_L1)
LATIN1_TO = "".join(_fold_char(c) for c in _L1)
FOLD_NEEDS_PYTHON = "[^\\x00-\\x7F" + "".join(f"\\x{ord(c):02X}" for c in _L1) + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- Unicode normalisation (the only Python helpers) ------------------------

@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _fold_marks(s: pd.Series) -> pd.Series:
    """NFKD then drop combining marks (accent folding)."""
    def fold(x):
        if x is None:
            return None
        d = unicodedata.normalize("NFKD", x)
        return "".join(ch for ch in d if not unicodedata.combining(ch))
    return s.map(fold)


def nfkc(c) -> Column:
    """NFKC; only rows holding a character that might change reach Python."""
    c = _col(c)
    return F.coalesce(_nfkc(F.when(c.rlike(NFKC_MAYBE_CHANGES), c)), c)


def fold_accents(c) -> Column:
    """NFKD without combining marks.  Latin-1 rows fold natively; rows with
    other non-ASCII characters go through the Python helper."""
    c = _col(c)
    return F.coalesce(_fold_marks(F.when(c.rlike(FOLD_NEEDS_PYTHON), c)),
                      F.translate(c, LATIN1_FROM, LATIN1_TO))


# --- N1 normalize_prompt ------------------------------------------------------

def collapse_spaced_letters(c) -> Column:
    """``b o m b`` -> ``bomb``.  One global pass reaches the fixpoint because
    the look-ahead does not consume the following letter."""
    return F.regexp_replace(_col(c), r"\b([a-z])\s(?=[a-z]\b)", "$1")


def normalize_prompt(c, unicode_forms: bool = True) -> Column:
    """NFKC -> lower -> strip zero-width -> homoglyphs -> collapse Unicode
    whitespace -> join spaced single letters -> trim."""
    t = nfkc(c) if unicode_forms else _col(c)
    t = F.lower(t)
    src = "".join(a for a, _ in C.HOMOGLYPHS) + C.ZERO_WIDTH_CHARS
    dst = "".join(b for _, b in C.HOMOGLYPHS)
    t = F.translate(t, src, dst)            # mapped, then the rest deleted
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    t = collapse_spaced_letters(t)
    return F.trim(t)


# --- N2 normalize_for_dedup ---------------------------------------------------

def dedup_key(c) -> Column:
    """lower -> NFKD without combining marks -> keep [a-z0-9\\s] -> collapse."""
    t = fold_accents(F.lower(_col(c)))
    t = F.regexp_replace(t, r"(?U)[^a-z0-9\s]", "")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.trim(t)


# --- N3 detect_language -------------------------------------------------------

def detect_language(c, de_markers=None, en_markers=None) -> Column:
    """Stop-word overlap tagger: 'de', 'en' or 'other' (+2 to German when any
    umlaut/sharp-s is present; ties and no evidence -> 'other')."""
    c = _col(c)
    de_m = F.array(*[F.lit(x) for x in (de_markers or C.DE_MARKERS)])
    en_m = F.array(*[F.lit(x) for x in (en_markers or C.EN_MARKERS)])
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(C.LANG_TOKEN_PATTERN), 0))
    de = F.size(F.array_intersect(tokens, de_m)) + \
        F.when(c.rlike("[" + C.GERMAN_CHARS + "]"), F.lit(2)).otherwise(F.lit(0))
    en = F.size(F.array_intersect(tokens, en_m))
    return (F.when(F.size(tokens) == 0, "other")
            .when((de == 0) & (en == 0), "other")
            .when(de > en, "de")
            .when(en > de, "en")
            .otherwise("other"))


# --- N4 hashes ----------------------------------------------------------------

def prompt_hash(c) -> Column:
    return F.sha2(_col(c), 256)


def row_id(key) -> Column:
    """First 16 hex characters of SHA-1 of the dedup key."""
    return F.substring(F.sha1(_col(key)), 1, 16)


# --- N5 regex PII masking -----------------------------------------------------

def _prefixer(prefix: str):
    return lambda x: F.concat(F.lit(prefix), x)


def _masker(mask: Column):
    return lambda acc, x: F.replace(acc, x, mask)


def with_redaction(df, text_col: str, out_text: str = "clean_text",
                   out_items: str = "redacted_items", patterns=None):
    """Adds the masked text and the ``LABEL:match`` item list.

    Labels run in order on the already-masked text; every match of a label is
    replaced everywhere with ``[REDACTED:LABEL]`` (plain replace-all, so a
    short match may eat into a longer one), and items keep match order with
    repeats.  One projection per label: each label's matches are computed
    once and shared by the mask and the item list.
    """
    patterns = patterns or C.PII_PATTERNS
    cur = f"__pii_t0"
    df = df.withColumn(cur, F.col(text_col)).withColumn(out_items, F.array().cast("array<string>"))
    for i, (label, pat) in enumerate(patterns):
        mcol = f"__pii_m{i}"
        nxt = f"__pii_t{i + 1}"
        mask = F.lit(f"[REDACTED:{label}]")
        found = F.regexp_extract_all(F.col(cur), F.lit(pat), 0)
        if label == "EMAIL":   # an address needs '@': skip the regex scan otherwise
            found = F.when(F.instr(F.col(cur), "@") > 0, found).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(mcol, found)
        df = df.withColumn(out_items, F.concat(
            F.col(out_items), F.transform(F.col(mcol), _prefixer(label + ":"))))
        df = df.withColumn(nxt, F.aggregate(F.col(mcol), F.col(cur), _masker(mask)))
        df = df.drop(cur, mcol)
        cur = nxt
    return df.withColumnRenamed(cur, out_text)


def redact_spans(text, spans) -> Column:
    """Splice entity spans (array<struct<start,end,label>>, 0-based,
    end exclusive) into the text right-to-left as ``[REDACTED:LABEL]``."""
    ordered = F.array_sort(_col(spans), lambda a, b: F.when(a["start"] > b["start"], -1)
                           .when(a["start"] < b["start"], 1).otherwise(0))
    return F.aggregate(
        ordered, _col(text),
        lambda acc, s: F.concat(
            acc.substr(F.lit(1), s["start"]),
            F.lit("[REDACTED:"), s["label"], F.lit("]"),
            acc.substr(s["end"] + 1, F.length(acc) + 1)))


# --- P1..P4 request fields ----------------------------------------------------

def length_valid(c, lo: int = C.MIN_PROMPT_CHARS, hi: int = C.MAX_PROMPT_CHARS) -> Column:
    n = F.length(_col(c))
    return _col(c).isNotNull() & (n >= lo) & (n <= hi)


def sanitize_request_id(c, minted) -> Column:
    """Trimmed id when it is <=64 chars of [A-Za-z0-9._:-], else ``minted``."""
    t = F.trim(_col(c))
    ok = t.isNotNull() & (F.length(t) > 0) & (F.length(t) <= C.REQUEST_ID_MAX_LEN) & \
        t.rlike(C.REQUEST_ID_PATTERN)
    return F.when(ok, t).otherwise(_col(minted))


def client_address(forwarded_for, peer, trust_proxy: bool = True) -> Column:
    """Rightmost non-blank X-Forwarded-For hop when the proxy is trusted,
    else the peer address, else 'unknown'."""
    peer_c = F.when(F.length(F.trim(_col(peer))) > 0, F.trim(_col(peer)))
    if not trust_proxy:
        return F.coalesce(peer_c, F.lit("unknown"))
    hops = F.filter(F.transform(F.split(F.coalesce(_col(forwarded_for), F.lit("")), ","),
                                lambda h: F.trim(h)), lambda h: h != "")
    last = F.when(F.size(hops) > 0, F.element_at(hops, -1))
    return F.coalesce(last, peer_c, F.lit("unknown"))


def bearer_credential(header) -> Column:
    """Token of ``Bearer <token>`` (scheme case-insensitive, exactly two parts)."""
    parts = F.split(F.trim(_col(header)), r"\s+")
    return F.when((F.size(parts) == 2) & (F.lower(parts[0]) == "bearer") & (F.length(parts[1]) > 0),
                  parts[1])


# --- U-3 pluggable entity tagger --------------------------------------------------

def tag_entities(df, id_col: str, text_col: str, tagger, labels=None):
    """U-3: run a tagger ``text -> [(start, end, label), ...]`` over Arrow
    batches and emit one span row per entity ``(id, start, end, label)``
    (labels outside ``labels`` are dropped).  Feed the spans to
    :func:`redact_spans` after ``groupBy(id).agg(collect_list(struct))`` —
    spans per text are bounded by the text's length."""
    keep = set(labels or C.ENTITY_LABELS)

    def run(batches):
        for pdf in batches:
            rows = [(i, s, e, lab) for i, t in zip(pdf["id"], pdf["text"]) if t is not None
                    for s, e, lab in tagger(t) if lab in keep]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "label"]).astype(
                {"id": "int64", "start": "int32", "end": "int32"})

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "id long, start int, end int, label string")
