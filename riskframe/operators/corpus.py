"""Corpus operators: multi-source union, first-wins dedup, provenance
manifest, exact per-key capped samples and grouping-set slices."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.functions import text as X
from riskframe.session import cut_lineage

HASH_BUCKETS = 65536      # 16-bit prefix of the md5 order key


def load_sources(spark, registry: dict, columns: list[str]):
    """Build every registered source (``name -> callable(spark) ->
    DataFrame`` already mapped to ``columns``); a source that fails to load
    is skipped and recorded, never fatal.  Returns (union, provenance)."""
    frames, prov = {}, []
    for name, build in registry.items():
        try:
            df = build(spark).select(*columns)
            df.schema  # noqa: B018 - forces analysis, so a missing path fails here
            frames[name] = df
            prov.append((name, "ok", None))
        except Exception as e:  # noqa: BLE001 - recorded in the provenance table
            prov.append((name, "skipped", f"{type(e).__name__}: {str(e)[:200]}"))
    provenance = spark.createDataFrame(prov, "source string, status string, reason string")
    return (union_sources(frames, columns) if frames else None), provenance


def shuffle_key(id_col: str, seed: int = 0):
    """K3: deterministic shuffle order column ``md5(id:seed)``."""
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))


def union_sources(frames: dict, columns: list[str]) -> DataFrame:
    """Union per-source frames (already mapped to ``columns``) with
    ``source`` and ``priority`` (registry order).  Frames that fail to build
    are the caller's to skip; this only aligns and tags."""
    parts = []
    for i, (name, df) in enumerate(frames.items()):
        parts.append(df.select(*columns).withColumn("source", F.lit(name)).withColumn("priority", F.lit(i)))
    return reduce(lambda a, b: a.unionByName(b), parts)


def attack_label(jailbreaking, toxicity):
    """Jailbreaking -> jailbreak; else toxicity -> harmful; else benign."""
    return (F.when(F.col(jailbreaking) == 1, F.struct(F.lit(1).alias("label"), F.lit("jailbreak").alias("attack_class")))
            .when(F.col(toxicity) == 1, F.struct(F.lit(1).alias("label"), F.lit("harmful").alias("attack_class")))
            .otherwise(F.struct(F.lit(0).alias("label"), F.lit("benign").alias("attack_class"))))


def with_dedup_key(df: DataFrame, text_col: str = "text") -> DataFrame:
    """P11 + N2: ``dedup_key`` and ``valid`` (stripped text >= 3 chars and a
    non-empty key)."""
    df = df.withColumn("dedup_key", X.dedup_key(text_col))
    valid = (F.length(F.trim(F.col(text_col))) >= 3) & (F.length("dedup_key") > 0)
    return df.withColumn("valid", F.coalesce(valid, F.lit(False)))


def _order(priority, ordinal, schema) -> Column:
    """(priority, ordinal) as one number where both are integers, so that
    the smallest is a hash aggregate; nulls come first, as in a sort."""
    whole = all(schema[c].dataType.typeName() in ("long", "integer", "short", "byte") for c in (priority, ordinal))
    if not whole:
        return F.struct(F.col(priority).alias("p"), F.col(ordinal).alias("o"))
    part = lambda c, low: F.coalesce(F.col(c).cast("decimal(38,0)"), F.lit(low).cast("decimal(38,0)"))
    return (part(priority, str(-(1 << 59))) * F.lit(str(1 << 64)).cast("decimal(20,0)") + part(ordinal, str(-(1 << 63)))).cast("decimal(38,0)")


def _first_rows(narrow: DataFrame) -> DataFrame:
    """Of rows with ``__key`` and ``__o`` the first of every key, with the
    number of its ``copies``: an aggregate over keys, and a semi-join on key
    and order that no key makes uneven."""
    first = narrow.groupBy("__key").agg(F.min("__o").alias("__o"), F.count(F.lit(1)).alias("copies"))
    return narrow.join(first, ["__key", "__o"]).dropDuplicates(["__key", "__o"])


def dedup_first_wins(df: DataFrame, priority: str, ordinal: str, payload: list[str],
                     text_col: str = "text") -> DataFrame:
    """K1: one row per dedup key — the first by (priority, ordinal).

    The text is read once, for its key; what goes on is a narrow row (key
    digest, order, payload), written once.  Winners are a hash aggregate over
    it: a key with millions of copies is reduced map-side before the shuffle,
    and no text is shuffled or sorted.  A payload that names the text itself
    gets it from a join of the winners on (priority, ordinal).  Adds ``id``
    (16 hex of SHA-1 of the key) and ``copies``.  (priority, ordinal) must
    tell the rows apart."""
    v = with_dedup_key(df, text_col).where("valid")
    light = [c for c in payload if c != text_col]
    extra = [c for c in (priority, ordinal) if text_col in payload and c not in light]
    narrow = cut_lineage(v.select(F.unhex(F.sha1("dedup_key")).alias("__key"), _order(priority, ordinal, df.schema).alias("__o"), *light, *extra))
    won = _first_rows(narrow)
    if text_col in payload:
        won = won.join(df.select(priority, ordinal, text_col), [priority, ordinal])
    return won.select(F.substring(F.lower(F.hex("__key")), 1, 16).alias("id"), *payload, "copies")   # == text.row_id(key)


def manifest(df: DataFrame, priority: str, ordinal: str, source: str = "source",
             text_col: str = "text", label: str | None = None) -> DataFrame:
    """A4: per source raw rows, short/blank rows dropped, rows kept and
    duplicates dropped (copies of a key first seen in an earlier-priority
    source or earlier in the same source).  The text is read once, for its
    key; all counts come from the narrow rows."""
    k = with_dedup_key(df, text_col)
    cols = [source] + ([label] if label else [])
    narrow = cut_lineage(k.select(F.when(F.col("valid"), F.unhex(F.sha1("dedup_key"))).alias("__key"), _order(priority, ordinal, df.schema).alias("__o"), *cols))
    raw = narrow.groupBy(source).agg(F.count(F.lit(1)).alias("raw_rows"), F.count("__key").alias("valid_rows"))
    kept = _first_rows(narrow.where("__key is not null"))
    kagg = [F.count(F.lit(1)).alias("kept")]
    if label:
        kagg += [F.count_if(F.col(label) == 1).alias("attacks"), F.count_if(F.col(label) == 0).alias("benign")]
    kc = kept.groupBy(source).agg(*kagg)
    out = raw.join(kc, source, "left").fillna(0, subset=["kept"] + (["attacks", "benign"] if label else []))
    return out.select(source, "raw_rows", (F.col("raw_rows") - F.col("valid_rows")).alias("short_dropped"),
                      "kept", (F.col("valid_rows") - F.col("kept")).alias("duplicates_dropped"),
                      *(["attacks", "benign"] if label else []))


def capped_sample(df: DataFrame, key: str, id_col: str, cap, seed: int = 0) -> DataFrame:
    """At most ``cap`` rows per ``key`` — the ones with the
    smallest ``md5(id:seed)`` — exact, without sorting any key's rows.
    ``cap`` is an int or a dict ``{key value: cap}`` (a missing key or a
    ``None`` cap keeps that stratum whole).  Ids are unique.

    Only (key, id) are read to choose: a 16-bit prefix of the hash buckets
    the rows; bucket counts (at most 65 536 per key) give, per key, the
    bucket where the running count reaches ``cap``.  Rows below it are kept;
    only the rows of that one boundary bucket are ranked.  The input itself
    is read once, by the semi-join with the chosen ids."""
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))))
    if isinstance(cap, dict):
        pairs = [x for k, v in cap.items() if v is not None for x in (F.lit(k), F.lit(int(v)))]
        capc = F.try_element_at(F.create_map(*pairs), F.col(key).cast("string")) if pairs else F.lit(None)
        capc = F.coalesce(capc.cast("long"), F.lit((1 << 62)))
    else:
        capc = F.lit(int(cap)).cast("long")
    narrow = cut_lineage(df.select(F.col(key).alias("__k"), F.col(id_col).alias("__id"), F.substring(h, 1, 16).alias("__h"), capc.alias("__cap")))
    narrow = narrow.withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    counts = narrow.groupBy("__k", "__b", "__cap").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.withColumn("__cum", F.sum("__n").over(w))
    boundary = cum.where(F.col("__cum") >= F.col("__cap")).groupBy("__k").agg(
        F.min_by(F.struct(F.col("__b").alias("bb"), (F.col("__cum") - F.col("__n")).alias("before")),
                 F.col("__b")).alias("__bd"))
    j = narrow.join(boundary.withColumnRenamed("__k", "__bk"), F.col("__k").eqNullSafe(F.col("__bk")), "left")
    below = j.where(F.col("__bd").isNull() | (F.col("__b") < F.col("__bd.bb"))).select("__k", "__id")
    we = Window.partitionBy("__k", "__b").orderBy("__h", "__id")
    edge = j.where(F.col("__b") == F.col("__bd.bb")).withColumn("__r", F.row_number().over(we)) \
        .where(F.col("__r") <= F.col("__cap") - F.col("__bd.before")).select("__k", "__id")
    chosen = below.unionByName(edge)
    if sorted(df.columns) == sorted((key, id_col)):
        return chosen.select(*[F.col("__k" if c == key else "__id").alias(c) for c in df.columns])
    return df.join(chosen.select("__id"), F.col(id_col) == F.col("__id"), "left_semi")


def slice_counts(df: DataFrame, slices: list[str], measures: dict) -> DataFrame:
    """A3: one pass, GROUPING SETS over each slice column plus the total;
    ``slice_kind`` names the column a row slices by ('all' for the total)."""
    sets = [[s] for s in slices] + [[]]
    g = df.groupingSets(sets, *slices).agg(*[m.alias(n) for n, m in measures.items()],
                                           F.grouping_id().alias("__gid"))
    kind = F.lit("all")
    value = F.lit(None).cast("string")
    nb = len(slices)
    for i, s in enumerate(slices):
        bit_clear = (F.col("__gid").bitwiseAND(1 << (nb - 1 - i)) == 0)
        kind = F.when(bit_clear, F.lit(s)).otherwise(kind)
        value = F.when(bit_clear, F.col(s).cast("string")).otherwise(value)
    return g.select(kind.alias("slice_kind"), value.alias("slice_value"), *measures.keys())


def build_suite(df: DataFrame, priority: str, ordinal: str, source_caps=None, benign_cap: int | None = None,
                seed: int = 42, text_col: str = "text", label: str = "label", payload=None) -> DataFrame:
    """K2: per-source cap (before dedup) -> drop short rows -> dedup key ->
    first-wins dedup across sources -> language tag and row id -> global
    benign cap (attacks kept whole) -> deterministic shuffle key.  Returns
    ``id, language, shuffle_key`` and the payload columns."""
    payload = list(payload or [])
    x = df
    if source_caps is not None:
        x = capped_sample(x, "source", ordinal, source_caps, seed)
    keep = list(dict.fromkeys([ordinal, "source", label] + payload + ["language"]))
    kept = dedup_first_wins(x.withColumn("language", X.detect_language(text_col)), priority, ordinal, keep, text_col)
    if benign_cap is not None:
        kept = capped_sample(cut_lineage(kept), label, ordinal, {"0": benign_cap}, seed)
    return kept.withColumn("shuffle_key", shuffle_key("id", seed))
