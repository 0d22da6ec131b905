"""Secret scan over an incremental blob ledger, in DataFrame operations only.

Every version of a file is addressed by the SHA-256 of its text.  The ledger
(a Parquet folder) holds, per scan of a blob, a row with the rule versions
that were run and a row per span found, with the rule and version that found
it.  A scan takes the distinct blobs, skips the (blob, rule version) pairs
the ledger already has, scans the rest, appends their rows, and joins the
findings of the rule versions asked for back to every path that holds the
blob.  A rule that changes gets a new version; findings of versions that are
not asked for stay in the ledger and out of the result.

Spans are code point offsets, end exclusive.  ``split`` and
``regexp_extract_all`` cut a text at the same leftmost non-overlapping
matches; the lengths of both are exploded to narrow rows, and a running sum
per blob and rule gives the offsets, in time linear in the matches.

A private key spans its header to its footer; without a footer the header and
up to 60 lines of key text after it.

Defined results: a null text is an empty one, with no spans; repeated rows
share a blob and each get its findings; texts are scanned whole; spans that
start together are ordered by kind as listed, then by end; an empty table
gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.llm.common import saved

# fixed values: kind, version, pattern, group whose length counts, least length
RULES = [
    ("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    ("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+){0,20}-----END [A-Z ]*PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{16,}){0,60})", 0, 1),
    ("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    ("forge", 1, r"gh[pousr]_[A-Za-z0-9]{30,}", 0, 1),
]
BASE = ("assign", "access", "hex")
# a row with ``scanned`` per scan of a blob, a row with ``rule`` per span
LEDGER = "blob binary, scanned array<string>, rule string, start int, end int"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def rule_name(rule) -> str:
    return f"{rule[0]}@{rule[1]}"


def blob_of(text: str = "text"):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


MATCHES = "array<struct<rule:string,gap:int,hit:int,val:int,scanned:array<string>>>"


def matches_of(text: str, rule):
    """For each match in order: the lengths of the text before it, of the
    match and of its counted group."""
    _, _, pattern, group, _ = rule
    t, p = F.col(text), F.lit(pattern)
    whole = F.regexp_extract_all(t, p, F.lit(0))
    counted = F.regexp_extract_all(t, p, F.lit(group)) if group else whole
    parts = F.arrays_zip(F.split(t, pattern, -1).alias("gap"), whole.alias("hit"), counted.alias("val"))
    # the last gap has no match after it
    rows = F.transform(F.filter(parts, lambda x: x["hit"].isNotNull()), lambda x: F.struct(
        F.lit(rule_name(rule)).alias("rule"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["val"]).alias("val"),
        F.lit(None).cast("array<string>").alias("scanned")))
    return F.when(t.rlike(pattern), rows).otherwise(F.array().cast(MATCHES))


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; a missing folder is an empty ledger, any other
    read error is raised."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def new_ledger(spark: SparkSession) -> str:
    """Path of a fresh ledger in the shared folder."""
    from riskframe.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}"


def unseen(docs: DataFrame, ledger: DataFrame, rules=RULES, text_col: str = "text") -> DataFrame:
    """Distinct blobs with a rule version the ledger lacks: (blob, text,
    todo)."""
    names = [rule_name(r) for r in rules]
    blobs = (docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of())
             .groupBy("blob").agg(F.first("text").alias("text")))
    known = ledger.where("rule is null").select("blob", F.explode("scanned").alias("s")).groupBy("blob").agg(F.collect_set("s").alias("done"))
    return (blobs.join(known, "blob", "left")
            .select("blob", "text", F.array_except(F.array(*map(F.lit, names)), F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
            .where(F.size("todo") > 0))


def update_ledger(docs: DataFrame, path: str, rules=RULES, text_col: str = "text") -> None:
    """Scans the unseen (blob, rule version) pairs and appends their rows."""
    todo = unseen(docs, open_ledger(docs.sparkSession, path), rules, text_col)
    none = lambda kind: F.lit(None).cast(kind)
    mark = F.array(F.struct(none("string").alias("rule"), none("int").alias("gap"), none("int").alias("hit"), none("int").alias("val"),
                            F.col("todo").alias("scanned")))
    found = F.concat(mark, *[F.when(F.array_contains("todo", rule_name(r)), matches_of("text", r)).otherwise(F.array().cast(MATCHES)) for r in rules])
    rows = todo.select("blob", F.posexplode(found).alias("pos", "m")).select("blob", "pos", "m.*")
    upto = F.sum(F.col("gap") + F.col("hit")).over(Window.partitionBy("blob", "rule").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    least = F.create_map(*[x for r in rules for x in (F.lit(rule_name(r)), F.lit(r[4]))])
    (rows.withColumn("end", upto.cast("int")).where(F.col("rule").isNull() | (F.col("val") >= least[F.col("rule")]))
     .select("blob", "scanned", "rule", (F.col("end") - F.col("hit")).alias("start"), "end").write.mode("append").parquet(path))


def findings(docs: DataFrame, path: str, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` (all columns, as the struct ``row``) with the sorted spans of
    the given rule versions from the ledger; ``kind`` is the place of a rule
    in ``rules``."""
    kinds = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(rule_name(r)), F.lit(i))])
    led = open_ledger(docs.sparkSession, path).where(F.col("rule").isin([rule_name(r) for r in rules]))
    led = led.select("blob", F.struct("start", kinds[F.col("rule")].alias("kind"), "end").alias("s"))
    # written first, so that the join can split a blob that many rows share
    led = saved(led.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans")))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), blob_of(text_col).alias("blob"))
    return d.join(led, "blob", "left").select("row", F.coalesce(F.col("spans").cast(SPANS), F.array().cast(SPANS)).alias("spans"))


def scan(docs: DataFrame, ledger_path: str | None = None, rules=RULES, text_col: str = "text") -> DataFrame:
    """Brings the ledger up to date with ``docs`` and returns
    :func:`findings`."""
    path = ledger_path or new_ledger(docs.sparkSession)
    update_ledger(docs, path, rules, text_col)
    return findings(docs, path, rules, text_col)


def spans_text(spans: str, rules=RULES, kinds=None):
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    s = F.col(spans)
    if kinds is not None:
        s = F.filter(s, lambda x: F.get(names, x["kind"]).isin(*kinds))
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text, spans):
    """The text with every span (overlapping ones together) replaced by
    ``[SECRET]``."""
    run = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"],
                   F.concat(a["out"], text.substr(a["at"] + 1, s["start"] - a["at"]), F.lit("[SECRET]")))
            .otherwise(a["out"]).alias("out")))
    return F.when(F.size(spans) == 0, text).otherwise(
        F.concat(run["out"], text.substr(run["at"] + 1, F.greatest(F.length(text) - run["at"], F.lit(0)))))


def mask(docs: DataFrame, ledger_path: str | None = None, rules=RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with its secrets masked, same rows and columns (``n_chars``
    follows the new text where the column exists)."""
    d = scan(docs, ledger_path, rules, text_col)
    cols = {c: F.col(f"row.`{c}`") for c in docs.columns}
    text = redacted(cols[text_col], F.col("spans"))
    d = d.select(*[(text if c == text_col else cols[c]).alias(c) for c in docs.columns])
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("long", "integer"):
        kind = docs.schema["n_chars"].dataType
        d = d.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_col)).cast(kind))
    return d
