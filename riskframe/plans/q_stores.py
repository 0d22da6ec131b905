"""Stored verdicts and scores, deadlines, sketches and large rule packs.

Bindings: ``events`` are verdicts of the prompt of ``user_id`` (risk by
``value``), written in epochs of six days; a request is an event, its
endpoint the event type, and it ends after ``value`` seconds unless it is an
error; a slower judge answers four requests in five within a quarter of an
hour.  ``documents`` are scored by a stand-in model, and their own phrases
form a pack of ten thousand patterns.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.operators import detectors as D
from riskframe.operators import outcomes as O
from riskframe.operators import rule_index, sketch
from riskframe.plans.q_detect import vowel_share
from riskframe.session import checkpoint_dir
from riskframe.sources.keyed import KeyedTable, escalating
from riskframe.sources.runs import RunStore, progress
from riskframe.sources.tables import table, text_table
from riskframe.streaming.windows import ESCALATION_SCORE, ESCALATION_SOURCE

EPOCH_DAYS = 6
EPOCHS = 5
DEADLINE_SECONDS = 100.0
JUDGE_DEADLINE = 600.0
SKETCH_QUANTILES = [0.5, 0.95, 0.99]
PACK = 10_000
PACK_REGEX = 40


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _risk(value: str):
    return F.when(F.col(value) >= 150, "HIGH").when(F.col(value) >= 60, "MEDIUM").otherwise("LOW")


def verdict_store(path: str) -> KeyedTable:
    return KeyedTable(path, "prompt_hash", "prompt_hash string, risk string, score double, source string",
                      escalating({"risk": "HIGH", "score": ESCALATION_SCORE, "source": ESCALATION_SOURCE}), buckets=16)


def verdict_store_merged(spark, sf_dir) -> DataFrame:
    """T9 + S10: verdicts written epoch by epoch (one of them twice, with a
    compaction in between), read as one verdict per prompt."""
    ev = table(spark, sf_dir, "events")
    first = ev.agg(F.min(F.to_date("ts"))).scalar()
    epoch = F.floor(F.datediff(F.to_date("ts"), first) / EPOCH_DAYS).cast("int")
    rows = ev.select(F.sha2(F.col("user_id").cast("string"), 256).alias("prompt_hash"), _risk("value").alias("risk"),
                     F.col("value").alias("score"), F.col("event_type").alias("source"), F.least(epoch, F.lit(EPOCHS - 1)).alias("epoch"))
    store = verdict_store(_folder(spark, "verdict-store"))
    for e in (0, 1, 2, 2, 3, 4):
        store.write_epoch(rows.where(F.col("epoch") == e), e)
        if e == 3:
            store.compact(spark)
    return store.read(spark)


def incremental_scoring(spark, sf_dir) -> DataFrame:
    """K4 + S4: documents scored chunk by chunk with a commit each; a second
    run finds nothing left that the model can score."""
    d = text_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    store = RunStore(_folder(spark, "run-store"))
    det = D.Detector("vowels", batch_fn=vowel_share)
    chunk = d.count() // 3 + 1
    D.incremental_run(d, store, "doc_id", det, "first", chunk_rows=chunk)
    if D.incremental_run(d, store, "doc_id", det, "second", chunk_rows=chunk, abort_after=1 << 60):
        raise AssertionError("rows were scored twice")
    return store.read(spark, ["vowels"]).select("detector", "id", F.round("score", 9).alias("score"))


def scoring_progress(spark, sf_dir) -> DataFrame:
    """Rows done, speed and time left by detector, from a write log: a
    run a day, a row of it done where the value is above 20."""
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    log = ev.groupBy(F.col("event_type").alias("detector"), F.to_date("ts").cast("string").alias("run")).agg(
        F.count_if(F.col("value") > 20).alias("rows"), F.count_if(~(F.col("value") > 20)).alias("failed"),
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"))
    total = ev.agg(F.count(F.lit(1))).scalar()
    p = progress(log, total)
    return p.select("detector", "runs", "done", "failed", "total", *[F.round(c, 6).alias(c) for c in ("rate", "rows_per_sec", "eta_seconds")])


def requests_and_ends(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    took = F.make_dt_interval(secs=F.col("value").cast("decimal(18,6)"))
    return (ev.select("event_id", "ts", F.col("event_type").alias("endpoint")),
            ev.where(F.col("event_type") != "error").select("event_id", (F.col("ts") + took).alias("ts")))


def request_timeouts(spark, sf_dir) -> DataFrame:
    """Requests and timeouts by endpoint."""
    r, e = requests_and_ends(spark, sf_dir)
    return O.timeouts_by_endpoint(O.outcomes(r, e, "event_id", "ts", DEADLINE_SECONDS))


def served_and_judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    judge = F.when(F.get_json_object("props", "$.k").try_cast("int") >= 70, "HIGH").otherwise("LOW")
    late = F.make_dt_interval(secs=F.pmod(F.col("event_id") * 37, F.lit(900)).cast("decimal(18,6)"))
    return (ev.select("event_id", "ts", _risk("value").alias("risk")),
            ev.where(F.pmod("event_id", F.lit(5)) != 0).select("event_id", (F.col("ts") + late).alias("ts"), judge.alias("risk")))


def confirmed_verdicts(spark, sf_dir) -> DataFrame:
    """Served verdicts after the slower judge: unverified, escalated or
    standing."""
    served, judged = served_and_judged(spark, sf_dir)
    return O.confirmations(served, judged, "event_id", "ts", JUDGE_DEADLINE).select("event_id", "risk", "confirmation", "final_risk")


def latency_sketches(spark, sf_dir) -> DataFrame:
    """Percentiles from daily sketches merged by type, and
    whether the exact rank of each lies within the stated error."""
    ev = table(spark, sf_dir, "events")
    daily = sketch.window_sketches(ev, ["event_type"], "ts", "value")
    est = sketch.quantiles(sketch.merged(daily, ["event_type"]), ["event_type"], SKETCH_QUANTILES)
    r = sketch.rank_errors(est, ev, ["event_type"], "value")
    return r.select("event_type", "q", "n", (F.col("rank_error") <= sketch.RANK_ERROR).alias("within_rank_error"))


def large_rules(spark, sf_dir) -> DataFrame:
    """The phrases of three words of all documents in hash order, the first
    ten thousand; a few are regular expressions, two have no literal run."""
    d = text_table(spark, sf_dir, "documents", "doc_id")
    phrase = F.explode(F.regexp_extract_all("text", F.lit("[a-z]+ [a-z]+ [a-z]+"), F.lit(0))).alias("p")
    top = d.select(phrase).distinct().select("p", F.md5("p").alias("h")).orderBy("h", "p").limit(PACK)
    # at most PACK rows: a window over them is bounded
    ranked = top.select("p", "h", (F.row_number().over(Window.orderBy("h", "p")) - 1).cast("long").alias("pattern_id"))
    priority = (F.conv(F.substring("h", 1, 2), 16, 10).cast("int") % 3).alias("priority")
    regex = F.col("pattern_id") < PACK_REGEX
    rules = ranked.select("pattern_id", priority, F.when(regex, F.replace("p", F.lit(" "), F.lit("\\s+"))).otherwise(F.col("p")).alias("pattern"), (~regex).alias("literal"))
    extra = spark.createDataFrame([(PACK, 0, "[qz][a-z][qxz]", False), (PACK + 1, 2, "(?i)THE (the|an) the", False)], rules.schema)
    return rules.unionByName(extra)


def large_rule_pack(spark, sf_dir) -> DataFrame:
    """P5/S7 with ten thousand patterns: the first of them that each document
    matches, by priority."""
    d = text_table(spark, sf_dir, "documents", "doc_id")
    return rule_index.match(d, large_rules(spark, sf_dir), "doc_id", "text")


QUERIES = {f.__name__: f for f in (
    verdict_store_merged, incremental_scoring, scoring_progress, request_timeouts, confirmed_verdicts, latency_sketches, large_rule_pack)}
