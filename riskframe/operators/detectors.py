"""Detector registry (C15), score store (S4), pluggable scorers (U-1, U-6)
and the detector-evaluation reports (E16-E28, A16-A21, J5-J8).

A detector is anything that turns a row into a score in [0, 1].  Native
detectors are column expressions; model detectors are pandas functions run
with ``mapInPandas`` (one model load per task, Arrow batches).  Scores live
in one long table ``(detector, id, score)`` — written partitioned by
``detector`` — so every report is a join/aggregate over it.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import evaluate as EV
from riskframe.operators import roc
from riskframe.session import cut_lineage


@dataclass(frozen=True)
class Detector:
    name: str
    targets: tuple = ()
    trained_on: tuple = ()
    multi_label: bool = False
    column: Callable[[], Column] | None = None            # native detector
    batch_fn: Callable[[pd.Series], pd.Series] | None = None   # pluggable (U-1)
    description: str = field(default="")


def registry_frame(spark: SparkSession, detectors: list[Detector]) -> DataFrame:
    """The registry as a dimension table."""
    rows = [(d.name, list(d.targets), list(d.trained_on), d.multi_label) for d in detectors]
    return spark.createDataFrame(rows, "detector string, targets array<string>, trained_on array<string>, "
                                       "multi_label boolean")


def score_long(df: DataFrame, id_col: str, detectors: list[Detector], text_col: str = "text",
               keep: list[str] | None = None) -> DataFrame:
    """Score store rows ``(detector, id, score)``.  Native detectors are one
    projection + ``stack`` (single scan); pluggable ones run through
    ``mapInPandas``.  A failing row is left unscored (absent), never 0."""
    keep = list(keep or [])
    native = [d for d in detectors if d.column is not None]
    parts = []
    if native:
        wide = df.select(F.col(id_col).alias("id"), *keep, *[d.column().cast("double").alias(f"s{i}")
                                                              for i, d in enumerate(native)])
        stack = ", ".join(f"'{d.name}', s{i}" for i, d in enumerate(native))
        parts.append(wide.selectExpr(f"stack({len(native)}, {stack}) AS (detector, score)", "id", *keep)
                     .where(F.col("score").isNotNull()))
    for d in detectors:
        if d.batch_fn is not None:
            m = model_scores(df, id_col, text_col, d)
            if keep:
                m = m.join(df.select(F.col(id_col).alias("id"), *keep), "id")
            parts.append(m)
    out = reduce(lambda a, b: a.unionByName(b), parts)
    return out.select("detector", "id", "score", *keep)


def _score_texts(fn, texts: pd.Series, tries: int = 1) -> pd.Series:
    """Scores of a batch.  When the call fails the batch is halved, down to
    single rows, so a few bad rows cost a few extra calls; a single row, and
    a row that a call left without a score, gets up to ``tries`` calls.  A
    row that still fails has NaN."""
    out = pd.Series(float("nan"), index=texts.index, dtype="float64")

    def call(part: pd.Series):
        try:
            return pd.to_numeric(pd.Series(list(fn(part)), index=part.index), errors="coerce").astype("float64")
        except Exception:  # noqa: BLE001 - smaller calls follow
            return None

    parts = [(texts, 1)] if len(texts) else []
    while parts:
        part, attempt = parts.pop()
        s = call(part)
        if s is None and len(part) > 1:
            half = len(part) // 2
            parts += [(part.iloc[half:], 1), (part.iloc[:half], 1)]
            continue
        if s is not None:
            out.loc[part.index] = s
        missing = part.index if s is None else s.index[s.isna()]
        if len(part) > 1:
            parts += [(part.loc[[i]], 1) for i in missing]
        elif len(missing) and attempt < tries:
            parts.append((part, attempt + 1))
    return out


def model_scores(df: DataFrame, id_col: str, text_col: str, det: Detector) -> DataFrame:
    """U-1: run a pluggable batch scorer over Arrow batches.  A row whose
    score is NaN/None, or on which the model fails, is left out and stays
    'to do' for the next incremental run (K4); the other rows of its batch
    are scored, so the result does not depend on batches or partitions."""
    fn, name = det.batch_fn, det.name

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = _score_texts(fn, pdf["text"])
            ok = s.notna()
            yield pd.DataFrame({"detector": name, "id": pdf["id"][ok].astype("int64"), "score": s[ok]})

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return src.mapInPandas(run, "detector string, id long, score double")


def feature_matrix(store: DataFrame, detectors: list[str]):
    """Long score store -> one row per id with a column per detector
    (``groupBy(id).pivot``, values fixed up front so no extra pass); rows
    missing any detector are dropped and counted.  Returns (matrix, dropped
    count as a one-row DataFrame)."""
    wide = store.where(F.col("detector").isin(*detectors)).groupBy("id").pivot("detector", detectors) \
        .agg(F.first("score"))
    complete = wide.dropna(subset=detectors)
    dropped = wide.agg(F.count_if(F.greatest(*[F.col(d).isNull() for d in detectors])).alias("dropped"))
    return complete, dropped


class ModelDown(RuntimeError):
    """No row of the whole job succeeded: nothing was appended."""


def incremental_score(suite: DataFrame, store_path: str, id_col: str, det: Detector, text_col: str = "text",
                      max_tries: int = 3, abort_after: int = 15) -> int:
    """K4: score the rows of ``suite`` the store lacks for ``det`` and append
    them (partitioned by detector).  Each row gets up to ``max_tries``
    attempts; a row that keeps failing stays unscored (never 0).

    Every row is attempted, so the result does not depend on partitioning,
    and what succeeded is appended; if none of ``abort_after`` to-do rows or
    more succeeded, the model is down and :class:`ModelDown` is raised.
    A missing store is an empty one; any other read error is raised.
    Returns the number of rows appended."""
    from riskframe.sources import io
    spark = suite.sparkSession
    work = suite
    if io.path_exists(spark, store_path):
        work = todo(suite, io.read_scores(spark, store_path, [det.name]), id_col, det.name)
    fn, name = det.batch_fn, det.name

    def run(batches):
        for pdf in batches:
            s = _score_texts(fn, pdf["text"], max_tries)
            ok = s.notna()
            yield pd.DataFrame({"detector": name, "id": pdf["id"][ok].astype("int64"), "score": s[ok]})

    src = work.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    schema = "detector string, id long, score double"
    out = src.mapInPandas(run, schema).withColumn("scored_at", F.current_timestamp())
    from riskframe.session import cut_lineage
    out = cut_lineage(out)            # scored once, then counted and appended
    n = out.count()
    if n:
        io.append_scores(out, store_path)
    elif (tried := src.count()) >= abort_after:
        raise ModelDown(f"{name}: all {tried} rows failed after {max_tries} attempts each")
    return n


CHUNK_ROWS = 1_000_000


def incremental_run(suite: DataFrame, store, id_col: str, det: Detector, run: str, text_col: str = "text", max_tries: int = 3,
                    abort_after: int = 15, chunk_rows: int = CHUNK_ROWS) -> int:
    """K4 into a :class:`~riskframe.sources.runs.RunStore`: the rows the
    store lacks are scored chunk by chunk (a chunk is a hash class of the
    ids, so a retried run cuts the same chunks) and each chunk commits by
    itself.  A run started again under its name skips committed chunks and
    overwrites the others.  Rows that fail stay to do; when the last chunks
    had ``abort_after`` rows or more and not one of them succeeded, the model
    is down: :class:`ModelDown` is raised, earlier chunks stay committed.
    Returns the rows committed by this call."""
    import time
    spark = suite.sparkSession
    done = store.read(spark, [det.name])
    work = suite.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(done.select("id"), "id", "left_anti")
    chunks = store.chunks(spark, run, max(1, -(-work.count() // chunk_rows)))
    fn = det.batch_fn

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "score": _score_texts(fn, pdf["text"], max_tries)})

    added = failed_in_a_row = 0
    for k in range(chunks):
        if store.committed(spark, run, k, det.name):
            continue
        started = time.time()
        part = work.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == k).mapInPandas(score, "id long, score double")
        ok, failed = store.write(part.withColumn("score", F.nanvl("score", F.lit(None).cast("double"))), run, k, det.name)
        failed_in_a_row = 0 if ok else failed_in_a_row + failed
        if ok:
            store.commit(spark, run, k, det.name, ok, failed, started)
            added += ok
        elif failed_in_a_row >= abort_after:
            raise ModelDown(f"{det.name}: the last {failed_in_a_row} rows failed after {max_tries} attempts each")
    return added


def todo(suite: DataFrame, store: DataFrame, id_col: str, detector: str) -> DataFrame:
    """Suite rows without a score from ``detector`` (left anti join)."""
    done = store.where(F.col("detector") == detector).select(F.col("id").alias(id_col))
    return suite.join(done, id_col, "left_anti")


def exclude_contaminated(scored: DataFrame, registry: DataFrame, source: str = "source") -> DataFrame:
    """Drop (detector, row) pairs whose source the detector was trained on."""
    trained = registry.select("detector", F.explode("trained_on").alias(source))
    return scored.join(F.broadcast(trained), ["detector", source], "left_anti")


def carry_over(stores: list[DataFrame]) -> DataFrame:
    """Merge score stores, the first store holding a (detector, id)
    wins.  ``min_by`` over the store priority — a partial aggregate."""
    tagged = [s.select("detector", "id", "score", F.lit(i).alias("__p")) for i, s in enumerate(stores)]
    u = reduce(lambda a, b: a.unionByName(b), tagged)
    return u.groupBy("detector", "id").agg(F.min_by("score", "__p").alias("score"))


def complete_on_sample(store: DataFrame, sample: DataFrame, id_col: str) -> DataFrame:
    """Detectors that scored every row of the sample."""
    n = sample.agg(F.countDistinct(id_col)).scalar()
    cov = store.join(sample.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi") \
        .groupBy("detector").agg(F.countDistinct("id").alias("n_scored"))
    return cov.where(F.col("n_scored") == n).select("detector", "n_scored")


def coverage(store: DataFrame, suite: DataFrame, id_col: str, registry: DataFrame) -> DataFrame:
    """Per detector done / total and the rate."""
    total = suite.agg(F.countDistinct(id_col)).scalar()
    done = store.join(suite.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi") \
        .groupBy("detector").agg(F.countDistinct("id").alias("done"))
    out = registry.select("detector").join(done, "detector", "left").fillna(0, subset=["done"]) \
        .withColumn("total", total)
    return out.select("detector", "done", "total", F.try_divide(F.col("done"), F.col("total")).alias("rate"))


def coverage_eta(store: DataFrame, suite: DataFrame, id_col: str) -> DataFrame:
    """Per detector rows done, total, rate, observed throughput (rows
    per second between the first and last append) and the estimated seconds
    to finish the rest at that throughput (null until two appends exist)."""
    total = suite.agg(F.countDistinct(id_col)).scalar()
    g = store.join(suite.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi").groupBy("detector").agg(
        F.countDistinct("id").alias("done"),
        (F.unix_micros(F.max("scored_at")) - F.unix_micros(F.min("scored_at"))).alias("__span_us"))
    per_s = F.try_divide(F.col("done") * 1e6, F.col("__span_us"))
    return g.select("detector", "done", total.alias("total"), F.try_divide(F.col("done"), total).alias("rate"),
                    per_s.alias("rows_per_sec"),
                    F.try_divide(total - F.col("done"), per_s).alias("eta_seconds"))


# --- reports ---------------------------------------------------------------------------

def comparison(scored: DataFrame, registry: DataFrame, budget: float = C.DEFAULT_FPR_BUDGET,
               source: str = "source") -> DataFrame:
    """E21 core: per detector, after contamination exclusion — rows
    excluded, n, class counts, AUC, recall at the budget, its threshold and
    the FPR actually reached at that threshold."""
    total = scored.groupBy("detector").agg(F.count(F.lit(1)).alias("__all"))
    kept = exclude_contaminated(scored, registry, source)
    t = roc.score_table(kept, "score", "label", ["detector"])
    a = roc.auc(t, ["detector"])
    r = roc.recall_at_fpr(t, budget, ["detector"])
    thr = r.select("detector", F.col("threshold").alias("thr"))
    fpr = kept.join(thr, "detector").groupBy("detector").agg(
        F.try_divide(F.count_if((F.col("label") == 0) & (F.col("score") >= F.col("thr"))),
                     F.count_if(F.col("label") == 0)).alias("actual_fpr"))
    return (total.join(a, "detector", "left").join(r, "detector", "left").join(fpr, "detector", "left")
            .select("detector", (F.col("__all") - F.col("n_pos") - F.col("n_neg")).alias("rows_excluded"),
                    (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg", "auc", "recall",
                    "threshold", "actual_fpr"))


def per_class_detection(scored: DataFrame, thresholds: DataFrame, registry: DataFrame,
                        classes: list[str], cls: str = "attack_class") -> DataFrame:
    """Per detector and attack class, share of rows at or above the
    detector's threshold, with the ``targeted`` flag."""
    j = scored.where(F.col(cls).isin(*classes)).join(thresholds, "detector")
    g = j.groupBy("detector", cls).agg(F.count(F.lit(1)).alias("n"),
                                       F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("detected"))
    return g.join(F.broadcast(registry.select("detector", "targets")), "detector") \
        .select("detector", cls, "n", "detected", F.array_contains("targets", F.col(cls)).alias("targeted"))


def class_vs_benign(scored: DataFrame, classes: list[str], cls: str = "attack_class") -> DataFrame:
    """AUC of one attack class against all benign rows.  Benign rows
    are replicated once per class (|classes| copies); attack rows keep their
    own class; then one keyed AUC."""
    x = _explode_benign(scored, classes, cls)
    t = roc.score_table(x, "score", "label", ["detector", "vs_class"])
    return roc.auc(t, ["detector", "vs_class"])


def class_vs_benign_at_budget(scored: DataFrame, classes: list[str], budget: float = C.DEFAULT_FPR_BUDGET,
                              cls: str = "attack_class") -> DataFrame:
    """E26 in full: the AUC of :func:`class_vs_benign` with the recall at the
    budget and its threshold."""
    keys = ["detector", "vs_class"]
    t = roc.score_table(_explode_benign(scored, classes, cls), "score", "label", keys)
    return roc.auc(t, keys).join(roc.recall_at_fpr(t, budget, keys), keys, "left")


def report(scored: DataFrame, registry: DataFrame, classes: list[str], budget: float = C.DEFAULT_FPR_BUDGET,
           min_rows: int = C.MIN_LANGUAGE_ROWS, id_col: str = "id", source: str = "source", lang: str = "lang",
           cls: str = "attack_class", replicates: int = 200, seed: int = 0) -> DataFrame:
    """Per detector, after contamination exclusion, the AUC and the
    recall at the budget with bootstrap intervals — over all rows, per
    language and per attack class against benign.  Slices below ``min_rows``
    rows or with one class only are left out (the minimum is the report's
    own rule)."""
    kept = exclude_contaminated(scored, registry, source)
    cols = ["detector", "slice", "id", "score", "label"]
    row = lambda d, s: d.select("detector", s.alias("slice"), F.col(id_col).alias("id"), "score", "label")
    x = (row(kept, F.lit("all")).unionByName(row(kept, F.concat(F.lit("lang="), lang)))
         .unionByName(row(_explode_benign(kept, classes, cls), F.concat(F.lit("class="), "vs_class"))))
    x = cut_lineage(x.select(*cols))
    keys = ["detector", "slice"]
    options = {"replicates": replicates, "seed": seed}
    a = EV.bootstrap_auc(x, "id", "score", "label", keys, **options)
    r = EV.bootstrap_recall(x, "id", "score", "label", keys, budget=budget, **options)
    a = a.select(*keys, "n", F.col("point").alias("auc"), F.col("ci_lo").alias("auc_lo"), F.col("ci_hi").alias("auc_hi"))
    r = r.select(*keys, F.col("point").alias("recall"), F.col("ci_lo").alias("recall_lo"), F.col("ci_hi").alias("recall_hi"))
    return a.join(r, keys).where((F.col("n") >= min_rows) & ~F.isnan("auc"))


def _explode_benign(scored: DataFrame, classes: list[str], cls: str) -> DataFrame:
    arr = F.array(*[F.lit(c) for c in classes])
    benign = scored.where(F.col("label") == 0).withColumn("vs_class", F.explode(arr))
    attack = scored.where((F.col("label") == 1) & F.col(cls).isin(*classes)).withColumn("vs_class", F.col(cls))
    return benign.unionByName(attack)


def polarity(scored: DataFrame, registry: DataFrame, cls: str = "attack_class") -> DataFrame:
    """Mean score over attack rows of the detector's declared targets
    (all attack rows when it declares none) must exceed the benign mean."""
    j = scored.join(F.broadcast(registry.select("detector", "targets")), "detector")
    in_scope = (F.size("targets") == 0) | F.array_contains("targets", F.col(cls))
    g = j.groupBy("detector").agg(
        F.avg(F.when((F.col("label") == 1) & in_scope, F.col("score"))).alias("mean_attack"),
        F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("mean_benign"))
    return g.withColumn("polarity_ok", F.coalesce(F.col("mean_attack") > F.col("mean_benign"), F.lit(False)))


def max_ensemble(scored: DataFrame, name: str = "max_ensemble") -> DataFrame:
    """Per row the max over detectors; rows missing a detector keep the
    max of those present."""
    keys = [c for c in scored.columns if c not in ("detector", "score")]
    return scored.groupBy(*keys).agg(F.max("score").alias("score")).withColumn("detector", F.lit(name))


def ensemble_vs_single(scored: DataFrame, id_col: str = "id", replicates: int = 50, seed: int = 0) -> DataFrame:
    """AUC with bootstrap interval for every detector and for the max
    ensemble, and the verdict of the ensemble against the best single
    detector: 'ensemble better' / 'single better' only when the intervals
    do not overlap, else 'overlap'."""
    ens = max_ensemble(scored)
    both = scored.unionByName(ens.select(*scored.columns))
    # a few rows per configuration, read three times below: write once
    ci = cut_lineage(EV.bootstrap_auc(both, id_col, "score", "label", ["detector"], replicates=replicates,
                                      seed=seed))
    singles = ci.where(F.col("detector") != "max_ensemble")
    best = singles.agg(F.max_by(F.struct("detector", "point", "ci_lo", "ci_hi"), "point")).scalar()
    ens = ci.where(F.col("detector") == "max_ensemble").select(F.struct("ci_lo", "ci_hi")).scalar()
    verdict = (F.when(ens["ci_lo"] > best["ci_hi"], "ensemble better")
               .when(ens["ci_hi"] < best["ci_lo"], "single better").otherwise("overlap"))
    is_ens = F.col("detector") == "max_ensemble"
    return ci.withColumns({"verdict": F.when(is_ens, verdict), "best_single": F.when(is_ens, best["detector"])})


def run_diff(old: DataFrame, new: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """Join two runs' boolean predictions on id; counts per
    (old, new, label) and the change in TP/FP/TN/FN."""
    j = old.select(id_col, label, F.col("pred").alias("old")).join(
        new.select(id_col, F.col("pred").alias("new")), id_col)
    return j.groupBy("old", "new", label).agg(F.count(F.lit(1)).alias("n"))


def flipped_rows(old: DataFrame, new: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """The rows whose prediction changed and whether the change put
    them right."""
    j = old.select(id_col, label, F.col("pred").alias("old")).join(
        new.select(id_col, F.col("pred").alias("new")), id_col)
    return j.where(F.col("old") != F.col("new")).withColumn("fixed", F.col("new") == (F.col(label) == 1))


def confusion_change(old: DataFrame, new: DataFrame, id_col: str, label: str = "label") -> DataFrame:
    """One row with TP/FP/TN/FN of both runs over the rows they share,
    their change and the number of flipped rows."""
    j = old.select(id_col, label, F.col("pred").alias("old")).join(
        new.select(id_col, F.col("pred").alias("new")), id_col)
    y = F.col(label) == 1
    cell = {"TP": lambda p: y & p, "FP": lambda p: ~y & p, "TN": lambda p: ~y & ~p, "FN": lambda p: y & ~p}
    g = j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") != F.col("new")).alias("n_flipped"),
              *[F.count_if(f(F.col(run))).alias(f"{c}_{run}") for run in ("old", "new") for c, f in cell.items()])
    return g.withColumns({f"{c}_change": F.col(f"{c}_new") - F.col(f"{c}_old") for c in cell})


def quantiles_by(df: DataFrame, keys: list[str], value: str, qs=(0.25, 0.5, 0.75)) -> DataFrame:
    """Linear-interpolated quantiles ``x[lo] + (x[hi]-x[lo])*(pos-lo)``
    with ``pos = (n-1)*q`` — exact, via order statistics (no per-group sort)."""
    from riskframe.operators.metrics import value_at_ranks
    n = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    rk = []
    for q in qs:
        pos = (F.col("n") - 1) * F.lit(q)
        nm = f"q{int(round(q * 100))}"
        rk.append(n.select(*keys, F.lit(nm + "_lo").alias("rank_name"), F.floor(pos).cast("long").alias("r")))
        rk.append(n.select(*keys, F.lit(nm + "_hi").alias("rank_name"), F.ceil(pos).cast("long").alias("r")))
    ranks = reduce(lambda a, b: a.unionByName(b), rk)
    vals = value_at_ranks(df, keys, value, ranks)
    names = [r for q in qs for r in (f"q{int(round(q * 100))}_lo", f"q{int(round(q * 100))}_hi")]
    wide = vals.groupBy(*keys).pivot("rank_name", names).agg(F.first("value")).join(n, keys)
    cols = []
    for q in qs:
        nm = f"q{int(round(q * 100))}"
        pos = (F.col("n") - 1) * F.lit(q)
        frac = pos - F.floor(pos)
        cols.append((F.col(f"{nm}_lo") + (F.col(f"{nm}_hi") - F.col(f"{nm}_lo")) * frac).alias(f"p{nm[1:]}"))
    return wide.select(*keys, "n", *cols)
