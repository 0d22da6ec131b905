"""Evaluation statistics built on the ROC score table: confusion counts,
derived rates, slice bundles, Poisson bootstrap intervals, threshold grids,
union-FPR budgets and hash splits."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import config as C
from riskframe.operators import roc
from riskframe.operators.roc import ALL, _done, _keys
from riskframe.session import cut_lineage


def _ratio(num: Column, den: Column) -> Column:
    """``num/den`` with a zero denominator giving 0.0."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def derived_metrics(df: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, f1, fpr from TP/FP/TN/FN columns."""
    tp, fp, tn, fn = (F.col(c) for c in ("TP", "FP", "TN", "FN"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return (df.withColumn("accuracy", _ratio(tp + tn, tp + fp + tn + fn))
            .withColumn("precision", precision)
            .withColumn("recall", recall)
            .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                     F.col("precision") + F.col("recall")))
            .withColumn("fpr", _ratio(fp, fp + tn)))


def confusion(df: DataFrame, predicted: Column, label: str, keys=None) -> DataFrame:
    """TP/FP/TN/FN of a boolean prediction, one aggregation pass."""
    ks = [] if not keys else ([keys] if isinstance(keys, str) else list(keys))
    y = F.col(label).cast("int") == 1
    p = predicted
    return df.groupBy(*ks).agg(
        F.count_if(y & p).alias("TP"), F.count_if(~y & p).alias("FP"),
        F.count_if(~y & ~p).alias("TN"), F.count_if(y & ~p).alias("FN"))


def confusion_at_threshold(df: DataFrame, score: str, label: str, threshold: float, keys=None) -> DataFrame:
    """A5 + A7: confusion at ``score >= threshold`` and its derived rates."""
    return derived_metrics(confusion(df, F.coalesce(F.col(score) >= threshold, F.lit(False)), label, keys))


def format_ci(point, lo, hi, digits: int = 3) -> Column:
    """``point [lo, hi]`` with ``digits`` decimals."""
    f = f"%.{digits}f"
    c = [F.col(x) if isinstance(x, str) else x for x in (point, lo, hi)]
    return F.format_string(f"{f} [{f}, {f}]", *c)


def prevalence_adjusted_precision(tpr: Column, fpr: Column, prevalence: float) -> Column:
    """Precision at an assumed base rate ``prevalence``."""
    num = F.lit(prevalence) * tpr
    den = num + F.lit(1.0 - prevalence) * fpr
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def evaluate_slices(df: DataFrame, score: str, label: str, keys=None, budget: float = C.DEFAULT_FPR_BUDGET,
                    threshold: float | None = None, min_n: int = C.UNDERPOWERED_N) -> DataFrame:
    """Per slice n, class counts, AUC, recall at the FPR budget and
    its threshold, confusion at a shared ``threshold`` (when given),
    ``underpowered`` (n < min_n) and the single-class note."""
    ks = _keys(keys)
    t = roc.score_table(df, score, label, None if ks == [ALL] else ks)
    a = roc.auc(t, None if ks == [ALL] else ks)
    r = roc.recall_at_fpr(t, budget, None if ks == [ALL] else ks)
    out_keys = [] if ks == [ALL] else ks
    if out_keys:
        res = a.join(r, out_keys, "left")
    else:   # one row each: attach as scalar subqueries
        rs = r.select(F.struct("recall", "threshold").alias("s")).scalar()
        res = a.withColumns({"recall": rs["recall"], "threshold": rs["threshold"]})
    n = F.col("n_pos") + F.col("n_neg")
    note = (F.when(F.col("n_pos") == 0, F.lit("no positives: FPR only"))
            .when(F.col("n_neg") == 0, F.lit("no negatives: recall only")))
    res = res.withColumn("n", n).withColumn("underpowered", n < min_n).withColumn("note", note)
    if threshold is not None:
        cm = confusion_at_threshold(df.where(F.col(score).isNotNull()), score, label, threshold,
                                    out_keys or None)
        cm = cm.select(*out_keys, "TP", "FP", "TN", "FN", F.col("recall").alias("recall_at_threshold"),
                       F.col("fpr").alias("fpr_at_threshold"))
        if out_keys:
            res = res.join(cm, out_keys, "left")
        else:
            cs = cm.select(F.struct(*[c for c in cm.columns]).alias("s")).scalar()
            res = res.withColumns({c: cs[c] for c in cm.columns})
    return res.withColumnRenamed("threshold", "threshold_at_budget")


# --- E7 Poisson bootstrap ------------------------------------------------------

def hash_uniform(*parts: Column) -> Column:
    """Uniform in [0,1) from the first 52 bits of ``md5(p1:p2:...)`` —
    reproducible anywhere md5 exists."""
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(2 ** 52)


def poisson1_draw(u: Column, kmax: int = 20) -> Column:
    """Inverse CDF of Poisson(1): the number of cumulative probabilities
    below ``u``."""
    cdf = C.poisson1_cdf(kmax)
    return reduce(lambda a, b: a + b, [F.when(u > F.lit(c), 1).otherwise(0) for c in cdf])


def _poisson_weights(base, replicates: int, cdf) -> "np.ndarray":
    """``len(base) x replicates`` Poisson(1) weights: draw *r* of a row mixes
    its 60-bit hash with *r* (a counter-based generator of 64-bit
    multiplications and shifts) into a uniform of 52 bits."""
    import numpy as np
    u64 = np.uint64
    step = np.arange(1, replicates + 1, dtype=u64) * u64(0x9E3779B97F4A7C15)
    z = base.astype(u64)[:, None] + step[None, :]
    z = (z ^ (z >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> u64(27))) * u64(0x94D049BB133111EB)
    z ^= z >> u64(31)
    u = (z >> u64(12)).astype(np.float64) / float(2 ** 52)
    return np.searchsorted(np.asarray(cdf), u, side="left").astype(np.int64)


class _DescendingFold:
    """Running fold of one (key, bucket) over its tie groups, highest score
    first.  ``start`` is None while totals and the AUC numerator are taken;
    else (positives above, negatives above, all negatives) per replicate,
    and the most positives within the false-positive budget are kept."""

    def __init__(self, replicates: int, cdf, budget: float, start=None):
        import numpy as np
        self.np, self.R, self.cdf, self.budget = np, replicates, cdf, budget
        zero = np.zeros(replicates, dtype=np.int64)
        self.pos, self.neg = (start[0].copy(), start[1].copy()) if start else (zero.copy(), zero.copy())
        self.all_neg = start[2] if start else None
        self.num2 = zero.copy()
        self.best = self._within(self.pos[None, :], self.neg[None, :]) if start else None
        self.pending = None

    def _within(self, cp, cn):
        with self.np.errstate(divide="ignore", invalid="ignore"):
            return self.np.where(cn / self.all_neg <= self.budget, cp, 0).max(axis=0)

    def _fold(self, P, N):
        if not len(P):
            return
        cp, cn = self.pos + self.np.cumsum(P, axis=0), self.neg + self.np.cumsum(N, axis=0)
        if self.all_neg is None:
            self.num2 += (N * (2 * (cp - P) + P)).sum(axis=0)
        else:
            self.best = self.np.maximum(self.best, self._within(cp, cn))
        self.pos, self.neg = cp[-1], cn[-1]

    def add(self, s, y, base, chunk: int):
        np = self.np
        for lo in range(0, len(s), chunk):
            sv, yv = s[lo:lo + chunk], y[lo:lo + chunk][:, None]
            W = _poisson_weights(base[lo:lo + chunk], self.R, self.cdf)
            at = np.flatnonzero(np.r_[True, sv[1:] != sv[:-1]])
            P, N = np.add.reduceat(W * yv, at, axis=0), np.add.reduceat(W * (1 - yv), at, axis=0)
            if self.pending is not None:
                last, lp, ln = self.pending
                if last == sv[0]:           # a tie group goes on
                    P[0] += lp
                    N[0] += ln
                else:
                    self._fold(lp[None, :], ln[None, :])
            self._fold(P[:-1], N[:-1])
            self.pending = (sv[-1], P[-1], N[-1])

    def close(self):
        if self.pending is not None:
            self._fold(self.pending[1][None, :], self.pending[2][None, :])
            self.pending = None
        return self


def bootstrap(df: DataFrame, id_col: str, score: str, label: str, keys=None, statistic: str = "auc",
              budget: float = C.DEFAULT_FPR_BUDGET, replicates: int = 200, alpha: float = 0.05, seed: int = 0,
              buckets: int = 1024, chunk_cells: int = 2_000_000) -> DataFrame:
    """E7/U-5: percentile interval of a statistic of the ranked scores
    (``auc``, or ``recall_at_fpr`` at ``budget``) under a Poisson(1)
    bootstrap.

    Row *i* gets weight Poisson(1) in replicate *r*, drawn from the first 60
    bits of ``md5(id:seed)`` mixed with *r*, so every replicate is
    reproducible and independent of partitioning.  Replicates in which a
    class vanishes are skipped and counted (``n_boot_effective``).  Interval
    indices are ``int(alpha/2*m)`` and ``min(int((1-alpha/2)*m), m-1)`` over
    the sorted valid replicates.

    Rows are shuffled to their (key, score bucket) — never one copy per
    replicate — and folded there from the highest score down, tie group by
    tie group, into R-vectors; one row per bucket is combined per key.  The
    recall needs a second pass, over the buckets alone in which some
    replicate passes the budget, started from the counts above them.  A task
    holds ``chunk_cells`` weights at a time; all sums are exact integers."""
    import numpy as np
    import pandas as pd
    if statistic not in ("auc", "recall_at_fpr"):
        raise ValueError(f"unknown statistic {statistic!r}")
    ks = [] if not keys else ([keys] if isinstance(keys, str) else list(keys))
    gk = ks or [ALL]
    table = roc.score_table(df, score, label, ks or None)
    point = roc.auc(table, ks or None)
    if statistic == "auc":
        point = point.withColumnRenamed("auc", "point")
    else:
        r = roc.recall_at_fpr(table, budget, ks or None).withColumnRenamed("recall", "point")
        point = point.join(r.select(*ks, "point"), ks, "left") if ks else point.withColumn("point", r.select("point").scalar())
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    base = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(
        *(ks or [F.lit(0).alias(ALL)]), h.alias("__h"), F.col(score).cast("double").alias("__s"),
        (F.col(label).cast("int") == 1).cast("int").alias("__y"))
    base = roc.range_buckets(base, gk, ["__s"], buckets)
    cdf = C.poisson1_cdf(20)   # the tail beyond is below the 52-bit grid of the draw
    R = int(replicates)
    chunk = max(1, chunk_cells // R)
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.select(*gk).schema.fields)
    key_cols = [*gk, "__b"]
    vec = "array<long>"

    def runs(pdf):
        """(key values, begin, end) of the runs of equal keys of a batch."""
        kv = list(pdf[key_cols].itertuples(index=False, name=None))
        i = 0
        while i < len(kv):
            j = i
            while j < len(kv) and kv[j] == kv[i]:
                j += 1
            yield kv[i], i, j
            i = j

    def totals(batches):
        """Rows come sorted; a bucket may span batches, so its fold is
        carried and memory does not grow with a tie block."""
        cur, fold = None, None
        for pdf in batches:
            s, y, hh = pdf["__s"].to_numpy(), pdf["__y"].to_numpy().astype(np.int64), pdf["__h"].to_numpy()
            for kv, i, j in runs(pdf):
                if kv != cur:
                    if cur is not None:
                        f = fold.close()
                        yield pd.DataFrame([(*cur, f.num2.tolist(), f.neg.tolist(), f.pos.tolist())], columns=[*key_cols, "A", "NEG", "POS"])
                    cur, fold = kv, _DescendingFold(R, cdf, budget)
                fold.add(s[i:j], y[i:j], hh[i:j], chunk)
        if cur is not None:
            f = fold.close()
            yield pd.DataFrame([(*cur, f.num2.tolist(), f.neg.tolist(), f.pos.tolist())], columns=[*key_cols, "A", "NEG", "POS"])

    par = df.sparkSession.sparkContext.defaultParallelism
    rows = base.select(*gk, "__b", "__h", "__s", "__y")
    part = (rows.repartition(par, *gk, "__b").sortWithinPartitions(*gk, "__b", F.desc("__s"))
            .mapInPandas(totals, f"{key_schema}, __b int, A {vec}, NEG {vec}, POS {vec}"))
    lo_f, hi_f = alpha / 2.0, 1.0 - alpha / 2.0

    def stacked(pdf):
        """Bucket rows of one key, highest first: matrices and the counts
        above each bucket."""
        pdf = pdf.sort_values("__b", ascending=False)
        A, NEG, POS = (np.vstack(pdf[c].to_numpy()).astype(np.int64) for c in ("A", "NEG", "POS"))
        return pdf, A, NEG, POS, np.cumsum(NEG, axis=0) - NEG, np.cumsum(POS, axis=0) - POS

    def interval(pdf, values):
        values = np.sort(values)
        m = len(values)
        out = {k: [pdf[k].iloc[0]] for k in gk}
        out["n_boot_effective"] = [m]
        out["ci_lo"] = [float(values[int(np.floor(lo_f * m))]) if m else None]
        out["ci_hi"] = [float(values[min(int(np.floor(hi_f * m)), m - 1)]) if m else None]
        return pd.DataFrame(out)

    def auc_interval(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, A, NEG, POS, _, pos_above = stacked(pdf)
        num2 = (A + 2 * NEG * pos_above).sum(axis=0)
        Pt, Nt = POS.sum(axis=0), NEG.sum(axis=0)
        ok = (Pt > 0) & (Nt > 0)
        return interval(pdf, num2[ok] / (2.0 * Pt[ok] * Nt[ok]))

    def crossing(pdf: pd.DataFrame) -> pd.DataFrame:
        """The buckets in which some replicate passes the budget (and the
        last one), with what lies above them."""
        pdf, _, NEG, POS, neg_above, pos_above = stacked(pdf)
        Pt, Nt = POS.sum(axis=0), NEG.sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = (neg_above / Nt <= budget) & ((neg_above + NEG) / Nt > budget)
        crosses[-1] = True
        out = [(*(pdf[k].iloc[i] for k in gk), int(pdf["__b"].iloc[i]), pos_above[i].tolist(), neg_above[i].tolist(), Nt.tolist(), Pt.tolist())
               for i in np.flatnonzero(crosses.any(axis=1))]
        return pd.DataFrame(out, columns=[*key_cols, "PA", "NA", "NT", "PT"])

    def recalls(batches):
        """Each bucket begins with its marker row (no score), which holds
        the counts above it."""
        cur, fold, pt, nt = None, None, None, None
        cols = [*key_cols, "BEST", "PT", "NT"]
        for pdf in batches:
            s, y, hh = pdf["__s"].to_numpy(), pdf["__y"].to_numpy(), pdf["__h"].to_numpy()
            for kv, i, j in runs(pdf):
                if kv != cur:
                    if cur is not None:
                        yield pd.DataFrame([(*cur, fold.close().best.tolist(), pt.tolist(), nt.tolist())], columns=cols)
                    pa_, na_, nt, pt = (np.asarray(pdf[c].iloc[i], dtype=np.int64) for c in ("PA", "NA", "NT", "PT"))
                    cur, fold, i = kv, _DescendingFold(R, cdf, budget, (pa_, na_, nt)), i + 1
                if j > i:
                    fold.add(s[i:j], y[i:j].astype(np.int64), hh[i:j].astype(np.int64), chunk)
        if cur is not None:
            yield pd.DataFrame([(*cur, fold.close().best.tolist(), pt.tolist(), nt.tolist())], columns=cols)

    def recall_interval(pdf: pd.DataFrame) -> pd.DataFrame:
        best = np.vstack(pdf["BEST"].to_numpy()).astype(np.int64).max(axis=0)
        Pt, Nt = (np.asarray(pdf[c].iloc[0], dtype=np.int64) for c in ("PT", "NT"))
        ok = (Pt > 0) & (Nt > 0)
        return interval(pdf, best[ok] / Pt[ok])

    ci_schema = f"{key_schema}, n_boot_effective long, ci_lo double, ci_hi double"
    if statistic == "auc":
        dist = part.groupBy(*gk).applyInPandas(auc_interval, ci_schema)
    else:
        marks = cut_lineage(part.groupBy(*gk).applyInPandas(
            crossing, f"{key_schema}, __b int, PA {vec}, NA {vec}, NT {vec}, PT {vec}"))
        again = rows.join(marks.select(*key_cols), key_cols, "left_semi").unionByName(marks, allowMissingColumns=True)
        best = (again.repartition(par, *key_cols).sortWithinPartitions(*key_cols, F.desc_nulls_first("__s"))
                .select(*key_cols, F.coalesce("__h", F.lit(0)).alias("__h"), F.coalesce("__s", F.lit(0.0)).alias("__s"),
                        F.coalesce("__y", F.lit(0)).alias("__y"), "PA", "NA", "NT", "PT")
                .mapInPandas(recalls, f"{key_schema}, __b int, BEST {vec}, PT {vec}, NT {vec}"))
        dist = best.groupBy(*gk).applyInPandas(recall_interval, ci_schema)
    if ks:
        out = point.join(dist, ks, "left")
    else:
        ds = dist.select(F.struct("n_boot_effective", "ci_lo", "ci_hi").alias("s")).scalar()
        out = point.withColumns({"n_boot_effective": ds["n_boot_effective"], "ci_lo": ds["ci_lo"],
                                 "ci_hi": ds["ci_hi"]})
    return _done(out.select(*ks, "point", "ci_lo", "ci_hi", (F.col("n_pos") + F.col("n_neg")).alias("n"),
                            F.coalesce("n_boot_effective", F.lit(0)).alias("n_boot_effective"),
                            F.lit(1.0 - alpha).alias("ci_level")))


def bootstrap_auc(df: DataFrame, id_col: str, score: str, label: str, keys=None, **options) -> DataFrame:
    """:func:`bootstrap` of the AUC."""
    return bootstrap(df, id_col, score, label, keys, "auc", **options)


def bootstrap_recall(df: DataFrame, id_col: str, score: str, label: str, keys=None, **options) -> DataFrame:
    """:func:`bootstrap` of the recall at a false-positive budget."""
    return bootstrap(df, id_col, score, label, keys, "recall_at_fpr", **options)


# --- E10 threshold grid ---------------------------------------------------------

def grid_sweep(df: DataFrame, meta: str, threat: str, symbolic: str, label: str,
               t_med_values=None, t_meta_values=None, high_floor: float = C.SEMANTIC_THRESHOLD_HIGH
               ) -> DataFrame:
    """Confusion at every ``(t_med, t_meta)`` grid point of the rule
    ``symbolic OR meta >= t_meta OR threat >= t_med``.

    Rows are reduced to a histogram over ``(label, symbolic, i, j)`` where
    ``i``/``j`` count the grid values at or below the row's scores, so the
    data is scanned once and the grid is evaluated on at most
    4*(|t_meta|+1)*(|t_med|+1) cells.  A non-symbolic cell is *not* flagged
    exactly at the grid points ``(a, b)`` with ``a >= i`` and ``b >= j``
    (0-based), so each cell is expanded over that rectangle and summed; flagged
    counts are the class totals minus those sums."""
    spark = df.sparkSession
    tmed = t_med_values or C.grid_values(*C.GRID_T_MED)
    tmeta = t_meta_values or C.grid_values(*C.GRID_T_META)
    n_med, n_meta = len(tmed), len(tmeta)
    med_arr = F.array(*[F.lit(float(v)) for v in tmed])
    meta_arr = F.array(*[F.lit(float(v)) for v in tmeta])
    m = F.coalesce(F.col(meta).cast("double"), F.lit(float("-inf")))
    t = F.coalesce(F.col(threat).cast("double"), F.lit(float("-inf")))
    hist = (df.select(
        (F.col(label).cast("int") == 1).alias("y"),
        F.coalesce(F.col(symbolic).cast("boolean"), F.lit(False)).alias("sym"),
        F.size(F.filter(meta_arr, lambda v: v <= m)).alias("i"),
        F.size(F.filter(med_arr, lambda v: v <= t)).alias("j"))
        .groupBy("y", "sym", "i", "j").agg(F.count(F.lit(1)).alias("c")))
    totals = hist.agg(F.struct(
        F.sum(F.when(F.col("y"), F.col("c")).otherwise(0)).cast("long").alias("P"),
        F.sum(F.when(~F.col("y"), F.col("c")).otherwise(0)).cast("long").alias("N")).alias("t")).scalar()
    quiet = (hist.where(~F.col("sym") & (F.col("i") < n_meta) & (F.col("j") < n_med))
             .withColumn("a", F.explode(F.sequence(F.col("i"), F.lit(n_meta - 1))))
             .withColumn("b", F.explode(F.sequence(F.col("j"), F.lit(n_med - 1))))
             .groupBy("a", "b").agg(
                 F.sum(F.when(F.col("y"), F.col("c")).otherwise(0)).cast("long").alias("qp"),
                 F.sum(F.when(~F.col("y"), F.col("c")).otherwise(0)).cast("long").alias("qn")))
    pts = spark.range(0, n_med * n_meta).select(
        F.col("id").cast("int").alias("grid_order"),
        (F.col("id") % n_meta).cast("int").alias("a"), (F.col("id") / n_meta).cast("int").alias("b"))
    pts = pts.withColumn("t_meta", F.element_at(meta_arr, F.col("a") + 1)) \
        .withColumn("t_med", F.element_at(med_arr, F.col("b") + 1))
    g = pts.join(quiet, ["a", "b"], "left").withColumns({"P": totals["P"], "N": totals["N"]})
    qp, qn = F.coalesce("qp", F.lit(0)), F.coalesce("qn", F.lit(0))
    g = g.select("grid_order", "t_med", "t_meta",
                 (F.col("P") - qp).alias("TP"), (F.col("N") - qn).alias("FP"),
                 qn.alias("TN"), qp.alias("FN"))
    return derived_metrics(g).withColumn("t_high", F.greatest(F.col("t_med"), F.lit(high_floor)))


def best_grid_point(grid: DataFrame, budget: float = C.DEFAULT_FPR_BUDGET) -> DataFrame:
    """L4: max (recall, precision) with fpr <= budget, first in grid order on
    ties; no feasible point -> the minimum-fpr point; plus the best-F1 point.
    One aggregate over the grid table, one row per ``kind``."""
    cols = ["grid_order", "t_med", "t_meta", "t_high", "TP", "FP", "TN", "FN",
            "accuracy", "precision", "recall", "f1", "fpr"]
    rec = F.struct(*[F.col(c) for c in cols])
    neg_order = -F.col("grid_order")
    agg = grid.agg(
        F.max_by(F.when(F.col("fpr") <= budget, rec),
                 F.when(F.col("fpr") <= budget, F.struct("recall", "precision", neg_order))).alias("feasible"),
        F.max_by(rec, F.struct(-F.col("fpr"), neg_order)).alias("min_fpr"),
        F.max_by(rec, F.struct("f1", neg_order)).alias("best_f1"))
    chosen = F.when(F.col("feasible").isNotNull(), F.col("feasible")).otherwise(F.col("min_fpr"))
    kind = F.when(F.col("feasible").isNotNull(), F.lit("max_recall_within_budget")).otherwise(F.lit("min_fpr"))
    a = agg.select(kind.alias("kind"), chosen.alias("p"))
    b = agg.select(F.lit("best_f1").alias("kind"), F.col("best_f1").alias("p"))
    return a.unionByName(b).select("kind", *[F.col(f"p.{c}").alias(c) for c in cols])


# --- E18 union-FPR budget ---------------------------------------------------------

def union_fpr_budget(df: DataFrame, class_scores: list[str], label: str, id_col: str,
                     budget: float = C.DEFAULT_FPR_BUDGET) -> DataFrame:
    """E18 in closed form (replaces a bisection over the shared budget).

    With ``thr_c(alpha) = neg_desc_c[int(n*alpha)]`` a benign row is flagged by
    class c iff ``g_c = #{negatives with score_c > s_c} <= k`` where
    ``k = int(n*alpha)``.  The union FPR at k is ``#{m <= k}/n`` with
    ``m = min_c g_c``; it only grows with k, so the answer is the largest
    ``k <= int(n*budget)`` before the first ``m`` whose running count exceeds
    the budget (at least 0).  Returns ``k``, ``alpha = k/n``, the union FPR
    there and each class threshold ``thr_<class>``.

    The class scores are unpivoted into one long table so a single keyed
    score table serves every class; the handful of global numbers are
    scalar subqueries (no joins with one-row tables)."""
    spark = df.sparkSession
    negs = df.where(F.col(label).cast("int") == 0)
    stack = ", ".join(f"'{c}', `{c}`" for c in class_scores)
    long = negs.selectExpr(f"`{id_col}` AS __id",
                           f"stack({len(class_scores)}, {stack}) AS (cls, s)").withColumn("y", F.lit(0))
    t = roc.score_table(long, "s", "y", ["cls"])
    # two stage outputs read by several subqueries below: write each once
    g = cut_lineage(t.select("cls", F.col("score").alias("s"),
                             (F.col("N") - F.col("neg_lt") - F.col("neg")).alias("g"), "neg", "N"))
    m = long.join(g.select("cls", "s", "g"), ["cls", "s"]).groupBy("__id").agg(F.min("g").alias("m"))
    hist = m.groupBy("m").agg(F.count(F.lit(1)).alias("c")).withColumn(ALL, F.lit(0))
    cum = cut_lineage(roc.prefix_before(hist, [ALL], "m", ["c"]).withColumn("upto", F.col("c_lt") + F.col("c")))
    over = F.col("upto") > F.lit(budget) * F.col("c_total")
    summ = cum.agg(F.struct(F.max("c_total").alias("n"), F.min(F.when(over, F.col("m"))).alias("m_over"))
                   .alias("s")).scalar()
    n = summ["n"]
    kmax = F.floor(n * F.lit(budget)).cast("long")
    k = F.greatest(F.when(summ["m_over"].isNull(), kmax).otherwise(F.least(kmax, summ["m_over"] - 1)), F.lit(0))
    flagged = cum.where(F.col("m") <= k).agg(F.coalesce(F.max("upto"), F.lit(0))).scalar()
    kk = F.when(k < F.col("N"), k).otherwise(F.col("N") - 1)
    hit = (F.col("neg") > 0) & (F.col("g") <= kk) & (kk < F.col("g") + F.col("neg"))
    thr = {c: g.where((F.col("cls") == c) & hit).agg(F.max("s")).scalar() for c in class_scores}
    return spark.range(1).select(k.alias("k"), n.alias("n_neg"), F.try_divide(k, n).alias("alpha"),
                                 F.try_divide(flagged, n).alias("union_fpr"),
                                 *[thr[c].alias(f"thr_{c}") for c in class_scores])


# --- E11/E12 hash splits ------------------------------------------------------------

def holdout_split(df: DataFrame, id_col: str, test_fraction: float = 0.3, seed: int = 42) -> DataFrame:
    """``split`` column 'train'/'test' from md5(id:seed) — stable under
    re-partitioning and recomputation."""
    u = hash_uniform(F.col(id_col), F.lit(seed))
    return df.withColumn("split", F.when(u < test_fraction, "test").otherwise("train"))


def kfold(df: DataFrame, id_col: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Fold id in [0,k) from the hash order inside each label stratum.
    The rank inside a stratum is taken from a bucketed prefix count, so a
    large stratum is never sorted in one task."""
    u = hash_uniform(F.col(id_col), F.lit(seed))
    base = df.withColumn("__u", u).withColumn("__y", F.col(label).cast("int"))
    g = cut_lineage(base.groupBy("__y", "__u").agg(F.count(F.lit(1)).alias("__c")))
    pre = roc.prefix_before(g, ["__y"], "__u", ["__c"]).select("__y", "__u", "__c_lt")
    ranked = base.join(pre, ["__y", "__u"], "inner")
    return ranked.withColumn("fold", (F.col("__c_lt") % k).cast("int")).drop("__y", "__u", "__c_lt")
