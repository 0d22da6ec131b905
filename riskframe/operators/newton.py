"""Many small L2 logistic regressions fitted together.

A row may belong to several groups (training parts of folds, feature sets,
classes), with its own label in each.  Every round is one aggregate: rows
are exploded to their groups, joined with the groups' current coefficients
(a few numbers each, the number of groups is checked), and the loss, the
gradient and the Hessian are summed by group with map-side partial sums.
The driver solves one small system per group and halves the step of a group
whose loss rose; groups that are done leave the next round's table.

The objective is ``1/2 |w|^2 + C * sum(loss)`` over features standardised
with the group's own mean and population deviation; the intercept is free.
"""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.cascade import sigmoid
from riskframe.session import cut_lineage

MAX_GROUPS = 10_000
ROUNDS = 15
TOLERANCE = 1e-9

MEMBER = "array<struct<g:int,y:int>>"


@dataclass
class Fit:
    """One fitted group.  ``gradient`` is the largest component of the
    penalised gradient at the coefficients."""
    n: int
    n_pos: int
    mean: np.ndarray
    scale: np.ndarray
    used: np.ndarray
    theta: np.ndarray = field(default_factory=lambda: np.zeros(0))   # intercept first
    gradient: float = float("inf")
    rounds: int = 0
    loss: float = float("inf")
    trial: np.ndarray = field(default_factory=lambda: np.zeros(0))
    step: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @property
    def inverse(self) -> np.ndarray:
        live = self.used & (self.scale > 0)
        return np.where(live, 1.0 / np.where(live, self.scale, 1.0), 0.0)

    def policy(self) -> dict:
        return {"scaler_mean": self.mean.tolist(), "scaler_scale": self.scale.tolist(),
                "coefficients": self.theta[1:].tolist(), "intercept": float(self.theta[0])}


def member(g, y) -> Column:
    return F.struct(F.lit(g).cast("int").alias("g"), F.col(y).cast("int").alias("y") if isinstance(y, str) else y.cast("int").alias("y"))


def params_frame(spark, fits: dict[int, Fit], trial: bool = False) -> DataFrame:
    """The groups' coefficients as an inline table to broadcast."""
    array = lambda v: "array(" + ", ".join(f"double('{float(x)!r}')" for x in v) + ")"
    rows = [f"({g}, {array(f.mean)}, {array(f.inverse)}, {array(t[1:])}, double('{float(t[0])!r}'))"
            for g, f in fits.items() for t in [f.trial if trial else f.theta]]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(__g, __mean, __inv, __w, __b)")


def z_score(i: int) -> str:
    return f"(__x{i} - __mean[{i}]) * __inv[{i}]"


def linear(d: int) -> str:
    """The linear score of a row joined with :func:`params_frame`."""
    return " + ".join(["__b", *[f"__w[{i}] * ({z_score(i)})" for i in range(d)]])


def inputs(features: list[str]) -> list[Column]:
    return [F.col(f).cast("double").alias(f"__x{i}") for i, f in enumerate(features)]


def exploded(df: DataFrame, keep: list) -> DataFrame:
    """A row per member: its group and its label there."""
    return df.select(*keep, F.explode("__ms").alias("__m")).select(*keep, F.col("__m.g").alias("__g"), F.col("__m.y").alias("__y"))


def member_scores(rows: DataFrame, fits: dict[int, Fit], features: list[str], members: Column, keep: list) -> DataFrame:
    """``keep`` columns, ``__g``, ``__y`` and the probability ``score`` of
    each row in each of its ``members`` that was fitted."""
    d = len(features)
    x = exploded(rows.select(*keep, *inputs(features), members.cast(MEMBER).alias("__ms")), [*keep, *[f"__x{i}" for i in range(d)]])
    x = x.join(F.broadcast(params_frame(rows.sparkSession, fits)), "__g")
    return x.select(*keep, "__g", "__y", sigmoid(F.expr(linear(d))).alias("score"))


def _round(x: DataFrame, fits: dict[int, Fit], d: int) -> dict[int, dict]:
    """Sums of loss, gradient and Hessian by group at the trial points."""
    x = x.join(F.broadcast(params_frame(x.sparkSession, fits, trial=True)), "__g")
    zs = [f"z{i}" for i in range(1, d + 1)]
    x = x.selectExpr("__g", "__y", f"{linear(d)} AS eta", *[f"{z_score(i)} AS z{i + 1}" for i in range(d)])
    x = x.selectExpr("__g", "1D AS z0", *zs, "1 / (1 + exp(-eta)) AS p", "__y AS y",
                     "log1p(exp(-abs(eta))) + greatest(eta, 0D) - __y * eta AS loss")
    x = x.selectExpr("__g", "z0", *zs, "p - y AS off", "p * (1 - p) AS v", "loss")
    sums = [F.expr("sum(loss) AS loss"), *[F.expr(f"sum(off * z{i}) AS g{i}") for i in range(d + 1)],
            *[F.expr(f"sum(v * z{i} * z{j}) AS h{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]]
    return {r["__g"]: r.asDict() for r in x.groupBy("__g").agg(*sums).collect()}


def fit_groups(rows: DataFrame, features: list[str], members: Column, drop: dict[int, list[str]] | None = None, C: float = 1.0,
               rounds: int = ROUNDS) -> dict[int, Fit]:
    """Fits every group of ``members`` (an array of :func:`member`).  ``drop``
    names the features a group leaves out.  A group needs both labels;
    one without is not fitted and is absent from the result."""
    d = len(features)
    xs = [f"__x{i}" for i in range(d)]
    # internal names (two underscores) cannot clash with features
    x = exploded(cut_lineage(rows.select(*inputs(features), members.cast(MEMBER).alias("__ms"))), xs)
    stats = (x.groupBy(F.col("__g").alias("g")).agg(F.count("*").alias("n"), F.sum("__y").alias("n_pos"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(xs)],
                                                    *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(xs)]).limit(MAX_GROUPS + 1).collect())
    if len(stats) > MAX_GROUPS:
        raise OverflowError(f"more than {MAX_GROUPS} groups")
    fits = {}
    for r in sorted(stats, key=lambda r: r["g"]):
        if 0 < r["n_pos"] < r["n"]:
            used = np.array([f not in (drop or {}).get(r["g"], []) for f in features], bool)
            fits[r["g"]] = Fit(r["n"], r["n_pos"], np.array([r[f"m{i}"] for i in range(d)], float), np.array([r[f"s{i}"] or 0.0 for i in range(d)], float),
                               used, trial=np.zeros(d + 1))
    live = dict(fits)
    penalty = np.diag([0.0, *[1.0 / C] * d])
    for _ in range(rounds):
        if not live:
            break
        sums = _round(x, live, d)
        for g, f in list(live.items()):
            s = sums[g]
            f.rounds += 1
            loss = s["loss"] + 0.5 * float(f.trial @ penalty @ f.trial)
            if loss > f.loss + 1e-12 * abs(f.loss):
                f.step = f.step / 2
                f.trial = f.theta + f.step
                continue
            grad = np.array([s[f"g{i}"] for i in range(d + 1)]) + penalty @ f.trial
            hess = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) + penalty
            f.loss, f.theta, f.gradient = loss, f.trial, float(np.abs(grad).max())
            if f.gradient <= TOLERANCE * max(1.0, f.n ** 0.5):
                del live[g]
                continue
            f.step = -np.linalg.solve(hess, grad)
            f.trial = f.theta + f.step
    return fits
