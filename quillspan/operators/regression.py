"""Least squares with cluster-robust errors, and logistic calibration, from sums that Spark adds up.

Both passes of the regression and every Newton step of the calibration are one aggregation over all rows. The driver
gets k x k numbers, k the number of columns, and solves for k unknowns; rows and clusters stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .policy import Calibrator


def cluster_ols(rows: DataFrame, y: str, xs: list[str], cluster: str) -> DataFrame:
    """(term, coef, se, n, clusters, r_squared) of y on an intercept and ``xs``; errors by the sandwich over clusters.

    The meat is scaled by N / (N - k) * G / (G - 1), 1 where undefined. Rows with a null anywhere are left out; dependent
    columns get the solution of least norm. Without rows there are no terms.
    """
    names = ["intercept", *xs]
    data = rows.select(F.col(cluster).alias("g"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("x0"), *[F.col(x).cast("double").alias(f"x{i}") for i, x in enumerate(xs, 1)]).na.drop()
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    first = data.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("yy"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"a{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"b{i}") for i in range(k)]).first()
    if not first.n:
        return rows.sparkSession.createDataFrame([], _OLS)
    gram = np.empty((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = first[f"a{i}_{j}"]
    bread = np.linalg.pinv(gram, hermitian=True)
    beta = bread @ np.array([first[f"b{i}"] for i in range(k)])
    e = F.col("y") - sum((float(beta[i]) * F.col(f"x{i}") for i in range(k)), F.lit(0.0))
    each = data.withColumn("e", e).groupBy("g").agg(*[F.sum(F.col(f"x{i}") * F.col("e")).alias(f"s{i}") for i in range(k)], F.sum(F.col("e") * F.col("e")).alias("ee"))
    second = each.agg(F.count("*").alias("groups"), F.sum("ee").alias("ee"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    meat = np.empty((k, k))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = second[f"m{i}_{j}"]
    n, groups = first.n, second.groups
    meat *= (n / (n - k) if n > k else 1.0) * (groups / (groups - 1) if groups > 1 else 1.0)
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0))
    spread = first.yy - first.sy**2 / n
    fit = float(1 - second.ee / spread) if spread > 0 else None
    return rows.sparkSession.createDataFrame([(names[i], float(beta[i]), float(se[i]), n, groups, fit) for i in range(k)], _OLS)


_OLS = "term string, coef double, se double, n long, clusters long, r_squared double"


def _newton_sums(names: list[str], means: list[float], scales: list[float], theta: np.ndarray):
    """Gradient and Hessian of the log loss, added up by task; the intercept stands last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(names) + 1
        grad, hess = np.zeros(k), np.zeros((k, k))
        for b in batches:
            x = np.column_stack([b[n].to_numpy(zero_copy_only=False) for n in names] + [np.ones(len(b))])
            x[:, :-1] = (x[:, :-1] - means) / scales
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
            grad += x.T @ (p - b["__y"].to_numpy(zero_copy_only=False))
            hess += (x * (p * (1 - p))[:, None]).T @ x
        values = np.concatenate((grad, hess.ravel()))
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(values), dtype=np.int32)), "v": pa.array(values)})

    return run


def fit_calibrator(examples: DataFrame, names: list[str], label: str, l2: float = 1e-3, steps: int = 25, tolerance: float = 1e-9) -> Calibrator:
    """Logistic calibrator of all rows: standardised features, ridge ``l2`` on the weights, Newton's method.

    Null features count as 0, rows without a label are left out. The sufficient threshold is the one of 0.05, 0.10, ... 0.95 with the best F1 (ties:
    nearest to a half), counted by score bucket; the partial one is 0.7 of it, within 0.05 and 0.49.
    """
    data = examples.filter(F.col(label).isNotNull()).select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names], F.col(label).cast("double").alias("__y"))
    first = data.agg(F.count("*").alias("n"), F.avg("__y").alias("y"), *[F.avg(n).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(n).alias(f"s{i}") for i, n in enumerate(names)]).first()
    if not first.n:
        raise ValueError("at least one labelled example is needed")
    means = [first[f"m{i}"] for i in range(len(names))]
    scales = [s if (s := first[f"s{i}"]) >= 1e-9 else 1.0 for i in range(len(names))]
    share = min(max(first.y, 1e-4), 1 - 1e-4)
    theta = np.zeros(len(names) + 1)
    theta[-1] = np.log(share / (1 - share))
    ridge = np.full(len(theta), l2)
    ridge[-1] = 0.0
    k = len(theta)
    for _ in range(steps):
        parts = data.mapInArrow(_newton_sums(names, means, scales, theta), "i int, v double")
        values = np.zeros(k + k * k)
        for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():  # k + k * k numbers
            values[r.i] = r.v
        grad, hess = values[:k] / first.n + ridge * theta, values[k:].reshape(k, k) / first.n + np.diag(ridge)
        step = np.linalg.pinv(hess, hermitian=True) @ grad
        theta = theta - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < tolerance:
            break
    fitted = Calibrator(names, means, scales, theta[:-1].tolist(), float(theta[-1]))
    best = best_threshold(data.select(fitted.probability().alias("p"), "__y"), "p", "__y")
    return Calibrator(names, means, scales, theta[:-1].tolist(), float(theta[-1]), best, min(best, max(0.05, min(0.49, best * 0.7))))


def best_threshold(scored: DataFrame, p: str, label: str, grid: int = 20) -> float:
    """The threshold i / grid with the best F1, from counts by score bucket; ties go to the one nearest to a half."""
    bucket = sum(((F.col(p) >= i / grid).cast("int") for i in range(1, grid)), F.lit(0))
    pos, neg = np.zeros(grid, dtype=np.int64), np.zeros(grid, dtype=np.int64)
    for r in scored.groupBy(bucket.alias("b")).agg(F.count_if(F.col(label) > 0).alias("pos"), F.count_if(F.col(label) <= 0).alias("neg")).collect():
        pos[r.b], neg[r.b] = r.pos, r.neg
    tp, fp = pos[::-1].cumsum()[::-1], neg[::-1].cumsum()[::-1]
    f1 = lambda i: 2 * tp[i] / max(1, tp[i] + fp[i] + pos.sum())
    return max(range(1, grid), key=lambda i: (round(f1(i), 12), -abs(i / grid - 0.5))) / grid


def split_by_order(examples: DataFrame, key: str, fraction: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(train, calibration): the last ``round(n * fraction)`` examples in order of ``key``, one at least, calibrate.

    The boundary comes from a range partitioning: counts by range, then an order inside the one range that holds it.
    """
    if not 0 < fraction < 1:
        raise ValueError("the fraction must lie between 0 and 1")
    from ..sources.records import dense_positions

    placed = dense_positions(examples, [key])
    n = placed.count()
    cut = n - max(1, min(n - 1, round(n * fraction)))
    return placed.filter(F.col("pos") < cut).drop("pos"), placed.filter(F.col("pos") >= cut).drop("pos")
