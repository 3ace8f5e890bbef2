"""Paired statistics. Counts and means are SQL; resampling keeps NumPy's generators, one group per task.

All differences are treatment minus reference.
"""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import written


def bootstrap_vector(reference: np.ndarray, treatment: np.ndarray, iterations: int = 10_000, seed: int = 2027, level: float = 0.95) -> dict:
    """Percentile interval and two-sided p of the mean paired difference; no interval for fewer than two pairs."""
    d = np.asarray(treatment, float) - np.asarray(reference, float)
    out: dict = {"n": len(d), "mean_difference": float(d.mean()) if len(d) else None, "ci_low": None, "ci_high": None, "p_value": None}
    if len(d) >= 2:
        means = d[np.random.default_rng(seed).integers(0, len(d), size=(iterations, len(d)))].mean(axis=1)
        tail = 100 * (1 - level) / 2
        out |= {"ci_low": float(np.percentile(means, tail)), "ci_high": float(np.percentile(means, 100 - tail)), "p_value": min(1.0, 2 * min(float((means <= 0).mean()), float((means >= 0).mean())))}
    return out


_BOOT = "{keys}, n long, mean_difference double, ci_low double, ci_high double, p_value double"


def paired_bootstrap(pairs: DataFrame, keys: list[str], iterations: int = 2000, seed: int = 2027) -> DataFrame:
    """Bootstrap of (reference, treatment) within each group, pairs in order of ``question_id``."""

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("question_id")
        return pd.DataFrame([dict(zip(keys, key)) | bootstrap_vector(g["reference"].to_numpy(), g["treatment"].to_numpy(), iterations, seed)])

    schema = _BOOT.format(keys=", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys))
    return pairs.groupBy(*keys).applyInPandas(one, schema)


def derived_seed(seed: int, *parts: str) -> int:
    return int.from_bytes(hashlib.sha256(":".join([str(seed), *parts]).encode()).digest()[:8], "big")


def sign_flip(pairs: DataFrame, keys: list[str], iterations: int = 2000, seed: int = 2027) -> DataFrame:
    """Sign-flip permutation p of the mean difference: (hits + 1) / (iterations + 1)."""

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        d = (g.sort_values("question_id")["treatment"] - g.sort_values("question_id")["reference"]).to_numpy(float)
        rng = np.random.default_rng(derived_seed(seed, *map(str, key)))
        flips = rng.choice([-1.0, 1.0], size=(iterations, len(d)))
        hits = int((np.abs((flips * d).mean(axis=1)) >= abs(d.mean()) - 1e-12).sum())
        return pd.DataFrame([dict(zip(keys, key)) | {"n": len(d), "estimate": float(d.mean()), "p_value": (hits + 1) / (iterations + 1)}])

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", n long, estimate double, p_value double"
    return pairs.groupBy(*keys).applyInPandas(one, schema)


def cluster_bootstrap(pairs: DataFrame, keys: list[str], cluster: str, iterations: int = 2000, seed: int = 2027) -> DataFrame:
    """Bootstrap over whole clusters; clusters shrink to (sum, count) before a group meets in one task."""
    sums = pairs.groupBy(*keys, cluster).agg(F.sum(F.col("treatment") - F.col("reference")).alias("d"), F.count("*").alias("n"))

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(cluster)
        d, n = g["d"].to_numpy(float), g["n"].to_numpy(float)
        pick = np.random.default_rng(seed).integers(0, len(d), size=(iterations, len(d)))
        means = d[pick].sum(axis=1) / n[pick].sum(axis=1)
        lo, hi = (float(np.percentile(means, q)) for q in (2.5, 97.5)) if len(d) > 1 else (None, None)
        return pd.DataFrame([dict(zip(keys, key)) | {"clusters": len(d), "mean_difference": float(d.sum() / n.sum()), "ci_low": lo, "ci_high": hi}])

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", clusters long, mean_difference double, ci_low double, ci_high double"
    return sums.groupBy(*keys).applyInPandas(one, schema)


def holm(df: DataFrame, p: str = "p_value", family: list[str] | None = None) -> DataFrame:
    """Step-down adjusted p within each family; null p stay null and do not count."""
    by = Window.partitionBy(*(family or []))
    known = F.col(p).isNotNull()
    rank = F.row_number().over(by.orderBy(F.col(p).asc_nulls_last()))
    out = df.withColumns({"__m": F.count(p).over(by), "__r": rank})
    step = F.least(F.col(p) * (F.col("__m") - F.col("__r") + 1), F.lit(1.0))
    running = F.max(F.when(known, step)).over(by.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("p_holm", F.when(known, running)).drop("__m", "__r")


def paired_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and median difference, wins, ties, losses, Cliff's delta of the pairs, Cohen's d."""
    d = F.col("treatment") - F.col("reference")
    near = F.abs(d) <= 1e-9
    out = pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(d).alias("treatment_minus_reference"), F.median(d).alias("median_difference"),
        F.count_if((d > 0) & ~near).alias("wins"), F.count_if(near).alias("ties"), F.count_if((d < 0) & ~near).alias("losses"), F.stddev_samp(d).alias("__sd"),
    )
    return out.withColumns({"paired_delta": (F.col("wins") - F.col("losses")) / F.col("n"), "cohens_d": effect_size(F.col("treatment_minus_reference"), F.coalesce("__sd", F.lit(0.0)))}).drop("__sd")


def effect_size(mean: Column, sd: Column) -> Column:
    """Mean over deviation; without spread: 0, or infinite with the mean's sign."""
    inf = F.lit(float("inf"))
    return F.when(sd > 1e-15, mean / sd).when(F.abs(mean) < 1e-15, 0.0).when(mean > 0, inf).otherwise(-inf)


def mcnemar_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Discordant pairs of 0/1 scores: b only the treatment is right, c only the reference; chi-square with continuity."""
    t, r = F.col("treatment") >= 0.5, F.col("reference") >= 0.5
    out = pairs.groupBy(*keys).agg(F.count_if(t & ~r).alias("b"), F.count_if(~t & r).alias("c"), F.count("*").alias("n"))
    diff = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    return out.withColumn("discordant", F.col("b") + F.col("c")).withColumn("chi_square", F.coalesce(F.try_divide((diff * diff).cast("double"), F.col("discordant").cast("double")), F.lit(0.0)))


def mcnemar_exact(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, b, c, p_exact, p_mid): two-sided binomial p of the discordant pairs; 1 without any.

    The tail is summed from its logarithms, one step for each of the min(b, c) + 1 terms.
    """
    counts = mcnemar_counts(pairs, keys).select(*keys, "b", "c")
    n, m = F.col("b") + F.col("c"), F.least("b", "c")
    start = F.struct((-n * math.log(2)).cast("double").alias("log"), F.exp(-n * math.log(2)).alias("tail"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log(n - i + 1.0) - F.log(i.cast("double"))
        return F.struct(log.alias("log"), (acc["tail"] + F.exp(log)).alias("tail"))

    terms = F.when(m > 0, F.sequence(F.lit(1).cast("long"), m)).otherwise(F.array().cast("array<bigint>"))
    out = counts.withColumn("__x", F.aggregate(terms, start, step))
    exact, last = F.least(F.lit(1.0), 2 * F.col("__x.tail")), F.exp("__x.log")
    return out.select(*keys, "b", "c", F.when(n == 0, 1.0).otherwise(exact).alias("p_exact"), F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.col("__x.tail") - last)).alias("p_mid"))


def mcnemar_p(b: int, c: int, two_sided: bool = True) -> dict[str, float]:
    """Exact binomial and mid-p values of b against c discordant pairs (one-sided: b is not larger by chance)."""
    n = b + c
    if n == 0:
        return {"p_exact": 1.0, "p_mid": 1.0}
    weight = [math.comb(n, i) for i in range(n + 1)]
    total = 2**n
    if two_sided:
        tail = sum(weight[: min(b, c) + 1]) / total
        return {"p_exact": min(1.0, 2 * tail), "p_mid": min(1.0, 2 * tail - weight[min(b, c)] / total)}
    tail = sum(weight[b:]) / total
    return {"p_exact": tail, "p_mid": tail - 0.5 * weight[b] / total}


def factorial(rows: DataFrame, cells: list[str], question: str = "question_id") -> DataFrame:
    """2x3 design: cells are (low, mid, high) of factor A off, then on. Contrasts per question, then means.

    Only questions with all six cells count.
    """
    wide = rows.groupBy("dataset", question).pivot("method", cells).agg(F.avg("score")).na.drop()
    a0, a1, a2, b0, b1, b2 = (F.col(f"`{c}`") for c in cells)
    contrasts = {
        "main_a": ((b0 + b1 + b2) - (a0 + a1 + a2)) / 3,
        "mid_over_low": ((a1 - a0) + (b1 - b0)) / 2,
        "high_over_low": ((a2 - a0) + (b2 - b0)) / 2,
        "interaction_mid": (b1 - b0) - (a1 - a0),
        "interaction_high": (b2 - b0) - (a2 - a0),
    }
    return wide.select("dataset", question, *[c.alias(n) for n, c in contrasts.items()])


def change_class(reference: Column, treatment: Column, em_reference: Column, em_treatment: Column) -> Column:
    """How a pair changed: exact gain or loss first, then overlap gain or loss, else unchanged."""
    return (
        F.when(em_treatment > em_reference, "exact_gain").when(em_treatment < em_reference, "exact_loss")
        .when(treatment > reference, "overlap_gain").when(treatment < reference, "overlap_loss").otherwise("unchanged")
    )


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution by bisection, good to machine precision."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if normal_cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def mcnemar_power(n: int, p10: float, p01: float, alpha: float = 0.05, two_sided: bool = True) -> float:
    """Power of McNemar's test by the normal approximation."""
    psi, delta = p10 + p01, abs(p10 - p01)
    if psi <= 0 or n <= 0:
        return 0.0
    z = normal_quantile(1 - alpha / (2 if two_sided else 1))
    spread = math.sqrt(max(psi - delta * delta, 1e-300))
    return normal_cdf((delta * math.sqrt(n) - z * math.sqrt(psi)) / spread)


def required_n(p10: float, p01: float, power: float = 0.8, alpha: float = 0.05, most: int = 10_000_000) -> int | None:
    if mcnemar_power(most, p10, p01, alpha) < power:
        return None
    lo, hi = 1, most
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if mcnemar_power(mid, p10, p01, alpha) >= power else (mid + 1, hi)
    return lo


def detectable_effect(n: int, discordant: float, power: float = 0.8, alpha: float = 0.05) -> float:
    """The least difference p10 - p01 that the test finds with that power at a given discordant share."""
    lo, hi = 0.0, discordant
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if mcnemar_power(n, (discordant + mid) / 2, (discordant - mid) / 2, alpha) >= power else (mid, hi)
    return hi


def monte_carlo_power(spark, n: int, p10: float, p01: float, alpha: float = 0.05, trials: int = 20_000, seed: int = 7, parts: int = 16) -> DataFrame:
    """Simulated power: trials are dealt over tasks, each with a generator of its own; one row (trials, power)."""
    cut = (normal_quantile(1 - alpha / 2)) ** 2

    def run(batches):
        for part in batches:
            for k in part["id"]:
                rng = np.random.default_rng([seed, int(k)])
                size = trials // parts + (int(k) < trials % parts)
                draw = rng.multinomial(n, [p10, p01, 1 - p10 - p01], size=size)
                b, c = draw[:, 0], draw[:, 1]
                chi = np.maximum(np.abs(b - c) - 1, 0) ** 2 / np.maximum(b + c, 1)
                yield pd.DataFrame({"trials": [size], "hits": [int((chi > cut).sum())]})

    done = spark.range(0, parts, 1, parts).mapInPandas(run, "trials long, hits long")
    return done.agg(F.sum("trials").alias("trials"), (F.sum("hits") / F.sum("trials")).alias("power"))


def sums_before(sizes: DataFrame, keys: list[str], order: str, amount: str) -> DataFrame:
    """Append ``before``: the sum of ``amount`` over smaller values of ``order`` in each key, without a window over a whole key.

    Rows (unique in keys and order) are dealt to ranges and written once; sums by (key, range) are added up over the ranges, then inside each range.
    """
    ranged = written(sizes.repartitionByRange(*keys, order).withColumn("__r", F.spark_partition_id()), "ranks")
    parts = ranged.groupBy(*keys, "__r").agg(F.sum(amount).alias("__s"))
    earlier = F.coalesce(F.sum("__s").over(Window.partitionBy(*keys).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy("__r", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__in", inside).join(parts.withColumn("__b", earlier).drop("__s"), ["__r", *keys]).withColumn("before", F.col("__b") + F.col("__in")).drop("__r", "__in", "__b")


def wilcoxon(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-rank sums of nonzero differences (average ranks for ties) and the normal two-sided p."""
    d = pairs.withColumn("d", F.col("treatment") - F.col("reference")).filter("d <> 0")
    sizes = sums_before(d.groupBy(*keys, F.abs("d").alias("m")).agg(F.count("*").alias("t"), F.count_if(F.col("d") > 0).alias("up")), keys, "m", "t")
    before = F.col("before")
    ranked = sizes.withColumn("r", before + (F.col("t") + 1) / 2.0)
    out = ranked.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("r")).alias("w_plus"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    var = F.col("n") * (F.col("n") + 1) * (2 * F.col("n") + 1) / 24.0 - F.col("ties") / 48.0
    z = (F.col("w_plus") - F.col("n") * (F.col("n") + 1) / 4.0) / F.sqrt(var)
    cdf = F.pandas_udf(lambda s: s.map(lambda x: math.erfc(abs(x) / math.sqrt(2)) if x == x else None), "double")
    return out.withColumn("z", z).withColumn("p_value", cdf("z")).drop("ties")


def permutation_interaction(deep: np.ndarray, shallow: np.ndarray, permutations: int = 10_000, seed: int = 2027) -> dict | None:
    """One-sided permutation p of mean(deep) - mean(shallow) at fixed group sizes; null for fewer than five in a group.

    The legacy generator is asked once for each permutation, so that a seed gives the same p as elsewhere.
    """
    a, b = np.asarray(deep, float), np.asarray(shallow, float)
    if min(len(a), len(b)) < 5:
        return None
    rng, both = np.random.RandomState(seed), np.concatenate([a, b])
    seen, reached = a.mean() - b.mean(), 0
    for _ in range(permutations):
        dealt = rng.permutation(both)
        reached += dealt[: len(a)].mean() - dealt[len(a) :].mean() >= seen
    return {"observed_difference": float(seen), "deep_n": len(a), "shallow_n": len(b), "deep_mean": float(a.mean()), "shallow_mean": float(b.mean()), "p_value": float(reached / permutations)}


def loss_delta_interval(deltas: list[float], iterations: int = 2000, seed: int = 2027) -> dict:
    """Mean of paired squared-error differences, with a 95 % interval from order statistics of resampled means."""
    if not deltas or iterations < 100:
        raise ValueError("at least one difference and 100 iterations are needed")
    draw, n = random.Random(seed), len(deltas)
    means = sorted(math.fsum(deltas[draw.randrange(n)] for _ in range(n)) / n for _ in range(iterations))
    low, high = math.floor(0.025 * (iterations - 1)), math.ceil(0.975 * (iterations - 1))
    return {"mean": math.fsum(deltas) / n, "ci_low": means[low], "ci_high": means[high], "n": n}
