"""Resampling as sums: every draw's weight of a unit is a function of (unit, draw), so resamples merge.

A draw of the bootstrap gives each unit a Poisson(1) count, a sign flip a sign, a permutation a label, all from 32 bits
of md5(unit ':' block). Tasks add up their rows by (group, draw) and only these sums are shuffled: a group of any size never meets
in one task, a lost task is computed again with the same counts, and parts of a corpus can be added later.
All differences are treatment minus reference.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V

WORD = 1 << 32
#: 2^32 times the distribution function of Poisson(1), until it is 1 in 32 bits
POISSON = [math.floor(WORD * sum(math.exp(-1) / math.factorial(j) for j in range(i + 1))) for i in range(12)]


def with_draws(rows: DataFrame, unit: Column, draws: int) -> DataFrame:
    """Each row once for every draw, with ``draw`` from 0 and 32 random bits ``u``."""
    block = rows.withColumns({"__unit": unit.cast("string"), "__block": F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4)))})
    digest = F.md5(F.concat_ws(":", "__unit", "__block").cast("binary"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.conv(F.substring(F.col("__md5"), i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    each = block.withColumn("__md5", digest).select(*rows.columns, "__block", F.posexplode(bits).alias("__i", "u"))
    return each.withColumn("draw", F.col("__block") * 4 + F.col("__i")).filter(F.col("draw") < draws).drop("__block", "__i")


def poisson_count(u: Column) -> Column:
    return sum(((u >= t).cast("int") for t in POISSON), F.lit(0))


def _interval(draws: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    tail = (1 - level) / 2
    v = F.col(value)
    below, above = F.avg((v <= 0).cast("double")), F.avg((v >= 0).cast("double"))
    return draws.groupBy(*keys).agg(F.percentile(v, F.lit(tail)).alias("ci_low"), F.percentile(v, F.lit(1 - tail)).alias("ci_high"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"))


def poisson_bootstrap(pairs: DataFrame, keys: list[str], unit: Column, draws: int = 2000, level: float = 0.95) -> DataFrame:
    """(keys, n, mean_difference, ci_low, ci_high, p_value): percentile interval of the mean of treatment - reference.

    ``pairs`` has (keys, reference, treatment); rows of one ``unit`` (a pair, or a cluster of them) are drawn together.
    Draws that took no unit of a group do not count; groups of one row have no interval.
    """
    d = F.col("treatment") - F.col("reference")
    slim = pairs.select(*keys, d.cast("double").alias("__d"), unit.cast("string").alias("__u"))
    by_unit = slim.groupBy(*keys, "__u").agg(F.sum("__d").alias("__d"), F.count("*").alias("__n"))
    drawn = with_draws(by_unit, F.col("__u"), draws).withColumn("__c", poisson_count(F.col("u"))).filter("__c > 0")
    means = drawn.groupBy(*keys, "draw").agg((F.sum(F.col("__c") * F.col("__d")) / F.sum(F.col("__c") * F.col("__n"))).alias("__mean"))
    total = by_unit.groupBy(*keys).agg(F.sum("__n").alias("n"), F.count("*").alias("units"), (V.exact_sum(F.col("__d")) / F.sum("__n")).alias("mean_difference"))
    found = total.join(_interval(means, keys, "__mean", level), keys, "left") if keys else total.crossJoin(_interval(means, keys, "__mean", level))
    alone = lambda c: F.when(F.col("units") > 1, F.col(c)).alias(c)
    return found.select(*keys, "n", "units", "mean_difference", alone("ci_low"), alone("ci_high"), alone("p_value"))


def flip_signs(pairs: DataFrame, keys: list[str], unit: Column, draws: int = 2000) -> DataFrame:
    """(keys, n, estimate, p_value): p of the mean difference under random signs, (hits + 1) / (draws + 1)."""
    d = (F.col("treatment") - F.col("reference")).cast("double")
    slim = pairs.select(*keys, d.alias("__d"), unit.cast("string").alias("__u"))
    drawn = with_draws(slim, F.col("__u"), draws)
    sums = drawn.groupBy(*keys, "draw").agg(F.sum(F.when(F.col("u") < WORD // 2, F.col("__d")).otherwise(-F.col("__d"))).alias("__s"))
    total = slim.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("__d").alias("__sum"))
    hits = sums.join(total, keys).groupBy(*keys).agg(F.count_if(F.abs("__s") >= F.abs("__sum") - 1e-9).alias("__hits"))
    return total.join(hits, keys).select(*keys, "n", (F.col("__sum") / F.col("n")).alias("estimate"), ((F.col("__hits") + 1) / F.lit(draws + 1.0)).alias("p_value"))


def permute_labels(rows: DataFrame, keys: list[str], unit: Column, draws: int = 2000, least: int = 5) -> DataFrame:
    """(keys, deep_n, shallow_n, deep_mean, shallow_mean, observed_difference, p_value) of rows (keys, deep boolean, value).

    One-sided p of mean(deep) - mean(shallow). A draw deals the label to each unit with the observed share of deep rows, so group
    sizes vary about the observed ones; draws that leave a side empty do not count. No p for fewer than ``least`` rows a side.
    """
    slim = rows.select(*keys, F.col("deep").alias("__deep"), F.col("value").cast("double").alias("__v"), unit.cast("string").alias("__u"))
    total = slim.groupBy(*keys).agg(
        F.count_if("__deep").alias("deep_n"), F.count_if(~F.col("__deep")).alias("shallow_n"), F.avg(F.when(F.col("__deep"), F.col("__v"))).alias("deep_mean"), F.avg(F.when(~F.col("__deep"), F.col("__v"))).alias("shallow_mean")
    ).withColumn("observed_difference", F.col("deep_mean") - F.col("shallow_mean"))
    cut = F.floor(F.col("deep_n") / (F.col("deep_n") + F.col("shallow_n")) * WORD)
    drawn = with_draws(slim.join(F.broadcast(total.select(*keys, cut.alias("__cut"))) if not keys else total.select(*keys, cut.alias("__cut")), keys), F.col("__u"), draws)
    dealt = F.col("u") < F.col("__cut")
    means = drawn.groupBy(*keys, "draw").agg((F.avg(F.when(dealt, F.col("__v"))) - F.avg(F.when(~dealt, F.col("__v")))).alias("__d")).filter("__d IS NOT NULL")
    hits = means.join(total, keys).groupBy(*keys).agg(F.avg((F.col("__d") >= F.col("observed_difference") - 1e-12).cast("double")).alias("__p"))
    enough = F.least("deep_n", "shallow_n") >= least
    return total.join(hits, keys, "left").select(*keys, "deep_n", "shallow_n", "deep_mean", "shallow_mean", "observed_difference", F.when(enough, F.col("__p")).alias("p_value"))


def empirical_power(pairs: DataFrame, keys: list[str], unit: Column, trials: int = 2000, size: float = 1.0, cut: float = 3.841458820694124) -> DataFrame:
    """(keys, trials, wins, losses, power): share of resampled studies in which McNemar's test finds the difference.

    A trial draws every unit a Poisson number of times with mean ``size`` = 1, or, for whole ``size`` > 1, that many draws added up; its wins and losses are sums, so
    trials are dealt over the tasks as they read the pairs. Significant is a chi-square with continuity above ``cut`` (5 %).
    """
    copies = int(size)
    d = F.col("treatment") - F.col("reference")
    slim = pairs.select(*keys, F.when(d > 1e-9, 1).when(d < -1e-9, -1).otherwise(0).alias("__w"), unit.cast("string").alias("__u"))
    drawn = with_draws(slim, F.col("__u"), trials * copies).withColumn("__c", poisson_count(F.col("u"))).withColumn("__trial", F.floor(F.col("draw") / copies))
    sums = drawn.groupBy(*keys, "__trial").agg(F.sum(F.when(F.col("__w") > 0, F.col("__c")).otherwise(0)).alias("b"), F.sum(F.when(F.col("__w") < 0, F.col("__c")).otherwise(0)).alias("c"))
    off = F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    hit = F.coalesce(F.try_divide((off * off).cast("double"), (F.col("b") + F.col("c")).cast("double")), F.lit(0.0)) > cut
    total = slim.groupBy(*keys).agg(F.count_if(F.col("__w") > 0).alias("wins"), F.count_if(F.col("__w") < 0).alias("losses"))
    return total.join(sums.groupBy(*keys).agg(F.count("*").alias("trials"), F.avg(hit.cast("double")).alias("power")), keys)
