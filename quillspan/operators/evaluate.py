"""Evaluation: answer and evidence metrics, grouped and macro aggregates, audits, deterministic samples."""

from __future__ import annotations

import re
import string
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import values as V
from ..functions.text import squad_answer, truth

# ---- answers --------------------------------------------------------------------------------


def exact_match(prediction: Column, answers: Column) -> Column:
    """1.0 if an answer equals the prediction in normal form, else 0.0."""
    return F.coalesce(F.array_contains(F.transform(answers, squad_answer), squad_answer(prediction)), F.lit(False)).cast("double")


def _f1(common: int, predicted: int, gold: int) -> float:
    if not predicted or not gold:
        return float(predicted == gold)
    if not common:
        return 0.0
    p, r = common / predicted, common / gold
    return 2 * p * r / (p + r)


@F.pandas_udf(DoubleType())
def _best_multiset_f1(prediction: pd.Series, answers: pd.Series) -> pd.Series:
    def one(p: str | None, gold: list | None) -> float:
        mine = Counter((p or "").split())
        best = 0.0
        for g in gold if gold is not None else []:
            theirs = Counter((g or "").split())
            best = max(best, _f1((mine & theirs).total(), mine.total(), theirs.total()))
        return best

    return pd.Series([one(p, g) for p, g in zip(prediction, answers)], dtype=float)


def token_f1(prediction: Column, answers: Column) -> Column:
    """Best F1 over the answers, words as multisets, both sides normalised in the JVM; two empty texts agree fully.

    The multiset intersection is a hash count in an Arrow batch: as array functions it is quadratic in the text.
    """
    return _best_multiset_f1(squad_answer(prediction), F.transform(answers, squad_answer))


_IS_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?")
_PUNCTUATION = str.maketrans("", "", string.punctuation)


def drop_words(text: str | None) -> list[str]:
    """Words of a reading-comprehension answer: split at blanks and hyphens, numbers as floats, no articles."""
    out = []
    for t in re.split(r"[\s-]+", (text or "").lower()):
        t = t if _IS_NUMBER.fullmatch(t) else t.translate(_PUNCTUATION)
        if t and t not in ("a", "an", "the"):
            out.append(str(float(t)) if _IS_NUMBER.fullmatch(t) else t)
    return out


@F.pandas_udf(StructType([StructField("em", DoubleType()), StructField("f1", DoubleType())]))
def drop_scores(prediction: pd.Series, answers: pd.Series) -> pd.DataFrame:
    """(exact match, set F1 to two decimals), best over the answers; an answer's numbers must meet the prediction's."""

    def one(p: str | None, gold: list | None) -> tuple[float, float]:
        words, em, f1 = drop_words(p), 0.0, 0.0
        mine = set(words)
        for g in gold if gold is not None else []:
            theirs = drop_words(g)
            em = max(em, float(theirs == words))
            numbers = {t for t in theirs if _IS_NUMBER.fullmatch(t)}
            if not numbers or numbers & mine:
                f1 = max(f1, round(_f1(len(mine & set(theirs)), len(mine), len(set(theirs))), 2))
        return em, f1

    return pd.DataFrame([one(p, g) for p, g in zip(prediction, answers)], columns=["em", "f1"])


def boolean_accuracy(prediction: Column, answers: Column) -> Column:
    return F.coalesce(F.array_contains(F.transform(answers, truth), truth(prediction)), F.lit(False)).cast("double")


def primary_score(dataset: Column, f1: Column, drop_f1: Column, accuracy: Column) -> Column:
    return F.when(dataset == "strategyqa", accuracy).when(dataset == "drop", drop_f1).otherwise(f1)


# ---- evidence -------------------------------------------------------------------------------


def evidence_scores(ranked: DataFrame, gold: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Rank metrics for each query from (query_id, item, rank) and (query_id, item) gold; null without gold.

    An item counts at its first rank only; precision divides by k even if fewer items came.
    """
    first = ranked.groupBy("query_id", "item").agg(F.min("rank").alias("r"))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r", "item")))
    wanted = gold.select("query_id", "item").distinct()
    n_gold = wanted.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = first.join(wanted, ["query_id", "item"])
    aggs = [F.count("*").alias("found"), F.max(1.0 / F.col("rank")).alias("mrr"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg")]
    aggs += [F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks]
    got = hit.groupBy("query_id").agg(*aggs)
    base = ranked.select("query_id").union(gold.select("query_id")).distinct()
    out = base.join(n_gold, "query_id", "left").join(got, "query_id", "left")
    has = F.col("n_gold").isNotNull()
    zero = lambda c: F.when(has, F.coalesce(c, F.lit(0.0)))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n_gold", F.lit(10)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    cols = [zero(F.col("found") / F.col("n_gold")).alias("recall"), zero(F.col("mrr")).alias("mrr"), zero(F.col("dcg") / F.when(has, ideal)).alias("ndcg_10")]
    for k in ks:
        h = F.col(f"h{k}")
        cols += [zero(h / F.col("n_gold")).alias(f"recall_{k}"), zero(h / float(k)).alias(f"precision_{k}"), zero((h > 0).cast("double")).alias(f"hit_{k}")]
    return out.select("query_id", *cols)


# ---- aggregates over run records ------------------------------------------------------------


def aggregate_runs(runs: DataFrame, keys: list[str], metrics: list[str], latencies: list[str]) -> DataFrame:
    """Counts by status, success rate, failure histogram, null-skipping means and exact latency percentiles."""
    states = ["ok", "empty", "failed", "budget_exceeded", "unsupported_operation"]
    aggs = [F.count("*").alias("runs"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in states], F.avg((F.col("status") == "ok").cast("double")).alias("success_rate")]
    aggs += [F.avg(m).alias(f"mean_{m}") for m in metrics]
    for m in latencies:
        aggs += [F.percentile(m, F.lit(p / 100)).alias(f"{m}_p{p}") for p in (50, 95, 99)]
    main = runs.groupBy(*keys).agg(*aggs)
    each = runs.groupBy(*keys, "failure").agg(F.count("*").alias("n"))
    histogram = each.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("failure", "n"))))).alias("failures"))
    on = [main[k].eqNullSafe(histogram[k]) for k in keys]
    return main.join(histogram, on).select(main["*"], "failures")


def failure_report(runs: DataFrame) -> DataFrame:
    """Count of each failure and its share within dataset and method."""
    each = runs.groupBy("dataset", "method", "failure").agg(F.count("*").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("dataset", "method")))


def _split_seed(df: DataFrame) -> DataFrame:
    return df.withColumns({"base": F.substring_index("method", "@", 1), "seeded": F.contains("method", F.lit("@"))})


def macro_average(summary: DataFrame, metric: str) -> DataFrame:
    """Mean over seeds (``method@seed``), then over datasets."""
    seeds = _split_seed(summary).groupBy("base", "dataset").agg(F.avg(metric).alias("m"), F.count("*").alias("seeds"))
    return seeds.groupBy(F.col("base").alias("method")).agg(F.avg("m").alias(f"macro_{metric}"), F.count("*").alias("datasets"), F.max("seeds").alias("seed_count"))


def seed_variance(summary: DataFrame, metric: str) -> DataFrame:
    """Spread over seeds of the seeded methods; a single seed has deviation 0."""
    return _split_seed(summary).filter("seeded").groupBy("dataset", F.col("base").alias("method")).agg(
        F.count("*").alias("seeds"), F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.min(metric).alias("low"), F.max(metric).alias("high")
    )


def validity(runs: DataFrame, expected: int) -> DataFrame:
    return runs.agg(F.count("*").alias("observed"), F.count_if(F.col("status") == "ok").alias("completed")).select(
        F.lit(expected).cast("long").alias("expected"), "observed", "completed", (F.col("observed") / F.lit(float(expected))).alias("completion_rate")
    )


def frozen_plan_audit(runs: DataFrame) -> DataFrame:
    """Questions replayed under one plan: how many saw more than one plan hash."""
    each = runs.groupBy("dataset", "question_id").agg(F.count_distinct("plan_hash").alias("hashes"), F.sum("replays").alias("replays"))
    return each.groupBy("dataset").agg(F.count("*").alias("questions"), F.count_if(F.col("hashes") > 1).alias("mismatched"), F.sum("replays").alias("replays"), F.avg("replays").alias("mean_replays"), F.percentile("replays", F.lit(0.95)).alias("p95_replays"))


def strategy_summary(rows: DataFrame, baseline: str) -> DataFrame:
    """Per strategy against a baseline on the same questions: mean recall, full and any support, gains, ties, losses."""
    base = rows.filter(F.col("strategy") == baseline).select("dataset", "question_id", F.col("recall").alias("base"))
    d = rows.join(base, ["dataset", "question_id"]).withColumn("d", F.col("recall") - F.col("base"))
    return d.groupBy("strategy").agg(
        F.count("*").alias("questions"), V.exact_mean(F.col("recall")).alias("mean_recall"), F.avg((F.col("recall") >= 1.0).cast("double")).alias("full_support"), F.avg((F.col("recall") > 0).cast("double")).alias("any_support"),
        F.count_if(F.col("d") > 1e-12).alias("gains"), F.count_if(F.abs("d") <= 1e-12).alias("ties"), F.count_if(F.col("d") < -1e-12).alias("losses"), F.avg("calls").alias("mean_calls"),
    )


def select_strategy(summary: DataFrame, call_penalty: float = 0.02) -> DataFrame:
    """The best strategy: recall less call cost, full support, net gains, fewer calls, name."""
    value = F.col("mean_recall") - call_penalty * F.col("mean_calls")
    return summary.orderBy(F.round(value, 12).desc(), F.desc("full_support"), (F.col("gains") - F.col("losses")).desc(), "mean_calls", "strategy").limit(1)


def policy_confusion(decisions: DataFrame, call_penalty: float = 0.02, strata: list[str] | None = None) -> DataFrame:
    """Confusion counts, precision, recall, F1 and net utility of (policy, act, should, gain, calls), also within each stratum."""
    sets = ", ".join(["(policy)", *[f"(policy, {s})" for s in strata or []]])
    view = "__decisions"
    decisions.createOrReplaceTempView(view)
    names = "".join(f", {s}" for s in strata or [])
    base = decisions.sparkSession.sql(
        f"SELECT policy{names}, count(*) AS n, count_if(act AND should) AS tp, count_if(act AND NOT should) AS fp, count_if(NOT act AND should) AS fn, "
        f"count_if(NOT act AND NOT should) AS tn, sum(CASE WHEN act THEN gain - {call_penalty} * calls ELSE 0 END) AS net_utility FROM {view} GROUP BY GROUPING SETS ({sets})"
    )
    p, r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    out = base.withColumns({"precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0))})
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def action_audit(runs: DataFrame) -> DataFrame:
    """Selected and executed actions of (method, action_kind, action) as multisets: both, only selected, only executed."""
    counts = runs.groupBy("method", "action").agg(F.count_if(F.col("action_kind") == "selected").alias("s"), F.count_if(F.col("action_kind") == "executed").alias("e"))
    return counts.select("method", "action", F.least("s", "e").alias("both"), F.greatest(F.col("s") - F.col("e"), F.lit(0)).alias("only_selected"), F.greatest(F.col("e") - F.col("s"), F.lit(0)).alias("only_executed"))


def mean_in_order(value: str, order: str) -> Column:
    """Mean of a bounded group, added up in the order of a unique column: the same double however the rows are dealt to tasks; nulls do not count."""
    held = F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))))), lambda x: x["v"])
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.count(value).cast("double"))


def pairwise(scores: DataFrame) -> DataFrame:
    """Wins, ties and losses of every pair of methods on the questions that both answered: (question_id, method, score)."""
    a = scores.select("question_id", F.col("method").alias("left_method"), F.col("score").alias("x"))
    b = scores.select("question_id", F.col("method").alias("right_method"), F.col("score").alias("y"))
    both = a.join(b, "question_id").filter("left_method < right_method")
    return both.groupBy("left_method", "right_method").agg(
        F.count("*").alias("questions"), F.count_if(F.col("x") > F.col("y")).alias("wins"), F.count_if(F.col("x") == F.col("y")).alias("ties"), F.count_if(F.col("x") < F.col("y")).alias("losses")
    )


def gate_replay(rows: DataFrame, depth: int = 2) -> DataFrame:
    """Replay of a gate that takes the flat arm for deep questions where static is infeasible (``feasible`` null: depth alone decides)."""
    deep = (F.col("hops") >= depth) & ~F.coalesce("feasible", F.lit(False))
    gated = rows.withColumn("gated", F.when(deep, F.col("flat")).otherwise(F.col("static")))
    arms = ["static", "flat", "gated"]
    each = gated.groupBy("dataset").agg(*[F.avg(a).alias(a) for a in arms], F.count("*").alias("n"))
    micro = gated.agg(*[F.avg(a).alias(a) for a in arms], F.count("*").alias("n")).withColumn("dataset", F.lit("micro"))
    macro = each.agg(*[F.avg(a).alias(a) for a in arms], F.sum("n").alias("n")).withColumn("dataset", F.lit("macro"))
    return each.unionByName(micro).unionByName(macro)


def hop_bucket(hops: Column) -> Column:
    return F.when(hops <= 0, "0").when(hops == 1, "1").otherwise("2+")


def depth_table(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Dataset x arm x depth (4 and over together): runs, ok, null-skipping means, budget-exceeded rate."""
    depth = F.when(F.col("depth") >= 4, "4+").otherwise(F.col("depth").cast("string"))
    return rows.groupBy("dataset", "arm", depth.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ok").alias("n_ok"), *[F.avg(m).alias(f"mean_{m}") for m in metrics], F.avg((F.col("status") == "budget_exceeded").cast("double")).alias("exceeded_rate"))


def paired_deltas(rows: DataFrame, treatment: str, reference: str, score: str = "score") -> DataFrame:
    """Per dataset and depth: mean treatment-minus-reference, wins, ties, losses on questions that have both arms."""
    wide = rows.groupBy("dataset", "depth", "question_id").pivot("arm", [treatment, reference]).agg(F.first(score)).na.drop(subset=[treatment, reference])
    d = F.col(treatment) - F.col(reference)
    return wide.groupBy("dataset", "depth").agg(F.count("*").alias("n"), V.exact_mean(d).alias("treatment_minus_reference"), F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"))


def concordance(pairs: DataFrame) -> DataFrame:
    """2x2 table of (dataset, a, b) right/wrong flags: both, neither, b, c and the smoothed odds ratio."""
    out = pairs.groupBy("dataset").agg(F.count_if(F.col("a") & F.col("b")).alias("both_right"), F.count_if(~F.col("a") & ~F.col("b")).alias("both_wrong"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    return out.withColumn("odds_ratio", (F.col("only_b") + 0.5) / (F.col("only_a") + 0.5))


def population_effect(rows: DataFrame) -> DataFrame:
    """Mean effect among the eligible times their share, by dataset: (dataset, eligible, effect)."""
    return rows.groupBy("dataset").agg(F.avg(F.when(F.col("eligible"), F.col("effect"))).alias("ate"), F.avg(F.col("eligible").cast("double")).alias("prevalence")).withColumn("population", F.coalesce(F.col("ate"), F.lit(0.0)) * F.col("prevalence"))


def first_loss(stages: list[tuple[str, Column]]) -> Column:
    """The first stage whose condition fails, else ``none``."""
    out = F.lit("none")
    for name, kept in reversed(stages):
        out = F.when(~F.coalesce(kept, F.lit(False)), name).otherwise(out)
    return out


def error_class(retrieved: Column, gold: Column, used: Column, correct: Column) -> Column:
    """Where an answer went wrong, from arrays of ids."""
    return (
        F.when(correct, "OK")
        .when(F.size(gold) == 0, "UNKNOWN")
        .when(~F.arrays_overlap(retrieved, gold), "RETRIEVAL_MISS")
        .when(F.size(F.array_except(gold, retrieved)) > 0, "EVIDENCE_PARTIAL")
        .when(F.size(F.array_except(gold, used)) > 0, "EVIDENCE_INSUFFICIENT")
        .otherwise("ANSWER_GENERATION_ERROR")
    )


def pair_runs(runs: DataFrame, reference: str, treatment: str) -> DataFrame:
    """Reference and treatment scores side by side, with nulls for the missing side."""
    side = lambda m, n: runs.filter(F.col("method") == m).select("dataset", "question_id", F.col("score").alias(n))
    return side(reference, "reference").join(side(treatment, "treatment"), ["dataset", "question_id"], "full_outer")


def pairing_gaps(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("dataset").agg(F.count_if(F.col("reference").isNotNull() & F.col("treatment").isNotNull()).alias("paired"), F.count_if(F.col("treatment").isNull()).alias("without_treatment"), F.count_if(F.col("reference").isNull()).alias("without_reference"))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


# ---- deterministic samples ------------------------------------------------------------------


def quotas(counts: DataFrame, size: int) -> DataFrame:
    """Largest-remainder quotas of (stratum, n): one each if the size allows, the rest in proportion, ties by name.

    One row for each stratum goes through a single-partition window.
    """
    everything = Window.partitionBy()
    ordered = Window.orderBy("stratum")
    c = counts.withColumns({"strata": F.count("*").over(everything), "total": F.sum("n").over(everything)})
    c = c.withColumn("base", F.when(F.col("strata") <= size, 1).otherwise(0)).withColumn("free", F.col("n") - F.col("base"))
    left = F.lit(size) - F.sum("base").over(everything)
    c = c.withColumns({"left": left, "all_free": F.sum("free").over(everything)})
    exact = F.when(F.col("all_free") > 0, F.col("left") * F.col("free") / F.col("all_free")).otherwise(0.0)
    c = c.withColumn("exact", exact).withColumn("part", F.least(F.floor("exact"), F.col("free")))
    c = c.withColumn("rest", F.col("left") - F.sum("part").over(everything))
    open_ = (F.col("base") + F.col("part") < F.col("n")).cast("int")
    by_rest = Window.orderBy(F.round(F.col("exact") - F.col("part"), 9).desc(), "stratum")
    c = c.withColumn("one", F.when((open_ == 1) & (F.sum(open_).over(by_rest) <= F.col("rest")), 1).otherwise(0))
    c = c.withColumn("over", F.col("rest") - F.sum("one").over(everything)).withColumn("room", F.col("n") - F.col("base") - F.col("part") - F.col("one"))
    before = F.coalesce(F.sum("room").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.least(F.col("room"), F.col("over") - before), F.lit(0))
    return c.select("stratum", "n", (F.col("base") + F.col("part") + F.col("one") + extra).cast("long").alias("quota"))


def sample_place(seed: int, dataset: str, key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit(dataset), key.cast("string")), 256)


def stratified_sample(df: DataFrame, key: str, stratum: str, size: int, seed: int, dataset: str) -> DataFrame:
    """Of each stratum the quota of rows with the least SHA-256 of ``seed:dataset:key``; (key, stratum, place)."""
    counts = df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("n"))
    q = quotas(counts, size)
    placed = df.select(F.col(key), F.col(stratum).alias("stratum"), sample_place(seed, dataset, F.col(key)).alias("place"))
    top = placed.withColumn("rn", F.row_number().over(Window.partitionBy("stratum").orderBy("place", key))).filter(F.col("rn") <= size)
    return top.join(F.broadcast(q), "stratum").filter(F.col("rn") <= F.col("quota")).select(key, "stratum", "place")


def disjoint_sample(df: DataFrame, taken: DataFrame, key: str, stratum: str, size: int, seed: int, dataset: str) -> DataFrame:
    """A stratified sample of the rows that no earlier sample (``taken``, by key) holds; quotas are those of what is left."""
    return stratified_sample(df.join(taken.select(key).distinct(), key, "left_anti"), key, stratum, size, seed, dataset)


def holdout_share(key: Column) -> Column:
    """The first eight digest bytes of the key as a share of 2^64."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def fold_of(key: Column, folds: int) -> Column:
    """SHA-256 of the key modulo ``folds``, digit by digit."""
    digits = F.split(F.sha2(key.cast("string"), 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + F.conv(d, 16, 10).cast("long")) % folds)


def split_sets(df: DataFrame, key: str, seed: int, shares: tuple[float, float]) -> DataFrame:
    """(key, part): development, validation or test by the key's hash, reproducibly and without a global sort."""
    u = holdout_share(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.select(key, F.when(u < shares[0], "development").when(u < shares[0] + shares[1], "validation").otherwise("test").alias("part"))


def disjoint(df: DataFrame, used: DataFrame, key: str) -> DataFrame:
    return df.join(used.select(key), key, "left_anti")


def sample_audit(sample: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Counts of a sample: rows, distinct keys, keys that the source lacks."""
    stray = sample.join(source.select(key).distinct().withColumn("__in", F.lit(1)), key, "left")
    return stray.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("distinct_keys"), F.count_if(F.col("__in").isNull()).alias("strays"))


def run_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the count, and means in which a missing value is 0; zeros for no rows."""
    mean = lambda m: F.coalesce(F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))), F.lit(0.0))
    return rows.agg(F.count("*").alias("count"), *[mean(m).alias(m) for m in metrics])
