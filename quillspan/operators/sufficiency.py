"""Sufficiency features of slot materialisations, and how action policies fare on labelled examples.

The results of a materialisation are at most its top k and its rows come from these, so the arrays that are
built here are small; their number, one for each materialisation, is what grows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import ascii_words, coverage

#: The features in the order of stored calibrators.
FEATURES = [
    "top1_score", "topk_score", "topk_min_score", "top1_top2_margin", "score_entropy", "backend_top1_score", "backend_top1_top2_margin", "backend_margin_ratio", "backend_top1_share", "backend_relative_entropy",
    "backend_score_iqr_ratio", "backend_top1_robust_zscore", "backend_rank_discounted_mass", "score_source_bm25", "score_source_dense", "score_source_reranker", "score_source_fused", "sparse_dense_agreement", "reranker_agreement", "new_entity_coverage",
    "source_diversity", "predicate_coverage", "bound_variable_coverage", "join_edge_coverage", "extraction_consistency", "row_count", "remaining_plan_depth", "budget_remaining", "budget_fraction", "retrieval_count",
]
_TINY = 1e-12


@F.pandas_udf(ArrayType(StringType()))
def _each_words(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: None if xs is None else ascii_words.func(pd.Series(list(xs), dtype=object)).tolist())


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _clip(c: Column, high: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(high), c))


def _quantile(up: Column, q: float) -> Column:
    """Linear interpolation in a sorted array."""
    at = (F.size(up) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    left, right = F.get(up, low), F.get(up, F.least(low + 1, F.size(up) - 1))
    return left + (right - left) * (at - low)


def _entropy(weights: Column, total: Column) -> Column:
    """Entropy of an array of positive weights as a share of its largest possible value."""
    n = F.size(weights)
    bits = _sum(F.transform(weights, lambda w: F.when(w > 0, -(w / total) * F.log(w / total)).otherwise(0.0)))
    return F.when(n > 1, bits / F.log(n)).otherwise(0.0)


def with_shape(df: DataFrame, scores: str) -> DataFrame:
    """Add the shape of an array of scores in result order: 0 everywhere for an empty one.

    Masses are the scores above the smallest one, as shares; equal ones if no score differs. Totals are columns of their
    own, so that no lambda computes them for each element.
    """
    up = F.col("__up")
    n, low, high = F.size(scores), F.get(up, F.lit(0)), F.get(up, F.size(up) - 1)
    df = df.withColumn("__up", F.array_sort(scores))
    df = df.withColumn("__total", _sum(F.transform(scores, lambda x: x - low)))
    df = df.withColumn("__mass", F.transform(scores, lambda x: F.when(F.col("__total") <= _TINY, F.lit(1.0) / n).otherwise((x - low) / F.col("__total"))))
    mass, span, second = F.col("__mass"), high - low, F.when(n > 1, F.get(up, n - 2)).otherwise(high)
    df = df.withColumn("__iqr", _quantile(up, 0.75) - _quantile(up, 0.25))
    scale = F.when(F.col("__iqr") > _TINY, F.col("__iqr")).otherwise(span)
    shape = {
        "backend_top1_score": high,
        "backend_top1_top2_margin": high - second,
        "backend_margin_ratio": _clip((high - second) / F.greatest(F.abs(high), F.abs(second), F.lit(_TINY)), 2.0),
        "backend_top1_share": F.array_max(mass),
        "backend_relative_entropy": _clip(_entropy(mass, F.lit(1.0)), 1.0),
        "backend_score_iqr_ratio": F.when(span > _TINY, F.col("__iqr") / span).otherwise(0.0),
        "backend_top1_robust_zscore": _clip(F.when(scale > _TINY, (high - _quantile(up, 0.5)) / scale).otherwise(0.0), 20.0),
        "backend_rank_discounted_mass": _clip(_sum(F.transform(mass, lambda m, i: m / F.log2(i + F.lit(2.0)))), 1.0),
    }
    return df.withColumns({k: F.when(n > 0, v).otherwise(0.0) for k, v in shape.items()}).drop("__up", "__total", "__mass", "__iqr")


def agreement(df: DataFrame, results: str, left: str, right: str, name: str) -> DataFrame:
    """Add the Spearman agreement in [0, 1] of two scores over the results that have both; 1 for fewer than two."""
    both = F.filter(results, lambda r: r[left].isNotNull() & r[right].isNotNull())
    order = lambda c: F.transform(F.array_sort(F.transform(both, lambda r: F.struct((-r[c]).alias("s"), r["passage_id"].alias("id")))), lambda r: r["id"])
    df = df.withColumns({"__here": order(left), "__there": order(right)})
    n = F.size("__here").cast("double")
    d2 = _sum(F.zip_with("__here", F.transform("__here", lambda x, i: i), lambda x, i: F.pow((i - F.array_position(F.col("__there"), x) + 1).cast("double"), F.lit(2.0))))
    df = df.withColumn("__d2", d2)
    return df.withColumn(name, F.when(n < 2, 1.0).otherwise(_clip((2 - 6 * F.col("__d2") / (n * (n * n - 1))) / 2, 1.0))).drop("__here", "__there", "__d2")


def features(contexts: DataFrame, results: DataFrame, rows: DataFrame, query: str = "query_id") -> DataFrame:
    """(query_id, the 30 features), one row for each context.

    ``contexts``: query_id, predicate, requested, join_variables, bound (arrays; bound has values), backend, call_budget,
    calls_used, remaining_depth. ``results``: query_id, pos, passage_id, doc_id, text, score, bm25_score, dense_score,
    rerank_score. ``rows``: query_id, pos, source_id, bindings (map), confidence.
    """
    bare = lambda c: F.transform(c, lambda v: F.regexp_replace(v, r"^\?+", ""))
    ctx = contexts.select(
        query, F.array_distinct(F.filter(F.split(ascii_words(F.coalesce("predicate", F.lit(""))), " "), lambda t: t != "")).alias("predicate"), bare(F.col("requested")).alias("requested"), bare(F.col("join_variables")).alias("joined"),
        _each_words(F.col("bound")).alias("bound"), "backend", F.greatest(F.col("call_budget") - F.col("calls_used"), F.lit(0)).alias("left_"), F.col("call_budget").alias("total_"), F.col("remaining_depth").alias("depth_"),
    )
    one = F.struct("pos", "passage_id", F.coalesce(F.nullif("doc_id", F.lit("")), F.col("passage_id")).alias("doc_id"), ascii_words(F.coalesce("text", F.lit(""))).alias("words"), *[F.col(c).cast("double").alias(c) for c in ("score", "bm25_score", "dense_score", "rerank_score")])
    found = results.select(query, one.alias("r")).groupBy(query).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    empty = F.from_json(F.lit("[]"), found.schema["rs"].dataType)
    base = ctx.join(found, query, "left").withColumn("rs", F.coalesce("rs", empty))

    cells = rows.select(query, "pos", F.explode_outer("bindings").alias("k", "v")).withColumns({"k": F.regexp_replace("k", r"^\?+", ""), "w": ascii_words(F.col("v"))})
    signed = cells.groupBy(query, "pos").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("sig"), F.collect_set(F.when(F.trim("v") != "", F.col("k"))).alias("filled"))
    last = cells.filter(F.col("k").isNotNull()).groupBy(query, "k").agg(F.max_by("w", "pos").alias("w")).groupBy(query).agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("last"))
    ids = base.select(query, "requested", F.transform("rs", lambda r: r["passage_id"]).alias("ids"))
    each = rows.select(query, "pos", "source_id", "confidence").join(signed, [query, "pos"]).join(ids, query)
    share = F.when(F.size("requested") > 0, F.size(F.filter("requested", lambda v: F.array_contains(F.col("filled"), v))) / F.size("requested")).otherwise(1.0)
    seen = each.groupBy(query).agg(
        F.count("*").alias("n"), F.avg(F.array_contains("ids", F.col("source_id")).cast("double")).alias("valid"), F.avg(share).alias("share"), F.avg("confidence").alias("confidence"), F.count_distinct("sig").alias("sigs"), F.array_distinct(F.flatten(F.collect_set("filled"))).alias("covered")
    )
    full = base.join(seen, query, "left").join(last, query, "left")

    rs, n = F.col("rs"), F.size("rs")
    has = lambda c: F.exists(rs, lambda r: r[c].isNotNull())
    sparse, dense = has("bm25_score"), has("dense_score")
    general = F.when(has("rerank_score"), "reranker").when(sparse & dense, "fused").when(dense, "dense").when(sparse, "bm25").otherwise("fused")
    picked = F.when(F.col("backend") == "bm25", F.when(sparse, "bm25").otherwise("fused")).otherwise(general)
    full = full.withColumn("source", picked).withColumns({
        "backend_scores": F.array_compact(F.transform(rs, lambda r: F.when(F.col("source") == "bm25", r["bm25_score"]).when(F.col("source") == "dense", r["dense_score"]).when(F.col("source") == "reranker", r["rerank_score"]).otherwise(r["score"]))),
        "down": F.sort_array(F.transform(rs, lambda r: F.coalesce(r["rerank_score"], r["score"])), asc=False),
        "hay": F.concat_ws(" ", F.filter(F.transform(rs, lambda r: r["words"]), lambda t: t != "")),
    })
    down, top = F.col("down"), F.get("down", F.lit(0))
    present = F.array_compact(F.transform(F.col("joined"), lambda v: F.try_element_at(F.col("last"), v)))
    m = F.coalesce("n", F.lit(0))
    full = with_shape(full, "backend_scores").withColumn("__soft", F.transform(down, lambda x: F.exp(F.greatest(x - top, F.lit(-50.0))))).withColumn("__softs", _sum(F.col("__soft")))
    full = agreement(agreement(full, "rs", "bm25_score", "dense_score", "sparse_dense_agreement"), "rs", "score", "rerank_score", "reranker_agreement")
    out = {name: F.col(name) for name in FEATURES if name.startswith("backend_")} | {
        "top1_score": F.coalesce(top, F.lit(0.0)),
        "topk_score": F.when(n > 0, _sum(down) / n).otherwise(0.0),
        "topk_min_score": F.coalesce(F.array_min(down), F.lit(0.0)),
        "top1_top2_margin": F.coalesce(top - F.coalesce(F.get(down, F.lit(1)), top), F.lit(0.0)),
        "score_entropy": _entropy(F.col("__soft"), F.col("__softs")),
        **{f"score_source_{s}": (F.col("source") == s).cast("double") for s in ("bm25", "dense", "reranker", "fused")},
        "sparse_dense_agreement": F.col("sparse_dense_agreement"),
        "reranker_agreement": F.col("reranker_agreement"),
        "new_entity_coverage": F.when(F.size("requested") > 0, F.size(F.array_intersect("requested", F.coalesce("covered", F.array().cast("array<string>")))) / F.size("requested")).otherwise((m > 0).cast("double")),
        "source_diversity": F.when(n > 0, F.size(F.array_distinct(F.transform(rs, lambda r: r["doc_id"]))) / n).otherwise(0.0),
        "predicate_coverage": coverage(F.col("predicate"), F.col("hay"), 0.0),
        "bound_variable_coverage": coverage(F.col("bound"), F.col("hay"), 1.0),
        "join_edge_coverage": F.when(F.size("joined") == 0, 1.0).when(F.size(F.coalesce(present, F.array().cast("array<string>"))) == 0, 0.0).otherwise(coverage(present, F.col("hay"))),
        "extraction_consistency": F.when(m > 0, F.col("valid") * F.col("share") * F.col("confidence") * F.col("sigs") / m).otherwise(0.0),
        "row_count": m,
        "remaining_plan_depth": F.col("depth_"),
        "budget_remaining": F.col("left_"),
        "budget_fraction": F.when(F.col("total_") > 0, F.col("left_") / F.col("total_")).otherwise(0.0),
        "retrieval_count": n,
    }
    return full.select(query, *[out[name].alias(name) for name in FEATURES])


def runtime_proxy(rows: DataFrame, remaining_depth: int, query: str = "query_id") -> DataFrame:
    """An uncalibrated estimate from binding rows (query_id, _confidence, _retrieval_score), for traces."""
    g = rows.groupBy(query).agg(F.count("*").alias("row_count"), F.avg("_confidence").alias("confidence"), F.max("_retrieval_score").alias("best"))
    p = _clip(0.7 * F.col("confidence") + 0.3 * F.coalesce("best", "confidence"), 1.0)
    status = F.when(F.lit(remaining_depth == 0) & (F.col("confidence") >= 0.5), "SUFFICIENT").otherwise("PARTIAL")
    return g.select(query, "row_count", p.alias("probability"), ((p - 0.5) * 8).alias("raw_logit"), status.alias("status"))


# ---- policies -------------------------------------------------------------------------------


def decide(policy: str, candidates: Column, state: dict[str, Column], quality: Column | None = None) -> Column:
    """The candidate that a policy takes: utility, rule, fixed_topk, legacy or oracle (by the labelled quality map)."""
    if policy == "utility":
        return F.array_max(candidates)
    if policy == "oracle":
        best = F.array_max(F.transform(candidates, lambda c: F.struct(F.coalesce(F.try_element_at(quality, c["action"]), F.lit(0.0)).alias("q"), (-c["calls"]).alias("k"), c["action"].alias("action"))))
        name = best["action"]
    else:
        ready, paid = state["answerable"] & state["has_rows"], state["calls_left"] > 0
        if policy == "legacy":
            name = F.when(ready, "ANSWER").when(paid, "RETRIEVE_SLOT_ONLY").otherwise("ABSTAIN")
        elif policy in ("rule", "fixed_topk"):
            done = ready & state["sufficient"] if policy == "rule" else ready
            name = F.when(done, "ANSWER").when(state["can_expand"] & paid, "EXPAND_TOPK").when(state["has_rows"], "STOP_SLOT").otherwise("ABSTAIN")
        else:
            raise ValueError(f"unknown policy {policy!r}")
    own = F.get(F.filter(candidates, lambda c: c["action"] == name), F.lit(0))
    free = F.lit(0.0)
    return F.coalesce(own, F.struct(free.alias("utility"), free.alias("gain"), name.alias("action"), F.lit(0).alias("calls"), F.lit(0).alias("tokens"), F.lit(0).alias("ms")))


def policy_report(decided: DataFrame, keys: list[str]) -> DataFrame:
    """Quality, regret, costs and outcome against the baseline action, for each value of ``keys``.

    ``decided`` has choice (a candidate), quality (map of action to value), oracle_action and baseline_action
    (either may be null).
    """
    q = lambda a: F.coalesce(F.try_element_at("quality", a), F.lit(0.0))
    gain = q(F.col("choice.action")) - q(F.coalesce("baseline_action", F.lit("ABSTAIN")))
    best = F.coalesce(F.array_max(F.map_values("quality")), F.lit(0.0))
    return decided.groupBy(*keys).agg(
        F.count("*").alias("examples"), F.coalesce(F.avg((F.col("choice.action") == F.col("oracle_action")).cast("double")), F.lit(0.0)).alias("action_accuracy"), F.avg(q(F.col("choice.action"))).alias("mean_quality"), F.avg(F.greatest(best - q(F.col("choice.action")), F.lit(0.0))).alias("mean_regret"),
        F.avg(F.col("choice.calls").cast("double")).alias("mean_calls"), F.avg(F.col("choice.tokens").cast("double")).alias("mean_tokens"), F.avg(F.col("choice.ms").cast("double")).alias("mean_latency_ms"),
        F.count_if(gain > 0).alias("gains"), F.count_if(gain == 0).alias("ties"), F.count_if(gain < 0).alias("losses"),
    )
