"""Registered queries of the evaluation layer, statistics, policies and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import values as V
from .operators import evaluate as E
from .operators import policy, stats
from .plans.execute import Relation, TableMaterializer, execute
from .plans.model import Join, LogicalPlan, Operator, Slot, SlotPlan
from .plans.optimize import SearchOptions, search
from .queries import _LISTS_SQL, _lists, query, table

# ---- answers and evidence -------------------------------------------------------------------

_NORM = r"list_filter(regexp_split_to_array(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the'))"
_PAIRS_SQL = f"""
WITH p AS (SELECT conv_id, turn, text AS prediction, lead(text, 1, text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS answer FROM conversations),
 w AS (SELECT *, {_NORM.format('prediction')} AS x, {_NORM.format('answer')} AS y FROM p),
 a AS (SELECT conv_id, turn, prediction, answer, unnest(x) AS t FROM w), b AS (SELECT conv_id, turn, prediction, answer, unnest(y) AS t FROM w),
 k AS (SELECT a.conv_id, a.turn, a.prediction, a.answer, sum(least(a.n, b.n)) AS common FROM (SELECT *, count(*) AS n FROM a GROUP BY ALL) AS a JOIN (SELECT *, count(*) AS n FROM b GROUP BY ALL) AS b USING (conv_id, turn, prediction, answer, t) GROUP BY ALL),
 c AS (SELECT w.*, coalesce(common, 0) AS common FROM w LEFT JOIN k USING (conv_id, turn, prediction, answer))
"""


def _pairs(spark, sf) -> DataFrame:
    from pyspark.sql.window import Window

    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # a conversation is a bounded group
    return c.select("conv_id", "turn", F.col("text").alias("prediction"), F.array(F.coalesce(F.lead("text").over(w), F.col("text"))).alias("answers"))


@query(_PAIRS_SQL + """SELECT conv_id, turn, CASE WHEN x = y THEN 1.0 ELSE 0.0 END AS em,
 round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN CASE WHEN len(x) = len(y) THEN 1.0 ELSE 0.0 END WHEN common > 0 THEN 2.0 * (common / len(x)) * (common / len(y)) / (common / len(x) + common / len(y)) ELSE 0.0 END, 6) AS f1 FROM c""")
def answer_em_f1(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", E.exact_match(F.col("prediction"), F.col("answers")).alias("em"), F.round(E.token_f1(F.col("prediction"), F.col("answers")), 6).alias("f1"))


@query()
def drop_scores(spark, sf):
    return _pairs(spark, sf).withColumn("s", E.drop_scores("prediction", "answers")).select("conv_id", "turn", "s.em", "s.f1")


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ('true', 'yes', 'false', 'no')) AS hits FROM conversations)
SELECT conv_id, turn, CASE WHEN len(hits) = 0 THEN 0.0 WHEN hits[1] IN ('true', 'yes') THEN 1.0 ELSE 0.0 END AS accuracy FROM w
""")
def boolean_accuracy(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", E.boolean_accuracy(F.col("text"), F.array(F.lit("yes"))).alias("accuracy"))


@query(_LISTS_SQL + """, gold AS (SELECT query_id, pos FROM lb WHERE rank <= 3), n AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
 h AS (SELECT la.query_id, la.rank FROM la JOIN gold ON la.query_id = gold.query_id AND la.pos = gold.pos)
SELECT n.query_id, round(count(h.rank) / any_value(n), 6) AS recall, round(coalesce(max(1.0 / h.rank), 0), 6) AS mrr,
 round(coalesce(sum(CASE WHEN h.rank <= 10 THEN 1 / log2(h.rank + 1.0) END), 0) / any_value(CASE n WHEN 1 THEN 1 WHEN 2 THEN 1 + 1 / log2(3.0) ELSE 1 + 1 / log2(3.0) + 0.5 END), 6) AS ndcg_10,
 round(count(*) FILTER (h.rank <= 5) / 5.0, 6) AS precision_5, CASE WHEN count(*) FILTER (h.rank <= 1) > 0 THEN 1.0 ELSE 0.0 END AS hit_1
FROM n LEFT JOIN h ON n.query_id = h.query_id GROUP BY n.query_id""")
def evidence_metrics(spark, sf):
    a, b = _lists(spark, sf)
    out = E.evidence_scores(a.select("query_id", F.col("pos").alias("item"), "rank"), b.filter("rank <= 3").select("query_id", F.col("pos").alias("item")))
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg_10", "precision_5")], "hit_1")


# ---- run records ----------------------------------------------------------------------------

_RUNS_SQL = """
WITH r AS (SELECT event_id, 'd' || (user_id % 3) AS dataset, event_type AS method, user_id AS question_id, least(greatest(value / 100, 0), 1) AS score, value AS latency, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 80 THEN 'empty' ELSE 'ok' END AS status,
  CASE WHEN event_type = 'error' THEN 'provider_connect' WHEN value > 80 THEN 'empty' ELSE 'ok' END AS failure, user_id % 5 AS depth FROM events)
"""


def _runs(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    error, high = F.col("event_type") == "error", F.col("value") > 80
    return e.select(
        "event_id", F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"), F.col("event_type").alias("method"), F.col("user_id").alias("question_id"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("score"), F.col("value").alias("latency"),
        F.when(error, "failed").when(high, "empty").otherwise("ok").alias("status"), F.when(error, "provider_connect").when(high, "empty").otherwise("ok").alias("failure"), (F.col("user_id") % 5).alias("depth"),
    )


@query(_RUNS_SQL + """SELECT dataset, method, count(*) AS runs, count(*) FILTER (status = 'ok') AS n_ok, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(score), 6) AS mean_score,
 round(quantile_cont(latency, 0.5), 6) AS latency_p50, round(quantile_cont(latency, 0.95), 6) AS latency_p95, round(quantile_cont(latency, 0.99), 6) AS latency_p99 FROM r GROUP BY ALL""")
def run_aggregate(spark, sf):
    a = E.aggregate_runs(_runs(spark, sf), ["dataset", "method"], ["score"], ["latency"])
    return a.select("dataset", "method", "runs", "n_ok", *[F.round(c, 6).alias(c) for c in ("success_rate", "mean_score", "latency_p50", "latency_p95", "latency_p99")])


@query(_RUNS_SQL + "SELECT dataset, method, depth, count(*) AS runs, round(avg(score), 6) AS mean_score FROM r GROUP BY ALL")
def stratified_aggregate(spark, sf):
    return E.aggregate_runs(_runs(spark, sf), ["dataset", "method", "depth"], ["score"], []).select("dataset", "method", "depth", "runs", F.round("mean_score", 6).alias("mean_score"))


@query(_RUNS_SQL + "SELECT dataset, method, failure, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY dataset, method), 6) AS share FROM r GROUP BY dataset, method, failure")
def failure_report(spark, sf):
    return E.failure_report(_runs(spark, sf)).withColumn("share", F.round("share", 6))


_SUMMARY_SQL = _RUNS_SQL + ", s AS (SELECT dataset, method, depth, avg(score) AS m FROM r GROUP BY ALL)"


def _summary(spark, sf) -> DataFrame:
    s = _runs(spark, sf).groupBy("dataset", "method", "depth").agg(F.avg("score").alias("m"))
    return s.select("dataset", F.concat_ws("@", "method", F.col("depth").cast("string")).alias("method"), "m")


@query(_SUMMARY_SQL + ", d AS (SELECT method, dataset, avg(m) AS m, count(*) AS k FROM s GROUP BY ALL) SELECT method, round(avg(m), 6) AS macro_m, count(*) AS datasets, max(k) AS seed_count FROM d GROUP BY method")
def macro_average(spark, sf):
    return E.macro_average(_summary(spark, sf), "m").withColumn("macro_m", F.round("macro_m", 6))


@query(_SUMMARY_SQL + "SELECT dataset, method, count(*) AS seeds, round(avg(m), 6) AS mean, round(coalesce(stddev_samp(m), 0), 6) AS std, round(min(m), 6) AS low, round(max(m), 6) AS high FROM s GROUP BY ALL")
def seed_variance(spark, sf):
    v = E.seed_variance(_summary(spark, sf), "m")
    return v.select("dataset", "method", "seeds", *[F.round(c, 6).alias(c) for c in ("mean", "std", "low", "high")])


@query(_RUNS_SQL + "SELECT CAST(5000 AS BIGINT) AS expected, count(*) AS observed, count(*) FILTER (status = 'ok') AS completed, count(*) / 5000.0 AS completion_rate FROM r")
def validity(spark, sf):
    return E.validity(_runs(spark, sf), 5000)


@query(_RUNS_SQL + ", q AS (SELECT dataset, question_id, count(DISTINCT depth + (event_id % 2)) AS h, sum(event_id % 4)::BIGINT AS n FROM r GROUP BY ALL) SELECT dataset, count(*) AS questions, count(*) FILTER (h > 1) AS mismatched, sum(n)::BIGINT AS replays, round(avg(n), 6) AS mean_replays, round(quantile_cont(n, 0.95), 6) AS p95_replays FROM q GROUP BY dataset")
def frozen_plan_audit(spark, sf):
    a = E.frozen_plan_audit(_runs(spark, sf).withColumns({"plan_hash": F.col("depth") + F.col("event_id") % 2, "replays": F.col("event_id") % 4}))
    return a.select("dataset", "questions", "mismatched", "replays", F.round("mean_replays", 6).alias("mean_replays"), F.round("p95_replays", 6).alias("p95_replays"))


_STRATEGY_SQL = _RUNS_SQL + """, t AS (SELECT dataset, question_id, method AS strategy, round(avg(score), 1) AS recall, count(*) AS calls FROM r GROUP BY ALL),
 j AS (SELECT t.*, t.recall - b.recall AS d FROM t JOIN t AS b ON b.strategy = 'view' AND b.dataset = t.dataset AND b.question_id = t.question_id),
 s AS (SELECT strategy, count(*) AS questions, avg(recall) AS mean_recall, avg(CASE WHEN recall >= 1 THEN 1.0 ELSE 0 END) AS full_support, avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0 END) AS any_support, count(*) FILTER (d > 1e-12) AS gains, count(*) FILTER (abs(d) <= 1e-12) AS ties, count(*) FILTER (d < -1e-12) AS losses, avg(calls) AS mean_calls FROM j GROUP BY strategy)
"""


def _strategies(spark, sf) -> DataFrame:
    t = _runs(spark, sf).groupBy("dataset", "question_id", F.col("method").alias("strategy")).agg(V.rounded(E.mean_in_order("score", "event_id"), 1).alias("recall"), F.count("*").alias("calls"))
    return E.strategy_summary(t, "view")


@query(_STRATEGY_SQL + "SELECT strategy, questions, round(mean_recall, 6) AS mean_recall, round(full_support, 6) AS full_support, round(any_support, 6) AS any_support, gains, ties, losses, round(mean_calls, 6) AS mean_calls FROM s")
def strategy_summary(spark, sf):
    return _strategies(spark, sf).select("strategy", "questions", *[V.rounded(F.col(c), 6).alias(c) for c in ("mean_recall", "full_support", "any_support")], "gains", "ties", "losses", V.rounded(F.col("mean_calls"), 6).alias("mean_calls"))


@query(_STRATEGY_SQL + "SELECT strategy FROM s ORDER BY round(mean_recall - 0.02 * mean_calls, 12) DESC, full_support DESC, gains - losses DESC, mean_calls, strategy LIMIT 1")
def strategy_choice(spark, sf):
    return E.select_strategy(_strategies(spark, sf)).select("strategy")


@query(_RUNS_SQL + """, d AS (SELECT method AS policy, dataset, latency > 30 AS act, score > 0.4 AS should, score AS gain, 1 AS calls FROM r)
SELECT policy, dataset, count(*) AS n, count(*) FILTER (act AND should) AS tp, count(*) FILTER (act AND NOT should) AS fp, count(*) FILTER (NOT act AND should) AS fn, count(*) FILTER (NOT act AND NOT should) AS tn,
 round(sum(CASE WHEN act THEN gain - 0.02 * calls ELSE 0 END), 4) AS net_utility FROM d GROUP BY GROUPING SETS ((policy), (policy, dataset))""")
def policy_confusion(spark, sf):
    d = _runs(spark, sf).select(F.col("method").alias("policy"), "dataset", (F.col("latency") > 30).alias("act"), (F.col("score") > 0.4).alias("should"), F.col("score").alias("gain"), F.lit(1).alias("calls"))
    return E.policy_confusion(d, 0.02, ["dataset"]).select("policy", "dataset", "n", "tp", "fp", "fn", "tn", F.round("net_utility", 4).alias("net_utility"))


@query(_RUNS_SQL + """, a AS (SELECT dataset AS method, method AS action, count(*) FILTER (event_id % 2 = 0) AS s, count(*) FILTER (event_id % 2 = 1) AS e FROM r GROUP BY ALL)
SELECT method, action, least(s, e) AS both_sides, greatest(s - e, 0) AS only_selected, greatest(e - s, 0) AS only_executed FROM a""")
def action_audit(spark, sf):
    r = _runs(spark, sf).select(F.col("dataset").alias("method"), F.col("method").alias("action"), F.when(F.col("event_id") % 2 == 0, "selected").otherwise("executed").alias("action_kind"))
    return E.action_audit(r).withColumnRenamed("both", "both_sides")


_SCORES_SQL = _RUNS_SQL + ", m AS (SELECT dataset, question_id, method, round(avg(score), 4) AS score FROM r GROUP BY ALL)"


def _scores(spark, sf) -> DataFrame:
    return _runs(spark, sf).groupBy("dataset", "question_id", "method").agg(V.rounded(E.mean_in_order("score", "event_id"), 4).alias("score"))  # one question's runs by one method: a bounded group


@query(_SCORES_SQL + "SELECT a.method AS left_method, b.method AS right_method, count(*) AS questions, count(*) FILTER (a.score > b.score) AS wins, count(*) FILTER (a.score = b.score) AS ties, count(*) FILTER (a.score < b.score) AS losses FROM m AS a JOIN m AS b ON a.question_id = b.question_id AND a.method < b.method GROUP BY ALL")
def pairwise_wtl(spark, sf):
    return E.pairwise(_scores(spark, sf))


_WIDE_SQL = _SCORES_SQL + ", w AS (SELECT dataset, question_id, max(score) FILTER (method = 'view') AS ref, max(score) FILTER (method = 'click') AS trt FROM m GROUP BY ALL), p AS (SELECT *, trt - ref AS d FROM w WHERE ref IS NOT NULL AND trt IS NOT NULL)"


def _paired(spark, sf) -> DataFrame:
    return E.pair_runs(_scores(spark, sf), "view", "click")


@query(_WIDE_SQL + ", g AS (SELECT dataset, ref AS static, trt AS flat, CASE WHEN question_id % 5 >= 2 THEN trt ELSE ref END AS gated FROM p), e AS (SELECT dataset, avg(static) AS s, avg(flat) AS f, avg(gated) AS g, count(*) AS n FROM g GROUP BY 1) SELECT dataset, round(s, 6) AS static, round(f, 6) AS flat, round(g, 6) AS gated, n FROM e UNION ALL SELECT 'micro', round(avg(static), 6), round(avg(flat), 6), round(avg(gated), 6), count(*) FROM g UNION ALL SELECT 'macro', round(avg(s), 6), round(avg(f), 6), round(avg(g), 6), sum(n)::BIGINT FROM e")
def gate_replay(spark, sf):
    p = _paired(spark, sf).na.drop().select("dataset", F.col("reference").alias("static"), F.col("treatment").alias("flat"), (F.col("question_id") % 5).alias("hops"), F.lit(None).cast("boolean").alias("feasible"))
    return E.gate_replay(p).select("dataset", *[F.round(c, 6).alias(c) for c in ("static", "flat", "gated")], "n")


@query(_WIDE_SQL + "SELECT dataset, CASE WHEN question_id % 5 = 0 THEN '0' WHEN question_id % 5 = 1 THEN '1' ELSE '2+' END AS bucket, count(*) AS n, round(avg(d), 6) AS delta FROM p GROUP BY ALL")
def hops_heterogeneity(spark, sf):
    p = _paired(spark, sf).na.drop()
    return p.groupBy("dataset", E.hop_bucket(F.col("question_id") % 5).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("treatment") - F.col("reference")), 6).alias("delta"))


@query(_RUNS_SQL + "SELECT dataset, method AS arm, CASE WHEN depth >= 4 THEN '4+' ELSE CAST(depth AS VARCHAR) END AS bucket, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok, round(avg(score), 6) AS mean_score FROM r GROUP BY ALL")
def depth_table(spark, sf):
    d = E.depth_table(_runs(spark, sf).withColumnRenamed("method", "arm"), ["score"])
    return d.select("dataset", "arm", "bucket", "n", "n_ok", F.round("mean_score", 6).alias("mean_score"))


@query(_WIDE_SQL + "SELECT dataset, question_id % 5 AS depth, count(*) AS n, round(avg(d), 6) AS treatment_minus_reference, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses FROM p GROUP BY ALL")
def paired_deltas(spark, sf):
    r = _scores(spark, sf).withColumnRenamed("method", "arm").withColumn("depth", F.col("question_id") % 5)
    return E.paired_deltas(r, "click", "view").withColumn("treatment_minus_reference", V.rounded(F.col("treatment_minus_reference"), 6))


@query(_WIDE_SQL + "SELECT dataset, count(*) FILTER (ref >= 0.5 AND trt >= 0.5) AS both_right, count(*) FILTER (ref < 0.5 AND trt < 0.5) AS both_wrong, count(*) FILTER (ref >= 0.5 AND trt < 0.5) AS only_a, count(*) FILTER (ref < 0.5 AND trt >= 0.5) AS only_b, round((count(*) FILTER (ref < 0.5 AND trt >= 0.5) + 0.5) / (count(*) FILTER (ref >= 0.5 AND trt < 0.5) + 0.5), 6) AS odds_ratio FROM p GROUP BY dataset")
def concordance(spark, sf):
    p = _paired(spark, sf).na.drop().select("dataset", (F.col("reference") >= 0.5).alias("a"), (F.col("treatment") >= 0.5).alias("b"))
    return E.concordance(p).withColumn("odds_ratio", F.round("odds_ratio", 6))


@query(_WIDE_SQL + "SELECT dataset, round(avg(d) FILTER (question_id % 5 >= 2), 6) AS ate, round(avg(CASE WHEN question_id % 5 >= 2 THEN 1.0 ELSE 0 END), 6) AS prevalence FROM p GROUP BY dataset")
def population_effect(spark, sf):
    p = _paired(spark, sf).na.drop().select("dataset", (F.col("question_id") % 5 >= 2).alias("eligible"), (F.col("treatment") - F.col("reference")).alias("effect"))
    return E.population_effect(p).select("dataset", F.round("ate", 6).alias("ate"), F.round("prevalence", 6).alias("prevalence"))


@query(_WIDE_SQL + "SELECT dataset, count(*) FILTER (ref IS NOT NULL AND trt IS NOT NULL) AS paired, count(*) FILTER (trt IS NULL AND ref IS NOT NULL) AS without_treatment, count(*) FILTER (ref IS NULL AND trt IS NOT NULL) AS without_reference FROM w WHERE ref IS NOT NULL OR trt IS NOT NULL GROUP BY dataset")
def pairing_gaps(spark, sf):
    return E.pairing_gaps(_paired(spark, sf))


@query(_LISTS_SQL + """, x AS (SELECT query_id, list(pos) AS ids FROM la GROUP BY 1), y AS (SELECT query_id, list(pos) AS ids FROM lb WHERE rank <= 3 GROUP BY 1)
SELECT x.query_id, CASE WHEN len(list_intersect(x.ids, y.ids)) = 0 THEN 'RETRIEVAL_MISS' WHEN len(list_filter(y.ids, lambda u: NOT list_contains(x.ids, u))) > 0 THEN 'EVIDENCE_PARTIAL' ELSE 'ANSWER_GENERATION_ERROR' END AS error FROM x JOIN y ON x.query_id = y.query_id""")
def error_classes(spark, sf):
    a, b = _lists(spark, sf)
    x, y = a.groupBy("query_id").agg(F.collect_list("pos").alias("r")), b.filter("rank <= 3").groupBy("query_id").agg(F.collect_list("pos").alias("g"))
    return x.join(y, "query_id").select("query_id", E.error_class(F.col("r"), F.col("g"), F.col("r"), F.lit(False)).alias("error"))


# ---- statistics -----------------------------------------------------------------------------


@query(_WIDE_SQL + """SELECT dataset, count(*) AS n, round(avg(d), 6) AS treatment_minus_reference, round(median(d), 6) AS median_difference, count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (abs(d) <= 1e-9) AS ties, count(*) FILTER (d < -1e-9) AS losses,
 round((count(*) FILTER (d > 1e-9) - count(*) FILTER (d < -1e-9)) / count(*), 6) AS paired_delta, round(avg(d) / stddev_samp(d), 6) AS cohens_d FROM p GROUP BY dataset""")
def paired_summary(spark, sf):
    s = stats.paired_summary(_paired(spark, sf).na.drop(), ["dataset"])
    return s.select("dataset", "n", "wins", "ties", "losses", *[F.round(c, 6).alias(c) for c in ("treatment_minus_reference", "median_difference", "paired_delta", "cohens_d")])


@query(_WIDE_SQL + ", k AS (SELECT dataset, count(*) FILTER (trt >= 0.5 AND ref < 0.5) AS b, count(*) FILTER (trt < 0.5 AND ref >= 0.5) AS c, count(*) AS n FROM p GROUP BY 1) SELECT dataset, b, c, n, b + c AS discordant, round(CASE WHEN b + c = 0 THEN 0 ELSE greatest(abs(b - c) - 1, 0) ** 2 / (b + c) END, 6) AS chi_square FROM k")
def mcnemar_counts(spark, sf):
    return stats.mcnemar_counts(_paired(spark, sf).na.drop(), ["dataset"]).withColumn("chi_square", F.round("chi_square", 6))


@query(_SCORES_SQL + """, h AS (SELECT dataset, method, round(abs(avg(score) - 0.5) / 10, 9) AS p FROM m GROUP BY ALL), o AS (SELECT *, count(*) OVER (PARTITION BY dataset) AS k, row_number() OVER (PARTITION BY dataset ORDER BY p) AS r FROM h)
SELECT dataset, method, round(p, 6) AS p_value, round(max(least(p * (k - r + 1), 1)) OVER (PARTITION BY dataset ORDER BY r), 6) AS p_holm FROM o""")
def holm(spark, sf):
    h = _scores(spark, sf).groupBy("dataset", "method").agg(F.round(F.abs(F.avg("score") - 0.5) / 10, 9).alias("p_value"))
    return stats.holm(h, family=["dataset"]).select("dataset", "method", F.round("p_value", 6).alias("p_value"), F.round("p_holm", 6).alias("p_holm"))


_FACTORIAL_SQL = """
WITH m AS (SELECT 'd' || (user_id % 3) AS dataset, user_id // 3 AS question_id, CASE event_type WHEN 'view' THEN 'a' ELSE 'b' END || (event_id % 3) AS cell, value FROM events WHERE event_type IN ('view', 'click')),
 w AS (SELECT dataset, question_id, avg(value) FILTER (cell = 'a0') AS a0, avg(value) FILTER (cell = 'a1') AS a1, avg(value) FILTER (cell = 'a2') AS a2, avg(value) FILTER (cell = 'b0') AS b0, avg(value) FILTER (cell = 'b1') AS b1, avg(value) FILTER (cell = 'b2') AS b2 FROM m GROUP BY ALL),
 c AS (SELECT * FROM w WHERE a0 + a1 + a2 + b0 + b1 + b2 IS NOT NULL)
SELECT dataset, count(*) AS n, round(avg((b0 + b1 + b2 - a0 - a1 - a2) / 3), 4) AS main_a, round(avg((a1 - a0 + b1 - b0) / 2), 4) AS mid_over_low, round(avg((a2 - a0 + b2 - b0) / 2), 4) AS high_over_low, round(avg(b1 - b0 - a1 + a0), 4) AS interaction_mid, round(avg(b2 - b0 - a2 + a0), 4) AS interaction_high FROM c GROUP BY dataset
"""


@query(_FACTORIAL_SQL)
def factorial_contrasts(spark, sf):
    e = table(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
    cell = F.concat(F.when(F.col("event_type") == "view", "a").otherwise("b"), (F.col("event_id") % 3).cast("string"))
    rows = e.select(F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("dataset"), F.floor(F.col("user_id") / 3).alias("question_id"), cell.alias("method"), F.col("value").alias("score"))
    names = ["main_a", "mid_over_low", "high_over_low", "interaction_mid", "interaction_high"]
    c = stats.factorial(rows, ["a0", "a1", "a2", "b0", "b1", "b2"])
    return c.groupBy("dataset").agg(F.count("*").alias("n"), *[F.round(F.avg(n), 4).alias(n) for n in names])


@query(_WIDE_SQL + ", z AS (SELECT dataset, round(d, 4) AS d FROM p WHERE round(d, 4) <> 0), k AS (SELECT dataset, d, rank() OVER (PARTITION BY dataset ORDER BY abs(d)) + (count(*) OVER (PARTITION BY dataset, abs(d)) - 1) / 2.0 AS r FROM z) SELECT dataset, count(*) AS n, round(coalesce(sum(r) FILTER (d > 0), 0), 6) AS w_plus FROM k GROUP BY dataset")
def wilcoxon(spark, sf):
    p = _paired(spark, sf).na.drop().select("dataset", F.lit(0.0).alias("reference"), F.round(F.col("treatment") - F.col("reference"), 4).alias("treatment"))
    return stats.wilcoxon(p, ["dataset"]).select("dataset", "n", F.round(F.col("w_plus").cast("double"), 6).alias("w_plus"))


# ---- samples --------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n - 1) OVER () AS free, 50 - count(*) OVER () AS left_ FROM c), e AS (SELECT *, left_ * (n - 1) / free AS x FROM t),
 f AS (SELECT *, floor(x) AS part, left_ - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS r FROM e)
SELECT stratum, n, CAST(1 + part + CASE WHEN r <= rest THEN 1 ELSE 0 END AS BIGINT) AS quota FROM f
""")
def quotas(spark, sf):
    return E.quotas(table(spark, sf, "documents").groupBy(F.col("lang").alias("stratum")).agg(F.count("*").alias("n")), 50)


@query("""
WITH c AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n - 1) OVER () AS free, 50 - count(*) OVER () AS left_ FROM c), e AS (SELECT *, left_ * (n - 1) / free AS x FROM t),
 f AS (SELECT *, floor(x) AS part, left_ - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS r FROM e),
 q AS (SELECT stratum, 1 + part + CASE WHEN r <= rest THEN 1 ELSE 0 END AS quota FROM f),
 s AS (SELECT doc_id, lang AS stratum, sha256('7:docs:' || doc_id) AS place, row_number() OVER (PARTITION BY lang ORDER BY sha256('7:docs:' || doc_id), doc_id) AS rn FROM documents)
SELECT doc_id, s.stratum, place FROM s JOIN q ON s.stratum = q.stratum WHERE rn <= quota
""")
def stratified_sample(spark, sf):
    return E.stratified_sample(table(spark, sf, "documents"), "doc_id", "lang", 50, 7, "docs")


@query("""
WITH a AS (SELECT p_partkey, p_type, sha256('3:parts:' || p_partkey) AS place, row_number() OVER (PARTITION BY p_type ORDER BY sha256('3:parts:' || p_partkey), p_partkey) AS rn FROM part), d AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a WHERE rn <= 4)),
 c AS (SELECT p_type AS stratum, count(*) AS n FROM d GROUP BY 1), t AS (SELECT *, sum(n - 1) OVER () AS free, 30 - count(*) OVER () AS left_ FROM c), e AS (SELECT *, left_ * (n - 1) / free AS x FROM t),
 f AS (SELECT *, floor(x) AS part, left_ - sum(floor(x)) OVER () AS rest, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS r FROM e),
 q AS (SELECT stratum, 1 + part + CASE WHEN r <= rest THEN 1 ELSE 0 END AS quota FROM f),
 s AS (SELECT p_partkey, p_type AS stratum, sha256('4:parts:' || p_partkey) AS place, row_number() OVER (PARTITION BY p_type ORDER BY sha256('4:parts:' || p_partkey), p_partkey) AS rn FROM d)
SELECT p_partkey, s.stratum, place FROM s JOIN q ON s.stratum = q.stratum WHERE rn <= quota
""")
def disjoint_sample(spark, sf):
    """A second sample of parts that leaves out the first four of each type."""
    p = table(spark, sf, "part")
    first = E.sample_place(3, "parts", F.col("p_partkey"))
    taken = p.select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(first, "p_partkey")).alias("rn")).filter("rn <= 4")
    return E.disjoint_sample(p, taken, "p_partkey", "p_type", 30, 4, "parts")


@query("SELECT o_orderkey, CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0 < 0.2 AS held_out FROM orders")
def stable_holdout(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", (E.holdout_share(F.col("o_orderkey")) < 0.2).alias("held_out"))


@query("""
WITH h AS (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS s FROM documents)
SELECT doc_id, list_reduce(list_prepend(CAST(0 AS BIGINT), [CAST(position(c IN '0123456789abcdef') - 1 AS BIGINT) for c in string_split(s, '')]), lambda acc, d: (acc * 16 + d) % 5) AS fold FROM h
""")
def fold_ids(spark, sf):
    return table(spark, sf, "documents").select("doc_id", E.fold_of(F.col("doc_id"), 5).alias("fold"))


@query("WITH u AS (SELECT doc_id, CAST('0x' || substr(sha256('3:' || doc_id), 1, 16) AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.6 THEN 'development' WHEN u < 0.8 THEN 'validation' ELSE 'test' END AS part FROM u")
def split_sets(spark, sf):
    return E.split_sets(table(spark, sf, "documents"), "doc_id", 3, (0.6, 0.2))


@query("SELECT count(*) AS rows, count(DISTINCT l.doc_id) AS distinct_keys, count(*) FILTER (d.doc_id IS NULL) AS strays FROM labels AS l LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'en') AS d ON l.doc_id = d.doc_id")
def sample_audit(spark, sf):
    return E.sample_audit(table(spark, sf, "labels"), table(spark, sf, "documents").filter("lang = 'en'"), "doc_id")


@query("SELECT o_custkey, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return E.duplicate_keys(table(spark, sf, "orders"), ["o_custkey"])


# ---- policies -------------------------------------------------------------------------------

_BEAM_SQL = """
WITH b AS (SELECT l_orderkey AS query_id, CAST(l_suppkey % 7 AS VARCHAR) AS source_id, l_discount * 10 AS confidence, l_returnflag AS flag, CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE l_linestatus END AS state FROM lineitem),
 c AS (SELECT *, count(*) OVER (PARTITION BY query_id, source_id) AS k FROM b),
 s AS (SELECT *, 0.55 * confidence + 0.25 * (1 + CASE WHEN state <> '' THEN 1 ELSE 0 END) / 2.0 + 0.10 / k - 0.05 * (k - 1) / k - 0.05 / (1 + CASE WHEN state <> '' THEN 1 ELSE 0 END) AS score FROM c),
 o AS (SELECT *, row_number() OVER (PARTITION BY query_id, flag, state ORDER BY round(score, 12) DESC, confidence DESC, source_id DESC, flag, state) AS n FROM s),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, confidence DESC, source_id DESC, flag, state) AS rank FROM o WHERE n = 1),
 g AS (SELECT *, max(CASE WHEN rank = 1 THEN confidence END) OVER w AS c1, coalesce(max(CASE WHEN rank = 2 THEN confidence END) OVER w, max(CASE WHEN rank = 1 THEN confidence END) OVER w) AS c2, max(rank) OVER w AS m FROM r WINDOW w AS (PARTITION BY query_id)),
 u AS (SELECT *, greatest(0, least(1, 1 - greatest(c1 - c2, 0))) AS doubt, least(4, m) AS cap FROM g)
SELECT query_id, flag, state, rank AS beam_rank, round(score, 6) AS beam_score FROM u WHERE rank <= CASE WHEN doubt >= 0.75 THEN cap WHEN doubt >= 0.45 THEN least(cap, 2) ELSE least(cap, 1) END
"""


@query(_BEAM_SQL)
def binding_beam(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.col("l_suppkey") % 7).cast("string").alias("_source_id"), (F.col("l_discount") * 10).alias("_confidence"), F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") % 4 == 0, "").otherwise(F.col("l_linestatus")).alias("state"))
    b = policy.beam_select(policy.beam_candidates(li, ["flag", "state"]))
    return b.select("query_id", "flag", "state", F.col("beam_rank").cast("long").alias("beam_rank"), F.round("beam_score", 6).alias("beam_score"))


@query("SELECT doc_id, round(1 / (1 + exp(-(0.3 + 1.2 * (n_chars - 2000) / 1500.0 - 0.4 * (doc_id % 7 - 3) / 2.0))), 6) AS p, CASE WHEN 1 / (1 + exp(-(0.3 + 1.2 * (n_chars - 2000) / 1500.0 - 0.4 * (doc_id % 7 - 3) / 2.0))) >= 0.5 THEN 'SUFFICIENT' WHEN 1 / (1 + exp(-(0.3 + 1.2 * (n_chars - 2000) / 1500.0 - 0.4 * (doc_id % 7 - 3) / 2.0))) >= 0.25 THEN 'PARTIAL' ELSE 'INSUFFICIENT' END AS status FROM documents")
def sufficiency_predict(spark, sf):
    model = policy.Calibrator(["n_chars", "k"], [2000.0, 3.0], [1500.0, 2.0], [1.2, -0.4], 0.3)
    d = table(spark, sf, "documents").withColumn("k", F.col("doc_id") % 7)
    p = model.probability()
    return d.select("doc_id", F.round(p, 6).alias("p"), model.status(p).alias("status"))


@query("""
WITH s AS (SELECT doc_id, (doc_id % 100) / 100.0 AS p, doc_id % 4 > 0 AS rows_, doc_id % 3 AS calls, (doc_id % 10) / 10.0 AS h FROM documents),
 c AS (SELECT doc_id, 'ANSWER' AS action, p AS gain, p - 0.0016 - 0.0075 AS u FROM s WHERE rows_ AND doc_id % 2 = 0
  UNION ALL SELECT doc_id, 'STOP_SLOT', p * CASE WHEN p >= 0.5 THEN 0.95 ELSE 0.8 END, p * CASE WHEN p >= 0.5 THEN 0.95 ELSE 0.8 END FROM s WHERE rows_
  UNION ALL SELECT doc_id, 'EXPAND_TOPK', least(1, p + (1 - p) * (0.35 + 0.35 * h)), least(1, p + (1 - p) * (0.35 + 0.35 * h)) - 0.08 - 0.0256 - 0.06 FROM s WHERE calls > 0
  UNION ALL SELECT doc_id, 'SWITCH_RETRIEVER', least(1, p + (1 - p) * (0.15 + 0.25 * (1 - h))), least(1, p + (1 - p) * (0.15 + 0.25 * (1 - h))) - 0.08 - 0.0064 - 0.045 FROM s WHERE calls > 0
  UNION ALL SELECT doc_id, 'ABSTAIN', 0.0, 0.0 FROM s)
SELECT doc_id, action, round(u, 6) AS utility FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(u, 12) DESC, gain DESC, action DESC) = 1
""")
def action_utility(spark, sf):
    d = table(spark, sf, "documents")
    p, h, no, yes = (F.col("doc_id") % 100) / 100.0, (F.col("doc_id") % 10) / 10.0, F.lit(False), F.lit(True)
    state = {"has_rows": F.col("doc_id") % 4 > 0, "answerable": F.col("doc_id") % 2 == 0, "calls_left": F.col("doc_id") % 3, "can_expand": yes, "can_question": no, "can_slot": no, "can_rewrite": no, "can_switch": yes, "can_beam": no, "can_backtrack": no}
    state |= {"score_entropy": h, "predicate_coverage": h, "bound_coverage": h, "agreement": h, "entity_coverage": h, "join_coverage": h, "sufficient": p >= 0.5}
    best = policy.choose_action(policy.action_candidates(p, state))
    return d.select("doc_id", best["action"].alias("action"), F.round(best["utility"], 6).alias("utility"))


@query("""
WITH o AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 2 WHEN event_type = 'click' THEN 1 ELSE 0 END) AS r FROM events GROUP BY 1)
SELECT user_id AS requirement_id, CASE greatest(r, user_id % 2) WHEN 0 THEN 'unresolved' WHEN 1 THEN 'partial' ELSE 'satisfied' END AS status, greatest(r, user_id % 2) > user_id % 2 AS advanced FROM o
""")
def state_transition(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("requirement_id"), F.when(F.col("event_type") == "purchase", 2).otherwise(0).alias("covered"), F.lit(2).alias("total"), (F.col("event_type") == "click").alias("any_evidence"))
    states = e.select("requirement_id").distinct().withColumn("status", F.when(F.col("requirement_id") % 2 == 1, "partial").otherwise("unresolved"))
    return policy.advance(states, e)


@query("""
WITH s AS (SELECT l.doc_id, l.quality AS y, least((d.n_chars % 100) / 100.0 + 0.005, 1) AS p FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id), b AS (SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS rate FROM s GROUP BY 1)
SELECT (SELECT count(*) FROM s) AS n, round((SELECT avg((p - y) ** 2) FROM s), 6) AS brier, round((SELECT sum(n * abs(mp - rate)) / sum(n) FROM b), 6) AS ece, (SELECT count(*) FROM s WHERE p >= 0.5 AND y = 1) AS tp, (SELECT count(*) FROM s WHERE p >= 0.5 AND y <> 1) AS fp
""")
def calibration_report(spark, sf):
    p = F.least((F.col("n_chars") % 100) / 100.0 + 0.005, F.lit(1.0))
    s = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select(F.col("quality").alias("label"), p.alias("p"))
    return policy.calibration_report(s)[0].select("n", F.round("brier", 6).alias("brier"), F.round("ece", 6).alias("ece"), "tp", "fp")


@query(r"""
WITH a AS (SELECT conv_id AS query_id, turn, role, trim(regexp_replace(regexp_replace(replace(lower(role), 'ß', 'ss'), '[^\p{L}\p{N}\s]', '', 'g'), '\s+', ' ', 'g')) AS norm FROM conversations), v AS (SELECT query_id, norm, count(*) AS votes, min(turn) AS first FROM a WHERE norm <> '' GROUP BY ALL)
SELECT query_id, norm AS answer, votes FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, first) = 1
""")
def majority_vote(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("answer"), F.col("turn").alias("pos"))
    return policy.majority_vote(c)


@query("SELECT conv_id AS query_id, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS answer FROM conversations GROUP BY 1")
def deterministic_answer(spark, sf):
    return policy.single_answer(table(spark, sf, "conversations").withColumnRenamed("conv_id", "query_id"), "role")


@query("""WITH p AS (SELECT user_id, CASE WHEN event_type = 'view' THEN 'yes' WHEN event_type = 'error' THEN 'no' END AS p FROM events)
SELECT user_id AS query_id, CASE WHEN min(p) = max(p) THEN min(p) END AS answer FROM p GROUP BY 1""")
def polar_consensus(spark, sf):
    said = F.when(F.col("event_type") == "view", "Yes, it is.").when(F.col("event_type") == "error", "False").otherwise("unsure")
    return policy.polar_consensus(table(spark, sf, "events").select(F.col("user_id").alias("query_id"), said.alias("v")), "v")


@query("SELECT user_id AS k, sum(value) AS total, max(value) AS peak, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1")
def merged_metrics(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("value").alias("total"), F.col("value").alias("peak"), F.col("event_type").alias("last_type"), F.col("event_id").alias("pos"))
    return policy.merge_metrics(e, "k", ["total"], ["peak"], [], ["last_type"])


# ---- plans ----------------------------------------------------------------------------------


def _relations(spark, sf) -> TableMaterializer:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    o = o.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return TableMaterializer({
        "OrderedBy": Relation(o, ["o_orderkey", "o_custkey"], "o_orderkey"),
        "OrderDate": Relation(o, ["o_orderkey", "day"], "o_orderkey"),
        "LivesIn": Relation(c, ["c_custkey", "c_nationkey"], "c_custkey"),
        "NationName": Relation(n, ["n_nationkey", "n_name"], "n_nationkey"),
    })


@query("SELECT CASE WHEN (SELECT o_orderdate::DATE FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)) < (SELECT o_orderdate::DATE FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders)) THEN 'low' ELSE 'high' END AS answer")
def plan_field_extremum(spark, sf):
    """Two branches of order dates, bridged by an extremum operator: searched order, budget, then execution."""
    low, high = table(spark, sf, "orders").agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    plan = SlotPlan(
        [Slot("S1", "OrderDate", [str(low), "?d1"], types={"d1": "date"}, cardinality=1), Slot("S2", "OrderDate", [str(high), "?d2"], types={"d2": "date"}, cardinality=1)],
        ["?answer"], operators=[Operator("field_argmin", fields=["d1", "d2"], labels=["low", "high"], output="answer")],
    )
    physical, _ = search(LogicalPlan.of(plan), SearchOptions(budget=4))
    return execute(plan, _relations(spark, sf), physical, budget=4, strategy="fixed").rows.select("answer")


@query("SELECT CAST(count(*) AS VARCHAR) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def plan_join_count(spark, sf):
    """A two-slot plan with sideways bindings and a count; contexts reduce the customer scan to one nation."""
    plan = SlotPlan([Slot("S1", "NationName", ["?nation", "NATION_7"], cardinality=1), Slot("S2", "LivesIn", ["?customer", "?nation"], cardinality=1000)], ["?n"], [Join("S1", "nation", "S2", "nation")], [Operator("count", output="n")])
    return execute(plan, _relations(spark, sf), budget=4).rows.select("n")
