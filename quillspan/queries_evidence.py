"""Registered queries of candidates, access paths, sufficiency features and policies, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluate as E
from .operators import evidence as V
from .operators import policy
from .operators import sufficiency as S
from .queries import _LISTS_SQL, _lists, query, table

# ---- sufficiency ----------------------------------------------------------------------------

_CASES_SQL = _LISTS_SQL + """
, x AS (SELECT query_id, pos, 'p' || pos AS pid, a, b, coalesce(a, 0) / 50 + coalesce(b, 0) / 100 AS s, CASE WHEN query_id % 3 = 0 THEN coalesce(b, 0) - coalesce(a, 0) END AS r
  FROM (SELECT query_id, pos, score AS a FROM la) FULL JOIN (SELECT query_id, pos, score AS b FROM lb) USING (query_id, pos)),
 y AS (SELECT *, coalesce(r, s) AS e, CASE WHEN query_id % 2 = 1 THEN a ELSE coalesce(r, s) END AS k FROM x),
 z AS (SELECT *, k - min(k) OVER q AS sh, exp(greatest(e - max(e) OVER q, -50)) AS w, row_number() OVER (PARTITION BY query_id, k IS NULL ORDER BY pos) AS place,
   CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN row_number() OVER (PARTITION BY query_id, a IS NULL OR b IS NULL ORDER BY a DESC, pid) - row_number() OVER (PARTITION BY query_id, a IS NULL OR b IS NULL ORDER BY b DESC, pid) END AS d,
   row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pid) - row_number() OVER (PARTITION BY query_id ORDER BY r DESC, pid) AS dr FROM y WINDOW q AS (PARTITION BY query_id)),
 f AS (SELECT *, CASE WHEN k IS NULL THEN NULL WHEN sum(sh) OVER q <= 1e-12 THEN 1.0 / count(k) OVER q ELSE sh / sum(sh) OVER q END AS mass, w / sum(w) OVER q AS soft FROM z WINDOW q AS (PARTITION BY query_id)),
 per AS (SELECT query_id, count(*) AS n, count(k) AS nk, max(e) AS top, avg(e) AS mean, min(e) AS low, list(e ORDER BY e DESC) AS es, sum(CASE WHEN soft > 0 THEN -soft * ln(soft) ELSE 0 END) AS h, max(k) AS ktop, min(k) AS klow, list(k ORDER BY k DESC) FILTER (k IS NOT NULL) AS ks,
   max(mass) AS share, sum(CASE WHEN mass > 0 THEN -mass * ln(mass) ELSE 0 END) AS kh, quantile_cont(k, 0.25) AS q1, quantile_cont(k, 0.5) AS q2, quantile_cont(k, 0.75) AS q3, sum(mass / log2(place + 1)) AS discounted, sum(d * d) AS d2, count(d) AS nd, sum(dr * dr) AS dr2, count(DISTINCT pos % 20) AS docs FROM f GROUP BY query_id),
 t AS (SELECT query_id, count(*) AS m, avg(CASE WHEN pos % 5 <> 0 THEN 1.0 ELSE 0 END) AS valid, avg(CASE WHEN query_id % 4 = 0 THEN 1.0 WHEN pos % 4 <> 0 THEN 1.0 ELSE 0.5 END) AS filled, avg((pos % 10) / 10.0) AS confidence, bool_or(pos % 4 <> 0) AS sized, max(pos) AS last FROM lb WHERE rank <= 3 GROUP BY 1)
"""


def _agree(d2: str, n: str) -> str:
    return f"CASE WHEN {n} < 2 THEN 1.0 ELSE least(1.0, greatest(0.0, 1 - 3.0 * {d2} / ({n} * ({n} * {n} - 1)))) END"


_FEATURES_SQL = {
    "top1_score": "top", "topk_score": "mean", "topk_min_score": "low", "top1_top2_margin": "top - coalesce(es[2], top)", "score_entropy": "CASE WHEN n > 1 THEN h / ln(n) ELSE 0 END",
    "backend_top1_score": "ktop", "backend_top1_top2_margin": "ktop - coalesce(ks[2], ktop)", "backend_margin_ratio": "least(2.0, (ktop - coalesce(ks[2], ktop)) / greatest(abs(ktop), abs(coalesce(ks[2], ktop)), 1e-12))", "backend_top1_share": "share",
    "backend_relative_entropy": "CASE WHEN nk > 1 THEN least(1.0, kh / ln(nk)) ELSE 0 END", "backend_score_iqr_ratio": "CASE WHEN ktop - klow > 1e-12 THEN (q3 - q1) / (ktop - klow) ELSE 0 END",
    "backend_top1_robust_zscore": "CASE WHEN ktop - klow <= 1e-12 THEN 0 ELSE least(20.0, (ktop - q2) / CASE WHEN q3 - q1 > 1e-12 THEN q3 - q1 ELSE ktop - klow END) END", "backend_rank_discounted_mass": "least(1.0, discounted)",
    "score_source_bm25": "CAST(query_id % 2 = 1 AS INT)", "score_source_dense": "0", "score_source_reranker": "CAST(query_id % 6 = 0 AS INT)", "score_source_fused": "CAST(query_id % 6 IN (2, 4) AS INT)",
    "sparse_dense_agreement": _agree("coalesce(d2, 0)", "nd"), "reranker_agreement": f"CASE WHEN query_id % 3 = 0 THEN {_agree('dr2', 'n')} ELSE 1.0 END", "new_entity_coverage": "CASE WHEN query_id % 4 = 0 OR sized THEN 1.0 ELSE 0.5 END",
    "source_diversity": "docs / n", "predicate_coverage": "0.5", "bound_variable_coverage": "CASE WHEN query_id % 5 = 0 THEN 1.0 ELSE 0.5 END", "join_edge_coverage": "CASE WHEN query_id % 2 = 1 OR last % 3 <> 0 THEN 1.0 ELSE 0.0 END", "extraction_consistency": "valid * filled * confidence",
    "row_count": "m", "remaining_plan_depth": "query_id % 3", "budget_remaining": "greatest(4 - query_id % 6, 0)", "budget_fraction": "greatest(4 - query_id % 6, 0) / 4.0", "retrieval_count": "n",
}


# a hair is added on both sides, so that values that end in a half unit are rounded alike by both engines
@query(_CASES_SQL + "SELECT query_id, " + ", ".join(f"round(CAST({v} AS DOUBLE) + 1e-10, 6) AS {k}" for k, v in _FEATURES_SQL.items()) + " FROM per JOIN t USING (query_id)")
def sufficiency_features(spark, sf):
    a, b = _lists(spark, sf)
    q, pos = F.col("query_id"), F.col("pos")
    x = a.select("query_id", "pos", F.col("score").alias("bm25_score")).join(b.select("query_id", "pos", F.col("score").alias("dense_score")), ["query_id", "pos"], "full_outer")
    sparse, dense = F.coalesce("bm25_score", F.lit(0.0)), F.coalesce("dense_score", F.lit(0.0))
    number = pos.cast("string")
    results = x.select(
        "query_id", "pos", F.concat(F.lit("p"), number).alias("passage_id"), F.concat(F.lit("d"), (pos % 20).cast("string")).alias("doc_id"), F.concat(F.lit("Item "), number, F.lit(", size: "), (pos % 7).cast("string")).alias("text"),
        (sparse / 50 + dense / 100).alias("score"), "bm25_score", "dense_score", F.when(q % 3 == 0, dense - sparse).alias("rerank_score"),
    )
    named = F.concat(F.when(pos % 3 == 0, "Thing ").otherwise("Item "), number)
    rows = b.filter("rank <= 3").select(
        "query_id", "pos", F.when(pos % 5 == 0, "elsewhere").otherwise(F.concat(F.lit("p"), number)).alias("source_id"), F.create_map(F.lit("?part"), named, F.lit("size"), F.when(pos % 4 == 0, " ").otherwise((pos % 7).cast("string"))).alias("bindings"), ((pos % 10) / 10.0).alias("confidence")
    )
    none = F.array().cast("array<string>")
    contexts = b.select("query_id").distinct().select(
        "query_id", F.lit("item_of").alias("predicate"), F.when(q % 4 == 0, none).otherwise(F.array(F.lit("?part"), F.lit("size"))).alias("requested"), F.when(q % 2 == 1, none).otherwise(F.array(F.lit("part"))).alias("join_variables"),
        F.when(q % 5 == 0, none).otherwise(F.array(F.lit("ITEM"), F.lit("zebra"))).alias("bound"), F.when(q % 2 == 1, "bm25").otherwise("hybrid").alias("backend"), F.lit(4).alias("call_budget"), (q % 6).alias("calls_used"), (q % 3).alias("remaining_depth"),
    )
    out = S.features(contexts, results, rows)
    return out.select("query_id", *[F.round(F.col(c).cast("double") + 1e-10, 6).alias(c) for c in S.FEATURES])


@query("""
WITH g AS (SELECT l_orderkey AS query_id, count(*) AS row_count, avg(round(l_discount * 100) / 16) AS c, max(CASE WHEN l_linenumber % 2 = 0 THEN l_tax * 10 END) AS best FROM lineitem GROUP BY 1)
SELECT query_id, row_count, round(least(1.0, 0.7 * c + 0.3 * coalesce(best, c)), 9) AS probability, CASE WHEN c >= 0.5 THEN 'SUFFICIENT' ELSE 'PARTIAL' END AS status FROM g
""")
def runtime_proxy(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), (F.round(F.col("l_discount") * 100) / 16).cast("double").alias("_confidence"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_tax") * 10).cast("double").alias("_retrieval_score"))
    return S.runtime_proxy(li, 0).select("query_id", "row_count", F.round("probability", 9).alias("probability"), "status")


_QUALITY = "CASE {a} WHEN 'ANSWER' THEN (doc_id % 100) / 100.0 WHEN 'EXPAND_TOPK' THEN (doc_id % 7) / 7.0 WHEN 'STOP_SLOT' THEN (doc_id % 5) / 10.0 ELSE 0.0 END"


@query(f"""
WITH s AS (SELECT doc_id, doc_id % 4 > 0 AS has_rows, doc_id % 2 = 0 AS answerable, doc_id % 3 > 0 AS paid, (doc_id % 100) / 100.0 >= 0.5 AS enough FROM documents),
 c AS (SELECT *, unnest(['ANSWER', 'STOP_SLOT', 'EXPAND_TOPK', 'ABSTAIN']) AS action FROM s),
 o AS (SELECT doc_id, action FROM (SELECT *, {_QUALITY.format(a='action')} AS q, CASE WHEN action = 'EXPAND_TOPK' THEN 1 ELSE 0 END AS k FROM c
   WHERE action = 'ABSTAIN' OR (action = 'ANSWER' AND answerable AND has_rows) OR (action = 'STOP_SLOT' AND has_rows) OR (action = 'EXPAND_TOPK' AND paid)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY q DESC, k, action DESC) = 1),
 p AS (SELECT doc_id, 'rule' AS policy, CASE WHEN answerable AND has_rows AND enough THEN 'ANSWER' WHEN paid THEN 'EXPAND_TOPK' WHEN has_rows THEN 'STOP_SLOT' ELSE 'ABSTAIN' END AS action FROM s
  UNION ALL SELECT doc_id, 'fixed_topk', CASE WHEN answerable AND has_rows THEN 'ANSWER' WHEN paid THEN 'EXPAND_TOPK' WHEN has_rows THEN 'STOP_SLOT' ELSE 'ABSTAIN' END FROM s
  UNION ALL SELECT doc_id, 'legacy', CASE WHEN answerable AND has_rows THEN 'ANSWER' WHEN paid THEN 'RETRIEVE_SLOT_ONLY' ELSE 'ABSTAIN' END FROM s UNION ALL SELECT doc_id, 'oracle', action FROM o),
 r AS (SELECT p.policy, p.action, o.action AS best_action, {_QUALITY.format(a='p.action')} AS q, greatest((doc_id % 100) / 100.0, (doc_id % 7) / 7.0, (doc_id % 5) / 10.0) AS best, (doc_id % 5) / 10.0 AS base FROM p JOIN o USING (doc_id))
SELECT policy, count(*) AS examples, round(avg(CASE WHEN action = best_action THEN 1.0 ELSE 0 END), 6) AS action_accuracy, round(avg(q), 6) AS mean_quality, round(avg(best - q), 6) AS mean_regret, round(avg(CASE WHEN action = 'EXPAND_TOPK' THEN 1.0 ELSE 0 END), 6) AS mean_calls,
 count(*) FILTER (round(q - base, 9) > 0) AS gains, count(*) FILTER (round(q - base, 9) = 0) AS ties, count(*) FILTER (round(q - base, 9) < 0) AS losses FROM r GROUP BY policy
""")
def policy_evaluation(spark, sf):
    i = F.col("doc_id")
    p, no, half = (i % 100) / 100.0, F.lit(False), F.lit(0.5)
    state = {"has_rows": i % 4 > 0, "answerable": i % 2 == 0, "calls_left": i % 3, "can_expand": F.lit(True), "sufficient": p >= 0.5} | dict.fromkeys(("can_question", "can_slot", "can_rewrite", "can_switch", "can_beam", "can_backtrack"), no)
    state |= dict.fromkeys(("score_entropy", "predicate_coverage", "bound_coverage", "agreement", "entity_coverage", "join_coverage"), half)
    quality = F.create_map(F.lit("ANSWER"), F.round(p, 9), F.lit("EXPAND_TOPK"), F.round((i % 7) / 7.0, 9), F.lit("STOP_SLOT"), F.round((i % 5) / 10.0, 9))
    d = table(spark, sf, "documents").select("doc_id", policy.action_candidates(p, state).alias("candidates"), quality.alias("quality"))
    chosen = F.array(*[F.struct(F.lit(n).alias("policy"), S.decide(n, F.col("candidates"), state, F.col("quality")).alias("choice")) for n in ("rule", "fixed_topk", "legacy", "oracle")])
    best = S.decide("oracle", F.col("candidates"), state, F.col("quality"))["action"]
    each = d.select("quality", best.alias("oracle_action"), F.lit("STOP_SLOT").alias("baseline_action"), F.inline(chosen))
    out = S.policy_report(each, ["policy"])
    return out.select("policy", "examples", *[F.round(c, 6).alias(c) for c in ("action_accuracy", "mean_quality", "mean_regret", "mean_calls")], "gains", "ties", "losses")


# ---- candidates and paths -------------------------------------------------------------------


@query(_LISTS_SQL + """, c AS (SELECT query_id, pos AS id, min(rank) AS pos FROM (SELECT * FROM la UNION ALL SELECT query_id, pos, score, rank + 20 FROM lb) WHERE pos > 0 GROUP BY ALL)
SELECT query_id, 'p' || id AS source_id, c.pos, p_partkey IS NOT NULL AS found, coalesce(CASE WHEN p_partkey IS NOT NULL THEN s.rank END, 0) AS place, coalesce(p_name, '') AS p_name
FROM c LEFT JOIN (SELECT * FROM part WHERE p_partkey % 7 <> 0) ON p_partkey = id LEFT JOIN (SELECT query_id, pos AS id, rank FROM lb WHERE rank <= 5) AS s USING (query_id, id)""")
def candidate_lookup(spark, sf):
    a, b = _lists(spark, sf)
    sid = F.when(F.col("pos") > 0, F.concat(F.lit("p"), F.col("pos").cast("string"))).otherwise("")
    pool = a.select("query_id", "rank", sid.alias("source_id")).unionByName(b.select("query_id", (F.col("rank") + 20).alias("rank"), sid.alias("source_id"))).withColumnRenamed("rank", "pos")
    chosen = b.filter("rank <= 5").select("query_id", F.col("rank").alias("place"), sid.alias("source_id"))
    passages = table(spark, sf, "part").filter("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("source_id"), "p_name")
    return V.candidate_inventory(pool, chosen, passages).select("query_id", "source_id", "pos", "found", F.coalesce("place", F.lit(0)).alias("place"), F.coalesce("p_name", F.lit("")).alias("p_name"))


@query(_LISTS_SQL + """, x AS (SELECT query_id, list('p' || pos ORDER BY rank) AS l FROM la WHERE rank <= 5 GROUP BY 1), y AS (SELECT query_id, list('p' || pos ORDER BY rank) AS r FROM lb WHERE rank <= 5 GROUP BY 1),
 u AS (SELECT query_id, array_to_string(list_concat(l, list_filter(r, lambda i: NOT list_contains(l, i))), ' ') AS union_ids, array_to_string(list_sort(list_intersect(l, r)), ' ') AS overlap_ids FROM x JOIN y USING (query_id)),
 rec AS (SELECT query_id, avg(CASE WHEN list_contains(l, 'p' || pos) OR list_contains(r, 'p' || pos) THEN 1.0 ELSE 0 END) AS recall FROM la JOIN x USING (query_id) JOIN y USING (query_id) WHERE rank % 3 = 1 GROUP BY 1)
SELECT query_id, union_ids, overlap_ids, round(recall, 6) AS bundle_recall, round(recall - 0.25, 6) AS delta_recall, recall = 1 AS full_support, recall > 0 AS any_support FROM u JOIN rec USING (query_id)""")
def access_path_coverage(spark, sf):
    sid = F.concat(F.lit("p"), F.col("pos").cast("string")).alias("source_id")
    a, b = (x.select("query_id", "rank", sid) for x in _lists(spark, sf))
    u = V.path_coverage(a, b, 5)
    r = V.bundle_recall(u, a.filter("rank % 3 = 1"), u.select("query_id", F.lit(0.25).alias("recall")))
    return u.join(r, "query_id").select("query_id", F.concat_ws(" ", "union_ids").alias("union_ids"), F.concat_ws(" ", "overlap_ids").alias("overlap_ids"), F.round("bundle_recall", 6).alias("bundle_recall"), F.round("delta_recall", 6).alias("delta_recall"), "full_support", "any_support")


def _path_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("query_id"), (F.col("l_linenumber") % 2).alias("path"), F.col("l_linenumber").alias("pos"), (F.col("l_suppkey") % 3).cast("string").alias("source_id"), F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("line"), F.col("l_linestatus")).alias("bindings"))


@query("""
WITH r AS (SELECT l_orderkey AS query_id, l_linenumber % 2 AS path, l_linenumber AS pos, l_suppkey % 3 AS s, l_returnflag AS f, l_linestatus AS l FROM lineitem),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id, s, f, l ORDER BY path, pos) AS n FROM r)
SELECT query_id, count(*) AS before, count(*) FILTER (n = 1) AS after, sum(pos * (path + 1)) FILTER (n = 1)::BIGINT AS kept FROM k GROUP BY 1
""")
def path_merge(spark, sf):
    rows = _path_rows(spark, sf)
    kept = V.merge_paths(rows).groupBy("query_id").agg(F.sum(F.col("pos") * (F.col("path") + 1)).alias("kept"))
    return V.merge_counts(rows).join(kept, "query_id").select("query_id", "before", "after", "kept")


@query("""
WITH r AS (SELECT l_orderkey AS query_id, l_linenumber AS pos, 's' || l_linenumber % 2 AS slot_id, l_suppkey % 3 AS s, l_returnflag AS f, l_linestatus AS l FROM lineitem WHERE l_orderkey % 3 > 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY query_id, slot_id, s, f, l ORDER BY pos) AS n FROM r)
SELECT query_id, slot_id, CAST(s AS VARCHAR) AS source_id, pos FROM k WHERE n = 1
UNION ALL SELECT o_orderkey, 'retrieved', o_orderstatus, 0 FROM orders WHERE o_orderkey NOT IN (SELECT query_id FROM r)
""")
def evidence_records(spark, sf):
    rows = _path_rows(spark, sf).filter("query_id % 3 > 0").select("query_id", F.col("path").alias("step"), "pos", F.concat(F.lit("s"), F.col("path").cast("string")).alias("slot_id"), "source_id", F.lit("").alias("source_span"), "bindings")
    found = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.lit(0).alias("step"), F.lit(0).alias("pos"), F.lit("retrieved").alias("slot_id"), F.col("o_orderstatus").alias("source_id"), F.lit("").alias("source_span"))
    return V.distinct_evidence(rows, found).select("query_id", "slot_id", "source_id", "pos")


# ---- roles and summaries --------------------------------------------------------------------

_FIELDS = ["the mother", "son of", "capital", "female lead"]
_VALUES = ["Sir {}", "lady {}", "Mr. and Mrs. {}", "{}"]
_PREDICATES = ["country_of", "Nationality", "country of birth", "director"]


@query(f"""
SELECT c_custkey, {_FIELDS}[c_custkey % 4 + 1] AS field, CASE c_custkey % 4 WHEN 2 THEN NULL WHEN 1 THEN 'male' ELSE 'female' END AS gender,
 CASE c_custkey % 4 WHEN 2 THEN FALSE WHEN 1 THEN c_custkey // 4 % 4 = 1 ELSE c_custkey // 4 % 4 = 0 END AS conflict, c_custkey % 4 < 2 AS exact_window, c_custkey % 4 < 3 AS any_window FROM customer
""")
def role_rules(spark, sf):
    k = F.col("c_custkey")
    one = lambda names, i: F.get(F.array(*map(F.lit, names)), i.cast("int"))
    c = table(spark, sf, "customer").select("c_custkey", one(_FIELDS, k % 4).alias("field"), F.replace(one(_VALUES, F.floor(k / 4) % 4), F.lit("{}"), F.col("c_name")).alias("value"), one(_PREDICATES, k % 4).alias("predicate"))
    n = {x: T.ascii_words(F.col(x)) for x in ("field", "value", "predicate")}
    c = c.select("c_custkey", "field", n["field"].alias("f"), n["value"].alias("v"), n["predicate"].alias("p"))
    return c.select("c_custkey", "field", T.role_gender(F.col("f")).alias("gender"), T.role_conflict(F.col("f"), F.col("v")).alias("conflict"), T.uses_window(F.col("p")).alias("exact_window"), T.uses_window(F.col("p"), True).alias("any_window"))


@query("""
SELECT count(*) AS count, round(avg(CASE WHEN event_type = 'click' THEN value / 100 ELSE 0 END), 6) AS f1, round(avg(user_id % 5), 6) AS llm_calls FROM events
""")
def run_summary(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("event_type") == "click", F.col("value") / 100).alias("f1"), (F.col("user_id") % 5).alias("llm_calls"))
    return E.run_summary(e, ["f1", "llm_calls"]).select("count", F.round("f1", 6).alias("f1"), F.round("llm_calls", 6).alias("llm_calls"))


_CALLS = {"plain": {}, "dual": {"dual": True}, "unbound": {"dual": True, "unbound_only": True}, "single": {"bundle": True, "bound_single": True}}


@query("""
WITH s AS (SELECT count(*) FILTER (c_custkey % 3 = 0) AS b, count(*) AS n FROM customer)
SELECT 'plain' AS mode, n AS calls FROM s UNION ALL SELECT 'dual', 2 * n FROM s UNION ALL SELECT 'unbound', 2 * n - b FROM s UNION ALL SELECT 'single', 2 * n - b FROM s
""")
def retrieval_call_estimates(spark, sf):
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 3 == 0).alias("bound"))
    sums = c.agg(*[F.sum(V.retrieval_calls(F.col("bound"), True, **o)).alias(m) for m, o in _CALLS.items()])
    return reduce(lambda x, y: x.unionByName(y), [sums.select(F.lit(m).alias("mode"), F.col(m).alias("calls")) for m in _CALLS])
