"""Registered queries of run records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import records as R
from .queries import query, table

_FLAT_SQL = """
WITH m AS (SELECT o_orderkey AS record_id, o_orderstatus AS method, o_orderkey % 6 + 1 AS v, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 5 END AS hits, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 3 END AS misses, o_orderkey % 7 AS requests FROM orders),
 f AS (SELECT record_id, method, v AS schema_version, CAST(hits AS DOUBLE) AS cache_hits, CASE WHEN v >= 3 THEN CAST(requests AS DOUBLE) END AS materialization_requests, CASE WHEN v >= 5 THEN 0.0 END AS operator_rewrites,
  CASE WHEN hits + misses > 0 THEN hits / (hits + misses) END AS cache_hit_rate, CASE WHEN requests > 0 THEN 1.0 / requests END AS materialization_reuse_rate FROM m)
"""


def _flat(spark, sf):
    k = F.col("o_orderkey")
    count = lambda n: F.when(k % 4 == 0, 0).otherwise(k % n).cast("double")
    cells = {"cache_hits": count(5), "cache_misses": count(3), "materialization_requests": (k % 7).cast("double"), "materialization_cache_hits": F.lit(1.0)}
    pairs = [x for n, c in cells.items() for x in (F.lit(n), c)]
    r = table(spark, sf, "orders").select(k.alias("record_id"), F.col("o_orderstatus").alias("method"), (k % 6 + 1).alias("schema_version"), F.create_map(*pairs).alias("metrics"))
    return R.flat_records(r, ["cache_hits", "materialization_requests", "operator_rewrites"], {"materialization_requests": 3, "operator_rewrites": 5})


@query(_FLAT_SQL + "SELECT record_id, method, schema_version, cache_hits, coalesce(materialization_requests, -1) AS requests, coalesce(operator_rewrites, -1) AS rewrites, round(coalesce(cache_hit_rate, -1), 6) AS hit_rate, round(coalesce(materialization_reuse_rate, -1), 6) AS reuse_rate FROM f")
def flat_run_records(spark, sf):
    shown = lambda c, n: F.coalesce(c, F.lit(-1.0)).alias(n)
    return _flat(spark, sf).select("record_id", "method", "schema_version", "cache_hits", shown("materialization_requests", "requests"), shown("operator_rewrites", "rewrites"), F.round(F.coalesce("cache_hit_rate", F.lit(-1.0)), 6).alias("hit_rate"), F.round(F.coalesce("materialization_reuse_rate", F.lit(-1.0)), 6).alias("reuse_rate"))


@query(_FLAT_SQL + "SELECT method, count(*) AS records, round(avg(cache_hits), 6) AS cache_hits, round(avg(materialization_requests), 6) AS materialization_requests, round(avg(cache_hit_rate), 6) AS cache_hit_rate FROM f GROUP BY method")
def column_means(spark, sf):
    names = ["cache_hits", "materialization_requests", "cache_hit_rate"]
    return R.column_report(_flat(spark, sf), ["method"], names).select("method", "records", *[F.round(n, 6).alias(n) for n in names])


@query("""
WITH e AS (SELECT user_id, event_type, max(value) AS score, count(*) AS runs FROM events GROUP BY ALL)
SELECT user_id, max(score) FILTER (event_type = 'view') AS score_view, max(runs) FILTER (event_type = 'view') AS runs_view, max(score) FILTER (event_type = 'click') AS score_click, max(runs) FILTER (event_type = 'click') AS runs_click,
 max(score) FILTER (event_type = 'purchase') AS score_purchase, max(runs) FILTER (event_type = 'purchase') AS runs_purchase FROM e WHERE event_type IN ('view', 'click', 'purchase') GROUP BY user_id HAVING count(*) = 3
""")
def arms_merged(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("score"), F.count("*").alias("runs"))
    return R.arms_side_by_side(e, ["user_id"], "event_type", ["view", "click", "purchase"], ["score", "runs"])


@query("""
WITH a AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS low, max(l_linenumber) AS high FROM lineitem WHERE (l_orderkey + l_linenumber) % 11 > 0 GROUP BY 1)
SELECT o_orderkey, coalesce(n, 0) AS attempts, coalesce(low = 1 AND high = n AND d = n AND o_orderkey % 4 + 1 <= high, FALSE) AS contiguous FROM orders LEFT JOIN a ON l_orderkey = o_orderkey
""")
def attempt_audit(spark, sf):
    a = table(spark, sf, "lineitem").filter((F.col("l_orderkey") + F.col("l_linenumber")) % 11 > 0).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("attempt"))
    return R.attempt_gaps(a, table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4 + 1).alias("attempt_index")), ["o_orderkey"])


@query("""
WITH s AS (SELECT source, lang AS s, count(*) AS n, count(*) FILTER (n_chars < 500) AS bad, sum(CAST('0x' || substr(md5(coalesce(text, '')), 1, 8) AS BIGINT)) AS c FROM documents GROUP BY ALL)
SELECT source, sum(n)::BIGINT AS records, sum(bad)::BIGINT AS invalid_records, sum(c)::BIGINT AS checksum, string_agg(coalesce(s, '-') || '=' || n, ' ' ORDER BY s NULLS FIRST) AS strata FROM s GROUP BY source
""")
def dataset_audit(spark, sf):
    d = R.dataset_audit(table(spark, sf, "documents"), ["source"], F.col("lang"), F.col("n_chars") >= 500, F.col("text"))
    text = F.transform("strata", lambda x: F.concat(F.coalesce(x["stratum"], F.lit("-")), F.lit("="), x["n"].cast("string")))
    return d.select("source", "records", "invalid_records", "checksum", F.concat_ws(" ", text).alias("strata"))
