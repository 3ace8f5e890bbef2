"""Registered queries of run audits and of the registry of exposed samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .operators import audits
from .queries import query, table
from .sources import registry
from .sources.scratch import scratch_root

_EVENTS_SQL = """
e AS (SELECT l_orderkey AS record, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS place, l_partkey % 97 = 0 AND place > 1 AS altered, l_suppkey % 31 = 0 AS lost FROM lineitem),
k AS (SELECT *, lag(place) OVER (PARTITION BY record ORDER BY place) AS before FROM e WHERE NOT lost),
b AS (SELECT record, place, CASE WHEN place <> coalesce(before, 0) + 1 THEN 'gap' WHEN altered THEN 'digest' END AS reason FROM k)
"""


def _breaks(spark, sf):
    """Chains over the lines of every order; some payloads are altered and some events lost after sealing."""
    cells = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.struct(*cells).alias("at"), F.concat_ws("|", *[F.col(c).cast("string") for c in cells]).alias("payload"))
    whole = audits.sealed(li, ["record"], "at", "payload")
    altered = F.when((F.col("at.l_partkey") % 97 == 0) & (F.col("place") > 1), F.concat("payload", F.lit("!"))).otherwise(F.col("payload"))
    return audits.chain_breaks(whole.filter("at.l_suppkey % 31 <> 0").withColumn("payload", altered), ["record"], "payload")


@query(f"WITH {_EVENTS_SQL} SELECT record, place, reason FROM b WHERE reason IS NOT NULL")
def trace_chain_breaks(spark, sf):
    return _breaks(spark, sf).select("record", F.col("place").cast("long").alias("place"), "reason")


@query(f"""
WITH {_EVENTS_SQL},
i AS (SELECT o_orderkey AS record, o_orderpriority AS dataset, o_orderstatus AS method, CASE WHEN o_custkey % 50 = 0 THEN 'question_timeout' WHEN o_custkey % 7 = 0 THEN 'empty' ELSE 'ok' END AS status FROM orders),
s AS (SELECT dataset, method, count(*) AS observed, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'question_timeout') AS timeouts, count(*) FILTER (record IN (SELECT record FROM b WHERE reason IS NOT NULL)) AS broken_traces FROM i GROUP BY ALL),
x AS (SELECT dataset, method, CASE WHEN method = 'F' THEN observed + 1 ELSE observed END AS expected FROM s WHERE NOT (method = 'P' AND dataset = '5-LOW') UNION ALL SELECT '5-LOW', 'Z', 9),
o AS (SELECT coalesce(s.dataset, x.dataset) AS dataset, coalesce(s.method, x.method) AS method, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed, coalesce(ok, 0) AS ok, coalesce(timeouts, 0) AS timeouts, coalesce(broken_traces, 0) AS broken_traces FROM x FULL JOIN s ON x.dataset = s.dataset AND x.method = s.method)
SELECT *, expected = observed AS complete, array_to_string(list_filter([CASE WHEN expected = 0 THEN 'unexpected_cell' END, CASE WHEN expected > 0 AND expected <> observed THEN 'cell_count_mismatch' END, CASE WHEN timeouts > 0 THEN 'question_timeouts' END, CASE WHEN broken_traces > 0 THEN 'record_audit_incomplete' END], lambda z: z IS NOT NULL), ',') AS blockers FROM o
""")
def publication_cells(spark, sf):
    """Expected against observed cells of a run, with what blocks their publication."""
    c = F.col("o_custkey")
    items = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record"), F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("method"), F.when(c % 50 == 0, "question_timeout").when(c % 7 == 0, "empty").otherwise("ok").alias("status"))
    counts = items.groupBy("dataset", "method").agg(F.count("*").alias("n"))
    expected = counts.filter("NOT (method = 'P' AND dataset = '5-LOW')").select("dataset", "method", F.when(F.col("method") == "F", F.col("n") + 1).otherwise(F.col("n")).alias("expected"))
    absent = counts.limit(1).select(F.lit("5-LOW").alias("dataset"), F.lit("Z").alias("method"), F.lit(9).cast("long").alias("expected"))
    return audits.cell_report(expected.unionByName(absent), items, _breaks(spark, sf), ["record"])


_RUNS_SQL = """
r AS (SELECT o_orderstatus AS dataset, o_custkey AS sample, 'run-' || o_orderpriority AS run, CASE WHEN o_orderpriority LIKE '1%' THEN 'unknown' WHEN o_orderpriority LIKE '2%' THEN 'train' ELSE 'dev' END AS split, 'm' || (o_orderkey % 3) AS method, o_orderpriority LIKE '5%' AS scored FROM orders WHERE o_orderkey % 4 = 1),
x AS (SELECT dataset, sample, min(run) AS first_seen_run, coalesce(min({'run': run, 'split': split}) FILTER (split <> 'unknown')['split'], 'unknown') AS split, list_sort(list(DISTINCT method)) AS methods, bool_or(scored) AS scored FROM r GROUP BY ALL)
"""


def _registry(spark, sf):
    """Three batches, one of them committed again with other rows, which changes nothing."""
    p = F.col("o_orderpriority")
    rows = table(spark, sf, "orders").filter("o_orderkey % 4 = 1").select(
        F.col("o_orderstatus").alias("dataset"), F.col("o_custkey").cast("string").alias("sample_id"), F.concat(F.lit("run-"), p).alias("run"), F.when(p.startswith("1"), "unknown").when(p.startswith("2"), "train").otherwise("dev").alias("split"),
        F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("method"), p.startswith("5").alias("result_exposed"), F.lit(False).alias("per_question_exposed"),
    )
    path = f"{scratch_root(spark)}/exposed-{uuid.uuid4().hex}"
    for i, part in enumerate((rows.filter(p.startswith("1")), rows.filter(p.startswith("2")), rows.filter(~p.substr(1, 1).isin("1", "2")))):
        registry.expose(part, path, f"batch-{i}")
    registry.expose(rows.withColumn("sample_id", F.lit("intruder")), path, "batch-1")
    return registry.exposures(spark, path)


@query(f"WITH {_RUNS_SQL} SELECT dataset, CAST(sample AS VARCHAR) AS sample_id, first_seen_run, split, array_to_string(methods, '|') AS methods_seen, scored AS result_exposed, CASE WHEN split = 'dev' AND scored THEN 'CONTAMINATED' WHEN split = 'dev' THEN 'EXPOSED_NOT_SCORED' WHEN split = 'train' THEN 'TRAIN_EXPOSED' ELSE 'UNKNOWN' END AS status FROM x")
def exposure_registry(spark, sf):
    return _registry(spark, sf).select("dataset", "sample_id", "first_seen_run", "split", F.array_join("methods_seen", "|").alias("methods_seen"), "result_exposed", "status")


@query(f"WITH {_RUNS_SQL} SELECT DISTINCT o_orderstatus AS dataset, CAST(o_custkey AS VARCHAR) AS sample_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.dataset = o_orderstatus AND x.sample = o_custkey)")
def untouched_samples(spark, sf):
    all_ = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("dataset"), F.col("o_custkey").cast("string").alias("sample_id")).distinct()
    return registry.untouched(all_, _registry(spark, sf))
