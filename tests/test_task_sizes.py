from pyspark.sql import functions as F

from quillspan import queries
from quillspan.operators import policy
from quillspan.sources.scratch import partitions_for


def exchanges(d):
    text = d._jdf.queryExecution().executedPlan().toString()
    return [text.count(x) for x in ("REPARTITION_BY_NUM", "ENSURE_REQUIREMENTS")]


def test_tasks_grow_in_number(spark):
    assert partitions_for(spark.range(10), 1) == 10 and partitions_for(spark.range(10)) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_beam_windows_are_dealt_by_rows(spark, monkeypatch):
    rows = [(i % 3, str(i % 5), (i % 7) / 7, "ab"[i % 2] if i % 4 else None, "") for i in range(60)]
    d = spark.createDataFrame(rows, "query_id long, _source_id string, _confidence double, x string, y string")
    one = policy.beam_select(policy.beam_candidates(d, ["x", "y"]))
    monkeypatch.setattr(policy, "partitions_for", lambda _: 13)
    many = policy.beam_select(policy.beam_candidates(d, ["x", "y"]))
    assert exchanges(many) == [3, 0]  # no window is dealt to the session's fixed number of tasks
    assert many.rdd.getNumPartitions() == 13 and sorted(one.collect(), key=str) == sorted(many.collect(), key=str)


def test_lists_are_dealt_by_rows(spark, monkeypatch, tmp_path):
    lines = spark.range(400).select((F.col("id") % 7).alias("l_suppkey"), (F.col("id") * 37 % 900).alias("l_partkey"), (F.col("id") % 50).alias("l_quantity"), (F.col("id") * 11.5).alias("l_extendedprice"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    before = [sorted(x.collect()) for x in queries._lists(spark, str(tmp_path))]
    monkeypatch.setattr(queries, "partitions_for", lambda _: 13)
    after = queries._lists(spark, str(tmp_path))
    assert all(exchanges(x) == [1, 0] for x in after)
    assert [sorted(x.collect()) for x in after] == before
