"""Means and rounding at ties: the same figures as SQL that adds up row by row, however the rows are dealt."""

import os

import pytest
from pyspark.sql import functions as F

from quillspan import queries as core
from quillspan import queries_answers, queries_eval  # noqa: F401
from quillspan.functions import values as V
from quillspan.operators import evaluate as E
from quillspan.operators import probes

DATA = "/root/testdata/sf0.1"


def test_mean_does_not_depend_on_where_rows_lie(spark):
    rows = [(1, 0.1), (2, 0.2), (3, 0.3), (4, None)]
    for dealt in (rows, rows[::-1]):
        d = spark.createDataFrame(dealt, "i long, v double").coalesce(1)
        assert d.agg(E.mean_in_order("v", "i").alias("m")).first().m == (0.1 + 0.2 + 0.3) / 3
    assert spark.createDataFrame([(1, None)], "i long, v double").agg(E.mean_in_order("v", "i").alias("m")).first().m is None


def test_rounding_is_that_of_sql(spark):
    import duckdb

    xs = [1.005, -1.005, 2.675, 0.285, 0.5, -0.5, 1.0, 0.125]
    got = [r.x for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(V.rounded(F.col("x"), 2).alias("x")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 2)", [x]).fetchone()[0] for x in xs]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["baseline_comparison", "pairwise_wtl", "strategy_summary", "wilcoxon"])
def test_dealt_rows_equal_sql(spark, tmp_path, name):
    import duckdb

    spark.read.parquet(f"{DATA}/events.parquet").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS FROM '{DATA}/events.parquet'")
    a, b = core.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(core.ORACLES[name]).df()
    cols = sorted(b.columns)
    rows = lambda d: sorted(tuple(map(str, r)) for r in d[cols].itertuples(index=False))
    assert rows(a) == rows(b)


def test_paired_deltas_rounds_as_sql(spark, tmp_path):
    """Fifteen groups of 200 pairs whose means lie on ties of the sixth place."""
    import duckdb

    odd = [109, 251, 489, 493, 591, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]  # of the first five, shortest decimals round otherwise than SQL
    rows = [(2 * u + k, u, kind, odd[u] / 100 if k and u < 15 else 0.0) for u in range(3000) for k, kind in enumerate(("view", "click"))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'")
    got = core.QUERIES["paired_deltas"](spark, str(tmp_path)).select("dataset", "depth", "n", "treatment_minus_reference").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT dataset, depth, n, treatment_minus_reference FROM ({core.ORACLES['paired_deltas']})").fetchall())
    assert {r.n for r in got} == {200}


def test_mean_delta_does_not_depend_on_where_rows_lie(spark):
    xs = [1e8, 0.1, 0.2, 0.4, -1e8]
    for order in (xs, xs[::-1], xs[1:] + xs[:1], xs[2:] + xs[:2]):
        rows = [("d", 0, q, arm, x if arm == "t" else 0.0) for q, x in enumerate(order) for arm in "tr"]
        d = E.paired_deltas(spark.createDataFrame(rows, "dataset string, depth int, question_id int, arm string, score double"), "t", "r")
        assert d.first().treatment_minus_reference == 0.7 / 5


def test_exact_mean_of_odd_values(spark):
    mean = lambda *xs: spark.createDataFrame([(x,) for x in xs], "v double").agg(V.exact_mean(F.col("v")).alias("m")).first().m
    assert mean(None, 0.1, 0.2, 0.3) == 0.6 / 3
    assert mean(None) is None
    assert mean(1e300, 3e300) == 2e300
    assert mean(float("nan"), 1.0) != mean(float("nan"), 1.0)


def test_mean_recall_does_not_depend_on_where_rows_lie(spark):
    xs = [1e8, 0.1, 0.2, 0.4, -1e8]
    for order in (xs, xs[::-1], xs[1:] + xs[:1], xs[2:] + xs[:2]):
        rows = [("d", q, "view", x, 1) for q, x in enumerate(order)]
        s = E.strategy_summary(spark.createDataFrame(rows, "dataset string, question_id int, strategy string, recall double, calls long"), "view")
        assert s.first().mean_recall == 0.7 / 5


def test_mean_difference_does_not_depend_on_where_rows_lie(spark):
    xs = [1e8, 0.1, 0.2, 0.4, -1e8]
    for order in (xs, xs[::-1], xs[1:] + xs[:1], xs[2:] + xs[:2]):
        rows = [("d", q, method, x if method == "click" else 0.0) for q, x in enumerate(order) for method in ("view", "click")]
        c = probes.compare_with_baseline(spark.createDataFrame(rows, "dataset string, question_id int, method string, score double"), "view", ["click"], 20)
        assert c.first().mean_difference == 0.7 / 5
