"""Iterative graph ranking, regression, calibration and hash-drawn resampling against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import graph, policy, regression, resample, stats


def dense_pagerank(terms, query, iterations=30, damping=0.85):
    n, places = len(terms), {}
    for i, ts in enumerate(terms):
        for t in ts:
            places.setdefault(t, []).append(i)
    links = np.zeros((n, n))
    for at in places.values():
        if 2 <= len(at) <= 20:
            links[np.ix_(at, at)] = 1
    np.fill_diagonal(links, 0)
    overlap = np.array([len(query & ts) for ts in terms], float)
    seed = overlap / overlap.sum() if overlap.sum() else np.full(n, 1 / n)
    degree = links.sum(axis=1)
    step = np.divide(links, degree[:, None], out=np.zeros_like(links), where=degree[:, None] > 0)
    rank = seed.copy()
    for _ in range(iterations):
        rank = (1 - damping) * seed + damping * (rank @ step + rank[degree == 0].sum() * seed)
    return rank, overlap


def test_pagerank_of_many_candidates_equals_numpy(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i:03d}" for i in range(160)]
    rows, want = [], {}
    for q, size in ((0, 150), (1, 40), (2, 3)):
        query = set(rng.choice(vocabulary, 6)) if q < 2 else {"unknown"}
        terms = [set(rng.choice(vocabulary[: 160 if i % 3 else 20], rng.integers(0, 9))) for i in range(size)] if q < 2 else [{"one"}, {"two"}, set()]
        rows += [(q, " ".join(sorted(query)), i, " ".join(sorted(t))) for i, t in enumerate(terms)]
        score, overlap = dense_pagerank(terms, query)
        order = sorted(range(size), key=lambda i: (-round(score[i], 12), -overlap[i], i))[:10]
        want[q] = [(i, score[i]) for i in order]
    df = spark.createDataFrame(rows, "query_id long, query string, pos long, text string").repartition(3)
    got = graph.graph_rank(df, cut_every=7).orderBy("query_id", "rank").collect()
    for q, best in want.items():
        mine = [(r.pos, r.score) for r in got if r.query_id == q]
        assert [p for p, _ in mine] == [p for p, _ in best]
        assert np.allclose([s for _, s in mine], [s for _, s in best], atol=1e-9, rtol=0)


def test_graph_of_nothing(spark):
    assert graph.graph_rank(spark.createDataFrame([], "query_id long, query string, pos long, text string")).collect() == []
    got = graph.graph_rank(spark.createDataFrame([(1, None, 5, None)], "query_id long, query string, pos long, text string")).collect()
    assert [(r.pos, r.rank) for r in got] == [(5, 1)]


def test_cluster_errors_equal_the_dense_solution(spark):
    rng = np.random.default_rng(8)
    n = 500
    g, x1, x2 = rng.integers(0, 23, n), rng.normal(size=n), rng.integers(0, 2, n).astype(float)
    y = 1.5 + 2 * x1 - x2 + rng.normal(size=23)[g] + rng.normal(size=n)
    rows = [(int(a), float(b), float(c), float(d)) for a, b, c, d in zip(g, x1, x2, y)] + [(1, None, 1.0, 2.0)]
    got = regression.cluster_ols(spark.createDataFrame(rows, "g int, x1 double, x2 double, y double").repartition(5), "y", ["x1", "x2"], "g").collect()
    x = np.column_stack((np.ones(n), x1, x2))
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    e = y - x @ beta
    scores = np.array([x[g == c].T @ e[g == c] for c in range(23)])
    bread = np.linalg.inv(x.T @ x)
    se = np.sqrt(np.diag(bread @ (scores.T @ scores * n / (n - 3) * 23 / 22) @ bread))
    assert [r.term for r in got] == ["intercept", "x1", "x2"]
    assert np.allclose([r.coef for r in got], beta, atol=1e-9) and np.allclose([r.se for r in got], se, atol=1e-9)
    assert got[0].n == n and got[0].clusters == 23 and abs(got[0].r_squared - (1 - e @ e / ((y - y.mean()) ** 2).sum())) < 1e-9


def test_regression_without_rows_and_with_dependent_columns(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (2, 3.0, 6.5)], "g int, x double, y double").withColumn("twice", F.col("x") * 2)
    assert regression.cluster_ols(df.limit(0), "y", ["x"], "g").collect() == []
    got = {r.term: r.coef for r in regression.cluster_ols(df, "y", ["x", "twice"], "g").collect()}
    alone = {r.term: r.coef for r in regression.cluster_ols(df, "y", ["x"], "g").collect()}
    assert abs(got["x"] + 2 * got["twice"] - alone["x"]) < 1e-6


def test_calibrator_is_the_optimum_of_all_rows(spark):
    rng = np.random.default_rng(2)
    n = 3000
    x = rng.normal(size=(n, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (rng.random(n) < 1 / (1 + np.exp(-(x[:, 0] - 0.4 * (x[:, 1] - 3) - 0.5)))).astype(float)
    rows = [(*map(float, r), 7.0, float(v)) for r, v in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, y double").repartition(4)
    fitted = regression.fit_calibrator(df, ["a", "b", "c", "same"], "y")
    z = np.column_stack(((x - x.mean(axis=0)) / x.std(axis=0), np.zeros(n), np.ones(n)))
    theta = np.array([*fitted.weights, fitted.intercept])
    p = 1 / (1 + np.exp(-z @ theta))
    gradient = z.T @ (p - y) / n + 1e-3 * np.append(theta[:-1], 0)
    assert np.abs(gradient).max() < 1e-8 and fitted.scales[3] == 1.0
    f1 = lambda t: 2 * ((p >= t) & (y > 0)).sum() / ((p >= t).sum() + y.sum())
    best = max((i / 20 for i in range(1, 20)), key=lambda t: (round(f1(t), 12), -abs(t - 0.5)))
    assert fitted.threshold == best and abs(fitted.partial - min(best, max(0.05, min(0.49, best * 0.7)))) < 1e-12
    with pytest.raises(ValueError):
        regression.fit_calibrator(df.limit(0), ["a"], "y")


def test_separable_examples_and_null_features(spark):
    df = spark.createDataFrame([(float(i) if i % 5 else None, float(i >= 20)) for i in range(40)], "a double, y double")
    fitted = regression.fit_calibrator(df, ["a"], "y")
    assert math.isfinite(fitted.weights[0]) and fitted.weights[0] > 0


def test_split_takes_the_last_quarter(spark):
    df = spark.createDataFrame([(f"e{i:03d}",) for i in range(22)], "example_id string").repartition(3)
    train, held = regression.split_by_order(df, "example_id")
    assert sorted(r[0] for r in held.collect()) == [f"e{i:03d}" for i in range(16, 22)] and train.count() == 16


def test_poisson_bootstrap_agrees_with_resampling(spark):
    rng = np.random.default_rng(6)
    d = rng.normal(0.1, 1, 400)
    rows = [("a", i, 0.0, float(v)) for i, v in enumerate(d)] + [("one", 0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "dataset string, id long, reference double, treatment double")
    got = {r.dataset: r for r in resample.poisson_bootstrap(df.repartition(7), ["dataset"], F.col("id"), 2000).collect()}
    old = stats.bootstrap_vector(np.zeros(400), d, 4000)
    assert got["a"].n == 400 and abs(got["a"].mean_difference - d.mean()) < 1e-12
    assert abs(got["a"].ci_low - old["ci_low"]) < 0.02 and abs(got["a"].ci_high - old["ci_high"]) < 0.02 and abs(got["a"].p_value - old["p_value"]) < 0.03
    assert got["one"].ci_low is None and got["one"].mean_difference == 1.0
    again = {r.dataset: r for r in resample.poisson_bootstrap(df.coalesce(1), ["dataset"], F.col("id"), 2000).collect()}
    assert abs(again["a"].ci_low - got["a"].ci_low) < 1e-12  # draws don't depend on where rows lie


def test_draw_counts_are_poisson(spark):
    u = resample.with_draws(spark.range(2000), F.col("id"), 10)
    counts = [r.c for r in u.select(resample.poisson_count(F.col("u")).alias("c")).collect()]
    assert len(counts) == 20_000 and abs(np.mean(counts) - 1) < 0.03 and abs(np.var(counts) - 1) < 0.05


def test_sign_flips_and_dealt_labels(spark):
    rng = np.random.default_rng(9)
    rows = [(g, i, 0.0, float(rng.normal(m, 1))) for g, m in (("none", 0.0), ("some", 0.5)) for i in range(100)]
    df = spark.createDataFrame(rows, "dataset string, id long, reference double, treatment double")
    got = {r.dataset: r.p_value for r in resample.flip_signs(df, ["dataset"], F.col("id"), 999).collect()}
    old = {r.dataset: r.p_value for r in stats.sign_flip(df.withColumnRenamed("id", "question_id"), ["dataset"], 999).collect()}
    assert all(abs(got[g] - old[g]) < 0.08 for g in got) and got["some"] < 0.01
    labelled = df.select("dataset", "id", (F.col("id") % 2 == 0).alias("deep"), (F.col("treatment") + F.when(F.col("dataset") == "some", (F.col("id") % 2 == 0).cast("int")).otherwise(0)).alias("value"))
    p = {r.dataset: r.p_value for r in resample.permute_labels(labelled, ["dataset"], F.col("id"), 500).collect()}
    assert p["some"] < 0.01 < p["none"]
    few = resample.permute_labels(labelled.filter("id < 6"), ["dataset"], F.col("id"), 20).collect()
    assert all(r.p_value is None for r in few)


def test_frozen_report_refuses_seen_questions(spark):
    held = spark.createDataFrame([("d", q, float(q % 2), 0.9 if q % 2 else 0.1, 0.5) for q in range(40)], "dataset string, q long, label double, selected double, comparator double")
    out = policy.frozen_report(held, spark.createDataFrame([(99,)], "q long"), "q", 200).first()
    assert abs(out.selected_brier - 0.01) < 1e-12 and abs(out.brier_delta + 0.24) < 1e-12 and out.ci_high < 0
    with pytest.raises(ValueError, match="overlap"):
        policy.frozen_report(held, spark.createDataFrame([(7,)], "q long"), "q", 200)
