"""Registered queries of fitted models and resampling: regression, calibration, frozen validation, bootstraps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import policy, regression, resample
from .queries import ORACLES, QUERIES, query, table
from .queries_eval import _WIDE_SQL, _paired

__all__ = ["ORACLES", "QUERIES"]


def _inverse_sql(a: str) -> dict[str, str]:
    """Entries of the inverse of a symmetric 3 x 3 matrix whose columns are named a00, a01, ... a22."""
    m = lambda i, j: f"{a}{min(i, j)}{max(i, j)}"
    minor = lambda i, j: "({} * {} - {} * {})".format(*(m(r, c) for r, c in _corners(i, j)))
    det = f"({m(0, 0)} * {minor(0, 0)} - {m(0, 1)} * {minor(0, 1)} + {m(0, 2)} * {minor(0, 2)})"
    return {f"{i}{j}": f"({'-' if (i + j) % 2 else ''}{minor(i, j)} / {det})" for i in range(3) for j in range(3)}


def _corners(i: int, j: int) -> list[tuple[int, int]]:
    r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
    return [(r[0], c[0]), (r[1], c[1]), (r[0], c[1]), (r[1], c[0])]


_V = _inverse_sql("a")
_OLS_SQL = f"""
WITH d AS (SELECT l_suppkey AS g, CAST(l_discount AS DOUBLE) * l_quantity - CAST(l_tax AS DOUBLE) * 10 AS y, 1.0::DOUBLE AS x0, CAST(l_linenumber AS DOUBLE) AS x1, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS x2 FROM lineitem),
 s AS (SELECT count(*) AS n, sum(y) AS sy, sum(y * y) AS yy, {", ".join(f"sum(x{i} * x{j}) AS a{i}{j}" for i in range(3) for j in range(i, 3))}, {", ".join(f"sum(x{i} * y) AS b{i}" for i in range(3))} FROM d),
 v AS (SELECT n, sy, yy, b0, b1, b2, {", ".join(f"{_V[f'{i}{j}']} AS v{i}{j}" for i in range(3) for j in range(3))} FROM s),
 c AS (SELECT *, {", ".join(f"v{i}0 * b0 + v{i}1 * b1 + v{i}2 * b2 AS c{i}" for i in range(3))} FROM v),
 e AS (SELECT g, {", ".join(f"sum(x{i} * (y - c0 - c1 * x1 - c2 * x2)) AS s{i}" for i in range(3))}, sum((y - c0 - c1 * x1 - c2 * x2) ** 2) AS ee FROM d, c GROUP BY g),
 m AS (SELECT count(*) AS groups, sum(ee) AS ee, {", ".join(f"sum(s{i} * s{j}) AS m{i}{j}" for i in range(3) for j in range(3))} FROM e),
 o AS (SELECT c.*, m.*, (n / (n - 3.0)) * (groups / (groups - 1.0)) AS f FROM c, m)
{" UNION ALL ".join(f"SELECT '{t}' AS term, round(c{i}, 8) AS coef, round(sqrt(f * ({' + '.join(f'v{i}{p} * m{p}{q} * v{q}{i}' for p in range(3) for q in range(3))})), 8) AS se, n, groups AS clusters, round(1 - ee / (yy - sy * sy / n), 8) AS r_squared FROM o" for i, t in enumerate(["intercept", "hops", "chain"]))}
"""


@query(_OLS_SQL)
def cluster_regression(spark, sf):
    """A paired effect on hops and chain shape, errors clustered by supplier."""
    li = table(spark, sf, "lineitem")
    y = F.col("l_discount").cast("double") * F.col("l_quantity") - F.col("l_tax").cast("double") * 10
    rows = li.select("l_suppkey", y.alias("y"), F.col("l_linenumber").alias("hops"), (F.col("l_returnflag") == "R").cast("int").alias("chain"))
    out = regression.cluster_ols(rows, "y", ["hops", "chain"], "l_suppkey")
    return out.select("term", F.round("coef", 8).alias("coef"), F.round("se", 8).alias("se"), "n", "clusters", F.round("r_squared", 8).alias("r_squared"))


# ---- calibration ----------------------------------------------------------------------------


def _fit_sql(rows: str, steps: int = 12, l2: float = 1e-3) -> str:
    """CTEs t0 ... of Newton's method on (x1, x2, y), features standardised, intercept unpenalised; the last is ``fit``."""
    parts = [
        f"raw AS MATERIALIZED ({rows})",
        "st AS MATERIALIZED (SELECT avg(x1) AS m1, avg(x2) AS m2, stddev_pop(x1) AS s1, stddev_pop(x2) AS s2, ln(avg(y) / (1 - avg(y))) AS b, count(*) AS n FROM raw)",
        "z AS MATERIALIZED (SELECT (x1 - m1) / s1 AS z0, (x2 - m2) / s2 AS z1, 1.0::DOUBLE AS z2, y, n FROM raw, st)",
        "t0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, b AS w2 FROM st)",
    ]
    inv = _inverse_sql("a")
    for k in range(steps):
        p = "1 / (1 + exp(-(z0 * w0 + z1 * w1 + w2)))"
        grams = ", ".join(f"sum(z{i} * z{j} * p * (1 - p)) / any_value(n){f' + {l2}' if i == j < 2 else ''} AS a{i}{j}" for i in range(3) for j in range(i, 3))
        grads = ", ".join(f"sum(z{i} * (p - y)) / any_value(n){f' + {l2} * any_value(w{i})' if i < 2 else ''} AS g{i}" for i in range(3))
        parts.append(f"h{k} AS MATERIALIZED (SELECT any_value(w0) AS w0, any_value(w1) AS w1, any_value(w2) AS w2, {grams}, {grads} FROM (SELECT *, {p} AS p FROM z, t{k}))")
        parts.append(f"t{k + 1} AS MATERIALIZED (SELECT {', '.join(f'w{i} - ({inv[f"{i}0"]} * g0 + {inv[f"{i}1"]} * g1 + {inv[f"{i}2"]} * g2) AS w{i}' for i in range(3))} FROM h{k})")
    parts.append(f"fit AS (SELECT m1, m2, s1, s2, w0, w1, w2 FROM t{steps}, st)")
    return ",\n ".join(parts)


_LABELLED = "SELECT l.doc_id, CAST(n_chars AS DOUBLE) / 1000 AS x1, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) / greatest(n_chars, 1) AS x2, CAST(quality AS DOUBLE) AS y FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id WHERE quality IS NOT NULL"
_P = "1 / (1 + exp(-(w2 + w0 * (x1 - m1) / s1 + w1 * (x2 - m2) / s2)))"


def _labelled(spark, sf) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000.0).alias("x1"), ((F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))) / F.greatest("n_chars", F.lit(1))).alias("x2"))
    return table(spark, sf, "labels").filter("quality IS NOT NULL").join(d, "doc_id").select("doc_id", "x1", "x2", F.col("quality").cast("double").alias("y"))


@query(f"""
WITH {_fit_sql(_LABELLED)},
 s AS (SELECT y, {_P} AS p FROM raw, fit),
 g AS (SELECT i / 20.0 AS t, round(2.0 * count(*) FILTER (p >= i / 20.0 AND y > 0) / greatest(1, count(*) FILTER (p >= i / 20.0) + count(*) FILTER (y > 0)), 12) AS f1 FROM s, (SELECT unnest(range(1, 20)) AS i) GROUP BY i),
 b AS (SELECT t FROM g ORDER BY f1 DESC, abs(t - 0.5), t LIMIT 1)
SELECT count(*) AS n, round(avg((p - y) ** 2), 7) AS brier, any_value(t) AS threshold, round(least(any_value(t), greatest(0.05, least(0.49, any_value(t) * 0.7))), 7) AS partial,
       count(*) FILTER (p >= t AND y > 0) AS tp, count(*) FILTER (p >= t AND y <= 0) AS fp, round(any_value(w0), 6) AS weight_length, round(any_value(w1), 6) AS weight_blanks, round(any_value(w2), 6) AS intercept
FROM s, b, fit
""")
def calibrator_fit(spark, sf):
    """A calibrator fitted on all labelled documents, with its own report."""
    rows = _labelled(spark, sf)
    fitted = regression.fit_calibrator(rows, ["x1", "x2"], "y")
    hit, pos = F.col("p") >= fitted.threshold, F.col("y") > 0
    report = rows.select(fitted.probability().alias("p"), "y").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("p") - F.col("y"), F.lit(2))), 7).alias("brier"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"))
    return report.select("n", "brier", F.lit(fitted.threshold).alias("threshold"), F.round(F.lit(fitted.partial), 7).alias("partial"), "tp", "fp", F.lit(round(fitted.weights[0], 6)).alias("weight_length"), F.lit(round(fitted.weights[1], 6)).alias("weight_blanks"), F.lit(round(fitted.intercept, 6)).alias("intercept"))


# ---- resampling -----------------------------------------------------------------------------


def _draws_sql(rows: str, unit: str, draws: int) -> str:
    """The rows for each draw with 32 bits of md5 of unit and block."""
    return f"SELECT x.*, blk * 4 + i AS draw, CAST('0x' || substr(md5(CAST({unit} AS VARCHAR) || ':' || blk), CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT) AS u FROM ({rows}) AS x, (SELECT unnest(range(0, {(draws + 3) // 4})) AS blk), (SELECT unnest(range(0, 4)) AS i) WHERE blk * 4 + i < {draws}"


_COUNT = " + ".join(f"CAST(u >= {t} AS INTEGER)" for t in resample.POISSON)
_PAIRS = _WIDE_SQL + ", q AS (SELECT * FROM p WHERE d IS NOT NULL)"


def _bootstrap_sql(unit: str, draws: int) -> str:
    return _PAIRS + f""", ku AS (SELECT dataset, {unit} AS unit, sum(d) AS d, count(*) AS n FROM q GROUP BY ALL),
 rs AS (SELECT *, {_COUNT} AS c FROM ({_draws_sql("SELECT * FROM ku", "unit", draws)})),
 dm AS (SELECT dataset, draw, sum(c * d) / sum(c * n) AS mean FROM rs WHERE c > 0 GROUP BY ALL),
 iv AS (SELECT dataset, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, least(1.0, 2 * least(avg(CAST(mean <= 0 AS INTEGER)), avg(CAST(mean >= 0 AS INTEGER)))) AS p FROM dm GROUP BY dataset),
 tt AS (SELECT dataset, CAST(sum(n) AS BIGINT) AS n, count(*) AS units, sum(d) / sum(n) AS mean FROM ku GROUP BY dataset)
SELECT dataset, n, units, round(mean, 7) AS mean_difference, round(lo, 7) AS ci_low, round(hi, 7) AS ci_high, round(p, 7) AS p_value FROM tt JOIN iv USING (dataset)
"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 7).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_bootstrap_sql("question_id", 1000))
def bootstrap_ci(spark, sf):
    return _rounded(resample.poisson_bootstrap(_paired(spark, sf).na.drop(), ["dataset"], F.col("question_id"), 1000))


@query(_bootstrap_sql("question_id % 20", 1000))
def cluster_ci(spark, sf):
    return _rounded(resample.poisson_bootstrap(_paired(spark, sf).na.drop(), ["dataset"], F.col("question_id") % 20, 1000))


@query(_PAIRS + f""", rs AS ({_draws_sql("SELECT dataset, question_id, d FROM q", "question_id", 1000)}),
 sg AS (SELECT dataset, draw, sum(CASE WHEN u < 2147483648 THEN d ELSE -d END) AS s FROM rs GROUP BY ALL),
 tt AS (SELECT dataset, count(*) AS n, sum(d) AS total FROM q GROUP BY dataset)
SELECT dataset, n, round(total / n, 7) AS estimate, round((hits + 1) / 1001.0, 7) AS p_value FROM tt JOIN (SELECT dataset, count(*) FILTER (abs(s) >= abs(total) - 1e-9) AS hits FROM sg JOIN tt USING (dataset) GROUP BY dataset) USING (dataset)
""")
def sign_flip(spark, sf):
    return _rounded(resample.flip_signs(_paired(spark, sf).na.drop(), ["dataset"], F.col("question_id"), 1000))


@query(_PAIRS + f""", rs AS (SELECT *, {_COUNT} AS c, draw // 2 AS trial FROM ({_draws_sql("SELECT dataset, question_id, d FROM q", "question_id", 400)})),
 sg AS (SELECT dataset, trial, sum(CASE WHEN d > 1e-9 THEN c ELSE 0 END) AS up, sum(CASE WHEN d < -1e-9 THEN c ELSE 0 END) AS down FROM rs GROUP BY ALL),
 tt AS (SELECT dataset, count(*) FILTER (d > 1e-9) AS wins, count(*) FILTER (d < -1e-9) AS losses FROM q GROUP BY dataset)
SELECT dataset, any_value(wins) AS wins, any_value(losses) AS losses, count(*) AS trials, round(avg(CASE WHEN up + down > 0 AND greatest(abs(up - down) - 1, 0) ** 2 / (up + down) > 3.841458820694124 THEN 1.0 ELSE 0.0 END), 7) AS power FROM sg JOIN tt USING (dataset) GROUP BY dataset
""")
def resampled_power(spark, sf):
    """Power of a study of twice the pairs, from the pairs at hand."""
    return _rounded(resample.empirical_power(_paired(spark, sf).na.drop(), ["dataset"], F.col("question_id"), 200, 2))


@query(f"""
WITH e AS (SELECT o_orderpriority AS dataset, o_orderkey AS id, o_orderdate >= DATE '1995-01-01' AS deep, CAST(o_totalprice AS DOUBLE) AS v FROM orders),
 t AS (SELECT dataset, count(*) FILTER (deep) AS deep_n, count(*) FILTER (NOT deep) AS shallow_n, avg(v) FILTER (deep) AS dm, avg(v) FILTER (NOT deep) AS sm, CAST(floor(count(*) FILTER (deep) / count(*) * 4294967296) AS BIGINT) AS cut FROM e GROUP BY dataset),
 r AS (SELECT *, u < cut AS dealt FROM ({_draws_sql("SELECT e.*, cut FROM e JOIN t USING (dataset)", "id", 40)})),
 m AS (SELECT dataset, draw, avg(v) FILTER (dealt) - avg(v) FILTER (NOT dealt) AS d FROM r GROUP BY ALL)
SELECT dataset, deep_n, shallow_n, round(any_value(dm), 4) AS deep_mean, round(any_value(sm), 4) AS shallow_mean, round(any_value(dm - sm), 4) AS observed_difference, round(avg(CAST(d >= dm - sm - 1e-12 AS INTEGER)), 4) AS p_value
FROM t JOIN m USING (dataset) GROUP BY dataset, deep_n, shallow_n
""")
def permutation_interaction(spark, sf):
    """Whether later orders are larger, by priority, under dealt labels."""
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset"), "o_orderkey", (F.col("o_orderdate") >= F.lit("1995-01-01").cast("date")).alias("deep"), F.col("o_totalprice").cast("double").alias("value"))
    out = resample.permute_labels(o, ["dataset"], F.col("o_orderkey"), 40)
    return out.select("dataset", "deep_n", "shallow_n", *[F.round(c, 4).alias(c) for c in ("deep_mean", "shallow_mean", "observed_difference", "p_value")])


@query(f"""
WITH {_fit_sql(_LABELLED + " AND l.doc_id % 5 <> 4")},
 h AS (SELECT l.doc_id % 3 AS dataset, l.* FROM ({_LABELLED} AND l.doc_id % 5 = 4) AS l),
 s AS (SELECT dataset, doc_id, y, {_P} AS p, least(0.95, greatest(0.05, x1)) AS c FROM h, fit),
 k AS (SELECT dataset, doc_id AS unit, (p - y) ** 2 - (c - y) ** 2 AS d FROM s),
 r AS (SELECT *, {_COUNT} AS n FROM ({_draws_sql("SELECT * FROM k", "unit", 400)})),
 m AS (SELECT dataset, draw, sum(n * d) / sum(n) AS mean FROM r WHERE n > 0 GROUP BY ALL),
 i AS (SELECT dataset, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi FROM m GROUP BY dataset),
 t AS (SELECT dataset, count(*) AS examples, avg((p - y) ** 2) AS selected, avg((c - y) ** 2) AS comparator FROM s GROUP BY dataset)
SELECT dataset, examples, round(selected, 6) AS selected_brier, round(comparator, 6) AS comparator_brier, round(selected - comparator, 6) AS brier_delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM t JOIN i USING (dataset)
""")
def frozen_validation(spark, sf):
    """A calibrator fitted on four of five labelled documents, against a fixed rule, on the fifth, by dataset."""
    rows = _labelled(spark, sf)
    fitted = regression.fit_calibrator(rows.filter("doc_id % 5 <> 4"), ["x1", "x2"], "y")
    held = rows.filter("doc_id % 5 = 4").select((F.col("doc_id") % 3).alias("dataset"), "doc_id", F.col("y").alias("label"), fitted.probability().alias("selected"), F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.col("x1"))).alias("comparator"))
    out = policy.frozen_report(held, rows.filter("doc_id % 5 <> 4").select("doc_id"), "doc_id", draws=400)
    return out.select("dataset", "examples", *[F.round(c, 6).alias(c) for c in ("selected_brier", "comparator_brier", "brier_delta", "ci_low", "ci_high")])
