"""The row algebra and typed cells against golden rows and a plain-Python model."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import values as V
from quillspan.operators import algebra as A

CELLS = ["", "0", "0.0", "-5", "1,234.5", "1_000", "5d", "nan", "inf", "906", "1906", "12345", "1906-1-2", "2nd May 1906", "May 5, 1906", "Straße", "STRASSE", "café", None]


def frame(spark, rows, columns):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ", ".join(f"{c} string" for c in columns) + ", pos long")


def rows(df, *names):
    return [tuple(r) for r in df.orderBy("pos").select(*names).collect()]


def py_number(s):
    try:
        return float(s.replace(",", ""))
    except (ValueError, AttributeError):
        return None


def test_numbers_read_as_python_reads_them(spark):
    got = frame(spark, [(c,) for c in CELLS], ["c"]).select("c", V.number(F.col("c")).alias("n")).collect()
    for r in got:
        want = py_number(r.c)
        assert (r.n is None) == (want is None) and (want is None or r.n == want or (math.isnan(r.n) and math.isnan(want))), r


@pytest.mark.parametrize("cell,day", [("1906-1-2", "1906-01-02"), ("2nd May 1906", "1906-05-02"), ("May 5, 1906", "1906-05-05"), ("1906", "1906-01-01"), ("906", None), ("12345", None), ("18 September 1906", "1906-09-18"), ("unknown", None)])
def test_dates(spark, cell, day):
    assert frame(spark, [(cell,)], ["c"]).select(V.date(F.col("c")).cast("string").alias("d")).first().d == day


@pytest.mark.parametrize("op", ["eq", "ne", "lt", "le", "gt", "ge", "contains"])
def test_compare_is_numeric_or_caseless(spark, op):
    cells = [c for c in CELLS if c is not None]
    pairs = [(a, b) for a in cells for b in cells]
    got = frame(spark, pairs, ["a", "b"]).select("a", "b", V.compare(F.col("a"), F.col("b"), op).alias("t")).collect()
    for r in got:
        x, y = py_number(r.a), py_number(r.b)
        if x is None or y is None:
            x, y = r.a.casefold(), r.b.casefold()
        want = {"eq": lambda: x == y, "ne": lambda: x != y, "lt": lambda: x < y, "le": lambda: x <= y, "gt": lambda: x > y, "ge": lambda: x >= y, "contains": lambda: str(y) in str(x)}[op]()
        if op == "contains" and not isinstance(x, str) and (math.isinf(x) or math.isnan(x) or math.isinf(y) or math.isnan(y)):
            continue
        assert r.t == want, (r.a, op, r.b)


def test_argmax_count_and_subtract(spark):
    d = frame(spark, [("A", "2"), ("B", "5")], ["name", "score"])
    assert rows(A.extreme_row(d, "score", True), "name", "score") == [("B", "5")]
    assert rows(A.count_rows(d, "n"), "n") == [("2",)]
    d = frame(spark, [("6.4", "6.1")], ["rebounds", "assists"])
    assert rows(A.arithmetic(d, ["rebounds", "assists"], "subtract", "difference"), "difference") == [("0.3",)]


def test_field_extremum_picks_abstains_and_ties(spark):
    labels = ["Find Me Guilty", "Tear Gas Squad"]
    for cells, want in ((("June 25, 1924", "January 30, 1906"), [("Tear Gas Squad",)]), (("1906", "1906"), []), (("unknown", "1906"), []), (("906", "1906"), []), (("3", "2"), [("Tear Gas Squad",)])):
        d = frame(spark, [cells], ["a", "b"])
        assert rows(A.field_extremum(d, ["a", "b"], labels, False), "answer") == want
    assert rows(A.field_extremum(frame(spark, [("1", "2"), ("2", "1")], ["a", "b"]), ["a", "b"], labels, False), "answer") == []


def test_month_difference_and_division_by_zero(spark):
    d = frame(spark, [("18 September 1906", "1906-12-02", "0")], ["a", "b", "z"])
    assert rows(A.arithmetic(d, ["a", "b"], "date_diff_months", "months"), "months") == [("3",)]
    assert rows(A.arithmetic(d, ["z", "z"], "divide"), "result") == []


def test_sort_orders_numbers_before_text_and_keeps_ties(spark):
    cells = ["10", "b", "9", "A", "0", "a", "b", "10.0"]
    d = frame(spark, [(c,) for c in cells], ["c"])
    key = lambda c: (py_number(c) is None, py_number(c) if py_number(c) is not None else 0.0, "" if py_number(c) is not None else c.casefold())
    assert [r[0] for r in rows(A.sort_rows(d, "c"), "c")] == sorted(cells, key=key)
    assert [r[0] for r in rows(A.sort_rows(d, "c", True), "c")] == sorted(cells, key=key, reverse=True)
    assert [r[0] for r in rows(A.sort_rows(d, "c", True, 3), "c")] == sorted(cells, key=key, reverse=True)[:3]


def test_compare_and_boolean_on_nothing(spark):
    empty = frame(spark, [("1", "2")], ["a", "b"]).filter("false")
    assert rows(A.compare_fields(empty, ["a", "b"]), "comparison") == [("False",)]
    assert rows(A.any_rows(empty), "answer") == [("False",)]
    assert rows(A.count_rows(empty), "count") == [("0",)]
    assert rows(A.extreme_row(empty, "a", True), "a") == []


def test_distinct_keeps_the_first_row(spark):
    d = frame(spark, [("x", "1"), (None, "2"), ("x", "3"), ("", "4")], ["k", "v"])
    assert rows(A.distinct_on(d, ["k"]), "k", "v") == [("x", "1"), (None, "2")]


def test_joins_match_a_nested_loop(spark):
    rng = random.Random(5)
    pick = lambda: rng.choice(["a", "b", "", None])
    left = [(pick(), pick(), str(i)) for i in range(25)]
    right = [(pick(), pick(), str(i)) for i in range(25)]
    got = A.join_rows(frame(spark, left, ["k", "s", "x"]), frame(spark, right, ["k", "s", "y"]), "k", "k")
    want = [(a[0], a[1] if a[1] is not None else b[1], a[2], b[2]) for a in left for b in right if a[0] and a[0] == b[0] and (a[1] is None or b[1] is None or a[1] == b[1])]
    assert rows(got, "k", "s", "x", "y") == want


def test_bridge_refuses_two_large_branches(spark):
    d = frame(spark, [(str(i),) for i in range(5)], ["a"])
    with pytest.raises(ValueError):
        A.bridge_rows(d, d.withColumnRenamed("a", "b"), most=3)


def test_rendering_is_exact(spark):
    x = [0.1 + 0.2, 101538687.74, -0.5, 3.0, -0.0, 1e20, 0.99999999999, 1 / 3]
    got = [r.t for r in spark.createDataFrame([(v,) for v in x], "v double").select(V.render(F.col("v")).alias("t")).collect()]
    assert got == [str(int(v)) if v.is_integer() else f"{v:.10f}".rstrip("0").rstrip(".") for v in x]
