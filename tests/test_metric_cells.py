"""Metrics of records of unknown shape."""

import json

from quillspan.operators import records as R


def test_cells_by_shape(spark):
    rows = [
        (1, json.dumps({"schema_version": 3, "dataset": "d", "method": "m", "result": {"metrics": {"a": 1, "b": {"c": 2.5, "d": True, "e": [1, 2]}, "f": [], "g": "7", "h": None}}, "scores": {"em": 0.5}, "budget": {"calls": 4}})),
        (2, json.dumps({"dataset": "d", "method": "m", "result": {"metrics": {"a": 3, "new": 9}}})), (3, "not json"), (4, "[]"), (5, json.dumps({"result": {"metrics": 4}})),
    ]
    lines = spark.createDataFrame(rows, "record_id long, value string")
    since = spark.createDataFrame([("new", 2)], "name string, version int")
    got = {(r.record_id, r.name): r.value for r in R.metric_cells(lines, since).collect()}
    assert got == {(1, "a"): 1, (1, "b.c"): 2.5, (1, "b.d"): 1, (1, "b.e_count"): 2, (1, "f_count"): 0, (1, "score_em"): 0.5, (1, "budget_calls"): 4, (2, "a"): 3}
    report = {r.name: (r.n, r["mean"]) for r in R.metric_report(R.metric_cells(lines), ["dataset"]).collect()}
    assert report["a"] == (2, 2.0) and report["new"] == (1, 9.0)
    wide = {r.record_id: (r.a, r.score_em) for r in R.metric_columns(R.metric_cells(lines), ["a", "score_em"]).collect()}
    assert wide == {1: (1, 0.5), 2: (3, None)}
