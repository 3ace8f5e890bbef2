"""Methods in rounds, evidence sets, driver files and statistics, on small rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspan.operators import evidence, stats, sufficiency
from quillspan.plans import methods
from quillspan.plans.execute import choose_slot
from quillspan.plans.model import Slot
from quillspan.sources import files

FACTS = [("a", "alpha leads to beta"), ("b", "beta leads to gamma"), ("c", "gamma is the end")]


@pytest.fixture(scope="module")
def search(spark):
    facts = spark.createDataFrame(FACTS, "source_id string, text string")

    def run(queries):
        first = F.split(F.col("text"), " ")[0]
        return queries.join(facts, F.lower("query") == first).select("query_id", "source_id", F.lit(1.0).alias("score"), "text")

    return run


def test_loop_equals_a_loop_over_questions(spark, search):
    questions = spark.createDataFrame([(1, "alpha"), (2, "gamma"), (3, "nothing")], "query_id long, question string")

    def step(question, texts, n):
        if texts and texts[-1].endswith("end"):
            return "", True
        return (texts[-1].split()[-1] if texts else ""), False

    items, calls = methods.gather("iterative", questions, search, step=step)
    got = {}
    for r in items.orderBy("query_id", "round").collect():
        got.setdefault(r.query_id, []).append(r.source_id)
    assert got == {1: ["a", "b", "c"], 2: ["c"]}
    assert {r.query_id: (r.calls, r.stopped) for r in calls.collect()} == {1: (3, True), 2: (1, True), 3: (1, False)}
    said = {r.query_id: (r.answer, r.status, r.documents) for r in methods.finalize(questions, items, lambda q, t: t[-1]).collect()}
    assert said == {1: ("gamma is the end", "ok", 3), 2: ("gamma is the end", "ok", 1), 3: (None, "empty", 0)}


def test_static_queries_keep_rounds_and_count_blank_ones(spark, search):
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "")], "query_id long, question string")
    items, calls = methods.gather("static_plan", questions, search, plan=lambda q: [*q.split(), " "])
    assert sorted((r.query_id, r["round"], r.source_id) for r in items.collect()) == [(1, 0, "a"), (1, 1, "b")]
    assert {r.query_id: r.calls for r in calls.collect()} == {1: 3, 2: 1}
    one, _ = methods.gather("whole_question", questions, search)
    assert one.count() == 0


def test_polar_answers_follow_what_was_extracted(spark):
    df = spark.createDataFrame([("True", ["maybe", "No, it is not"]), ("x", ["nothing"]), ("x", [])], "a string, v array<string>")
    assert [r[0] for r in df.select(methods.reconciled(F.col("a"), F.col("v"))).collect()] == ["False", "x", "x"]


def test_evidence_of_empty_and_null_rows(spark):
    none = spark.createDataFrame([], "query_id long, pos long, source_id string")
    chosen = spark.createDataFrame([], "query_id long, place long, source_id string")
    passages = spark.createDataFrame(FACTS, "source_id string, text string")
    assert evidence.candidate_inventory(none, chosen, passages).count() == 0
    some = spark.createDataFrame([(1, 0, None), (1, 1, ""), (1, 3, "a"), (1, 2, "a"), (1, 4, "zz")], none.schema)
    rows = evidence.candidate_inventory(some, spark.createDataFrame([(1, 0, "a"), (1, 1, "zz")], chosen.schema), passages).collect()
    assert sorted((r.source_id, r.pos, r.found, r.place) for r in rows) == [("a", 2, True, 0), ("zz", 4, False, None)]
    bound = spark.createDataFrame([("a", 1), ("zz", 2)], "source_id string, n int")
    hits, misses = evidence.binding_evidence(bound, passages)
    assert [r.source_span for r in hits.collect()] == [FACTS[0][1]] and [r.n for r in misses.collect()] == [2]


def test_features_of_a_context_without_results(spark):
    ctx = spark.createDataFrame([(1, None, [], [], [], "bm25", 0, 3, 2)], "query_id long, predicate string, requested array<string>, join_variables array<string>, bound array<string>, backend string, call_budget int, calls_used int, remaining_depth int")
    results = spark.createDataFrame([], "query_id long, pos long, passage_id string, doc_id string, text string, score double, bm25_score double, dense_score double, rerank_score double")
    rows = spark.createDataFrame([], "query_id long, pos long, source_id string, bindings map<string,string>, confidence double")
    got = sufficiency.features(ctx, results, rows).collect()[0].asDict()
    ones = {"sparse_dense_agreement", "reranker_agreement", "bound_variable_coverage", "join_edge_coverage", "score_source_fused"}
    assert {k for k, v in got.items() if v} == ones | {"query_id", "remaining_plan_depth"}
    assert list(got)[1:] == sufficiency.FEATURES


def test_slot_strategies():
    slots = [Slot(id=x, predicate="p", arguments=["?v"], cardinality=c) for x, c in (("s1", 9), ("s2", 3), ("s3", 5))]
    pick = lambda how, seed=1: choose_slot(slots, set(), {}, how, lambda _: set(), set(), ["s3"], seed).id
    assert (pick("question"), pick("oracle"), pick("fixed")) == ("s1", "s2", "s3")
    assert {pick("random", s) for s in range(20)} == {"s1", "s2", "s3"} and pick("random") == pick("random")


def test_permutations_and_loss_intervals():
    deep, shallow = [1.0] * 6, [0.0] * 6
    out = stats.permutation_interaction(deep, shallow, 200, 3)
    assert out["observed_difference"] == 1 and out["p_value"] <= 0.02
    rng, both = np.random.RandomState(3), np.array(deep + shallow)
    hits = sum(p[:6].mean() - p[6:].mean() >= 1 for p in (rng.permutation(both) for _ in range(200)))
    assert out["p_value"] == hits / 200
    assert stats.permutation_interaction(deep[:4], shallow) is None
    same = stats.loss_delta_interval([0.25] * 4, 100, 1)
    assert same == {"mean": 0.25, "ci_low": 0.25, "ci_high": 0.25, "n": 4}
    some = stats.loss_delta_interval([-1.0, 0.0, 2.0], 500, 1)
    assert some["ci_low"] <= some["mean"] <= some["ci_high"] and math.isclose(some["mean"], 1 / 3)
    with pytest.raises(ValueError):
        stats.loss_delta_interval([])


def test_driver_files(tmp_path):
    source = tmp_path / "in"
    source.write_bytes(b"some rows")
    digest = hashlib.sha256(b"some rows").hexdigest()
    assert files.fetch(source.as_uri(), tmp_path / "out", digest).read_bytes() == b"some rows"
    with pytest.raises(ValueError):
        files.fetch(source.as_uri(), tmp_path / "bad", "0" * 64)
    assert not (tmp_path / "bad").exists() and not (tmp_path / "bad.part").exists()
    for _ in range(3):
        total = files.update_json(tmp_path / "n.json", lambda v: v + 1, 0)
    assert total == 3
    with files.slot(tmp_path / "slots", 2) as a, files.slot(tmp_path / "slots", 2) as b:
        assert {a, b} == {0, 1}
    waits: list[float] = []
    for _ in range(3):
        files.paced(tmp_path / "pace.json", 60, clock=lambda: 100.0, sleep=waits.append)
    assert waits == [1.0, 2.0]
    assert files.rows_csv([], tmp_path / "e.csv").read_text() == "\n"
    assert files.rows_csv([{"a": 1}, {"b": 2}], tmp_path / "u.csv", union=True).read_text() == "a,b\n1,\n,2\n"


def test_configuration(tmp_path):
    defaults = {"retrieval": {"top_k": 5, "dense": False}, "name": "x"}
    (tmp_path / "c.json").write_text('{"retrieval": {"top_k": 7}}')
    env = {"QUILLSPAN__RETRIEVAL__DENSE": "true", "QUILLSPAN__NAME": "y"}
    assert files.load_config(tmp_path / "c.json", defaults, env) == {"retrieval": {"top_k": 7, "dense": True}, "name": "y"}
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        files.load_config(tmp_path / "d.json", defaults, {})


def test_digest_does_not_depend_on_partitions(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("pos"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    a = files.write_passages(df.repartition(3), str(tmp_path / "a"))
    assert a == files.write_passages(df.coalesce(1), str(tmp_path / "b")) == files.ordered_digest(df.orderBy(F.desc("pos")), "pos")
    assert a != files.ordered_digest(df.withColumn("text", F.upper("text")), "pos")
