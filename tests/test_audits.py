"""Hash chains across ranges, the exposure registry, distributed ranks and resampled power."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillspan.operators import audits, resample, stats
from quillspan.sources import registry


def test_chains_of_any_length_are_checked_across_ranges(spark):
    rows = [(k, i, f"payload {k} {i}") for k, n in (("long", 300), ("one", 1), ("two", 2)) for i in range(n)]
    events = spark.createDataFrame(rows, "k string, o int, payload string")
    whole = audits.sealed(events, ["k"], "o", "payload")
    assert whole.count() == 303 and audits.chain_breaks(whole, ["k"], "payload").collect() == []
    rows = whole.collect()
    changed = [r.asDict() for r in rows if not (r.k == "long" and r.place == 120)]
    for r in changed:
        if r["k"] == "long" and r["place"] == 40:
            r["payload"] += "!"
    changed.append(next(r for r in changed if r["k"] == "long" and r["place"] == 7) | {"chain": "forged"})
    bad = spark.createDataFrame(changed, whole.schema).repartition(5)
    got = sorted((r.k, r.place, r.reason) for r in audits.chain_breaks(bad, ["k"], "payload").collect())
    assert got[0][:2] == ("long", 7) and got[0][2] in ("duplicate", "digest") and ("long", 40, "digest") in got and ("long", 121, "gap") in got
    assert {p for _, p, _ in got} <= {7, 8, 40, 121}
    assert audits.chain_breaks(whole.limit(0), ["k"], "payload").collect() == []
    headless = audits.chain_breaks(whole.filter("k = 'two' AND place = 2"), ["k"], "payload").collect()
    assert [(r.place, r.reason) for r in headless] == [(2, "gap")]


def test_batches_commit_once(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert registry.exposures(spark, path).collect() == []
    rows = lambda *r: spark.createDataFrame(list(r), registry.ROW)
    first = rows(("d", "1", "r2", "unknown", "m1", False, False), ("d", "1", "r1", "unknown", "m1", None, None), ("d", "2", "r1", "train", "m1", True, False))
    assert registry.expose(first, path, "a") and not registry.expose(first, path, "a")
    assert registry.expose(rows(("d", "1", "r3", "dev", "m2", False, True), ("d", "3", "r3", "dev", "m2", False, False)), path, "b")
    assert not registry.expose(rows(("d", "9", "r9", "dev", "m", True, True)), path, "b")
    got = {r.sample_id: r for r in registry.exposures(spark, path).collect()}
    assert {k: (r.first_seen_run, r.split, r.methods_seen, r.status) for k, r in got.items()} == {
        "1": ("r1", "dev", ["m1", "m2"], "CONTAMINATED"), "2": ("r1", "train", ["m1"], "TRAIN_EXPOSED"), "3": ("r3", "dev", ["m2"], "EXPOSED_NOT_SCORED")}
    samples = spark.createDataFrame([("d", "1"), ("d", "4"), ("e", "1")], "dataset string, sample_id string")
    assert sorted(tuple(r) for r in registry.untouched(samples, registry.exposures(spark, path)).collect()) == [("d", "4"), ("e", "1")]


def test_a_writer_that_stops_before_its_marker_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "registry")
    spark.createDataFrame([("d", "1", "r", "dev", "m", True, True)], registry.ROW).write.parquet(f"{path}/data/orphan")
    assert registry.exposures(spark, path).collect() == []


def test_sums_before_and_wilcoxon_equal_plain_ranks(spark):
    rng = random.Random(3)
    rows = [(g, i, 0.0, float(rng.choice([-3, -2, -1, 0, 1, 2, 4]))) for g in "ab" for i in range(300)]
    got = {r.g: r for r in stats.wilcoxon(spark.createDataFrame(rows, "g string, id int, reference double, treatment double").repartition(6), ["g"]).collect()}
    for g in "ab":
        d = np.array([t for k, _, _, t in rows if k == g and t != 0])
        size = np.abs(d)
        ranks = np.array([(size < x).sum() + ((size == x).sum() + 1) / 2 for x in size])
        assert got[g].n == len(d) and abs(got[g].w_plus - ranks[d > 0].sum()) < 1e-9


def test_power_grows_with_the_study(spark):
    rng = random.Random(5)
    rows = [("x", i, 0.0, float(rng.random() < 0.3) - float(rng.random() < 0.15)) for i in range(80)]
    pairs = spark.createDataFrame(rows, "g string, id int, reference double, treatment double")
    small, large = (resample.empirical_power(pairs, ["g"], F.col("id"), 300, n).first() for n in (1, 4))
    assert small.trials == large.trials == 300 and small.power < large.power
    assert abs(small.power - stats.mcnemar_power(80, small.wins / 80, small.losses / 80)) < 0.2


def test_cells_that_nobody_expected(spark):
    expected = spark.createDataFrame([("d", "m", 2), ("d", "n", 1)], "dataset string, method string, expected long")
    items = spark.createDataFrame([(1, "d", "m", "ok"), (2, "d", "m", "question_timeout"), (3, "e", "m", "ok")], "id int, dataset string, method string, status string")
    got = {(r.dataset, r.method): r.blockers for r in audits.cell_report(expected, items, items.filter("id = 3"), ["id"]).collect()}
    assert got == {("d", "m"): "question_timeouts", ("d", "n"): "cell_count_mismatch", ("e", "m"): "unexpected_cell,record_audit_incomplete"}


def test_events_are_shuffled_once(spark):
    events = spark.createDataFrame([("k", i, f"p{i}", "kept") for i in range(4)], "k string, o int, payload string, other string")
    whole = audits.sealed(events, ["k"], "o", "payload")
    assert [r.other for r in whole.collect()] == ["kept"] * 4
    plan = audits.chain_breaks(whole, ["k"], "payload")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_ends_of_blocks_are_checked(spark):
    whole = audits.sealed(spark.createDataFrame([(i, f"p{i}") for i in range(30)], "o int, payload string").selectExpr("'k' AS k", "*"), ["k"], "o", "payload")
    assert audits.chain_breaks(whole, ["k"], "payload", block=7).collect() == []
    lost = whole.filter("place NOT IN (7, 8, 15) AND NOT place BETWEEN 20 AND 29")
    got = audits.chain_breaks(lost.withColumn("payload", F.when(F.col("place") == 3, "x").otherwise(F.col("payload"))), ["k"], "payload", block=7).collect()
    assert sorted((r.place, r.reason) for r in got) == [(3, "digest"), (9, "gap"), (16, "gap"), (30, "gap")]
