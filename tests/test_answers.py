"""Answer stages, guards, probes and classifiers on small cases."""

from pyspark.sql import functions as F

from quillspan.operators import probes
from quillspan.plans import answers as A


def generated(spark, model, texts=("alpha beta", "gamma"), **options):
    q = spark.createDataFrame([(1, "Q?", list(texts) if texts is not None else None)], "query_id long, question string, texts array<string>")
    r = A.generate_answers(q, model, **options).first()
    return r.answer, r.path, r.calls


def test_stages_fall_back_without_losing_an_answer(spark):
    def model(task, key, question, texts, n):
        return {"spans": ["beta", "made up", 7, " "], "select": texts[-1], "sample": ["The Beta", "x", "beta"][n % 3], "answer": ["", "late"][n % 2]}[task]

    assert generated(spark, model, select=True) == ("made up", "selected", 2)
    assert generated(spark, model, select=True, verify=True) == ("beta", "selected", 2)
    assert generated(spark, model, samples=3) == ("The Beta", "voted", 3)
    assert generated(spark, model) == ("late", "retry", 2)
    assert generated(spark, model, texts=()) == (None, "none", 0) and generated(spark, model, texts=None, select=True, samples=2) == (None, "none", 0)
    silent = lambda task, *a: [] if task == "spans" else ""
    assert generated(spark, silent, select=True, samples=2) == (None, "none", 5)
    assert generated(spark, lambda task, *a: {"spans": ["a"], "select": None, "sample": None}.get(task, "ok"), select=True, samples=1) == ("ok", "first", 4)


def test_votes_keep_the_first_form_and_ties(spark):
    d = spark.createDataFrame([(["b", "The A", "a!", "B", ""],), (["", " "],), ([],)], "t array<string>")
    assert [r.v for r in d.select(A.first_of_most(F.col("t")).alias("v")).collect()] == ["b", None, None]


def test_finalising(spark):
    rows = [(1, "strategyqa", "ok", ["e"], ["yes"], None), (2, "strategyqa", "empty", ["e"], ["maybe"], None), (3, "musique", "ok", [], ["yes"], "old"), (4, "hover", "timeout", ["e"], ["no"], "old"), (5, "musique", "ok", ["e"], ["no"], None)]
    results = spark.createDataFrame(rows, "query_id long, dataset string, status string, evidence array<string>, values array<string>, answer string")
    made = spark.createDataFrame([(i, "False", 2) for i in (1, 2, 3, 4)], "query_id long, answer string, calls int")
    got = {r.query_id: tuple(r)[1:] for r in A.finalise(results, made).collect()}
    assert got == {1: ("True", "ok", 2, True, False), 2: ("False", "ok", 2, False, True), 3: ("old", "ok", 0, False, False), 4: ("old", "timeout", 0, False, False), 5: (None, "ok", 0, False, False)}


def test_rewrites_are_guarded(spark):
    cases = [("?x", "long rewrite", "?x"), ("?x born 7", "'born in seven'", "born in seven"), ("father of Cecil ?x", None, "father of Cecil ?x"), ("father of Cecil", "Father of Cecil", "father of Cecil"), ("father of Cecil", "Here's my thinking\nCecil parent\n", "Cecil parent"), ("father of Cecil", "Here's\nHere", "Here's\nHere")]
    d = spark.createDataFrame([(s, r) for s, r, _ in cases], "s string, r string")
    assert [r.x for r in d.select(A.guarded_rewrite(F.col("s"), F.col("r")).alias("x")).collect()] == [w for _, _, w in cases]


def test_probes_unite_materialisations(spark):
    base = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "query_id long, pos long, rank int")
    alt = spark.createDataFrame([(1, "q", 12, 1), (1, "q", 10, 2), (2, "q", 21, 1)], "query_id long, variant string, pos long, rank int")
    rows = spark.createDataFrame([(1, True), (2, False)], "query_id long, has_rows boolean")
    got = probes.probe_recall(probes.probe_strategies(base, alt, rows, 1, 2), spark.createDataFrame([(1, 9), (2, 9)], "query_id long, question_id long"), spark.createDataFrame([(9, 10), (9, 21), (8, 1)], "question_id long, pos long")).collect()
    by = {r.strategy: (r.hit_count, r.extra_calls, r.full_support) for r in got}
    assert by == {"slot": (1, 0, False), "q": (1, 0, False), "slot_plus_q": (1, 2, False), "adaptive_empty_slot_plus_q": (1, 1, False)}


def test_specs(spark):
    cases = {"Did A sell more or less than B?": "ENTITY", "How many, and why?": "NUMBER", "What year did it end?": "NUMBER", "When?": "DATE", "Are they?": "BOOLEAN", "What are the rivers?": "MULTI", "Which is older?": "ENTITY", "": "ENTITY"}
    d = spark.createDataFrame([(c,) for c in cases], "q string")
    assert [r.c for r in d.select(probes.answer_spec(F.col("q"))["category"].alias("c")).collect()] == list(cases.values())
