"""Loss stages, development examples and row checks on hand-made traces."""

import pytest

from quillspan.operators import traces

BIND = "array<struct<source_id:string,bindings:map<string,string>>>"
MAT = f"struct<searches:array<struct<candidates:array<struct<source_id:string>>>>,selected_source_ids:array<string>,extracted_rows:{BIND},binding_context:map<string,string>,retrieval_calls:int>"
ITEM = f"question_id string, gold array<string>, answers array<string>, gold_answer string, prediction string, em double, available array<string>, slot_traces array<struct<slot_id:string,variables:array<string>,materializations:array<{MAT}>>>, evidence {BIND}, rows {BIND}"


def mat(candidates, selected, rows=(), context=None, calls=1):
    return ([([(c,) for c in candidates],)], list(selected), [(s, b) for s, b in rows], context, calls)


def item(q, gold, steps, evidence=(), rows=(), gold_answer="Ada Byron", prediction=None, em=None, available=None, answers=None):
    return (q, gold, answers or [gold_answer], gold_answer, prediction, em, available, [(f"S{i}", ["who"], list(ms)) for i, ms in enumerate(steps)] if steps is not None else None, [(s, {}) for s in evidence], [(s, {"who": v}) for s, v in rows])


def row(v, s="g"):
    return (s, {"who": v})


def test_every_stage(spark):
    full = [[mat(["g", "n"], ["g"], [row("ada  BYRON")])]]
    two = [*full, [mat(["n"], ["n"])]]
    cases = {
        "hit": (item("hit", ["g"], None, prediction="ada  byron"), "EM_HIT"),
        "em": (item("em", ["zz"], None, prediction="x", em=1.0), "EM_HIT"),
        "s0": (item("s0", ["g", "h"], full, ["g", "h"]), "S0_GOLD_SOURCE_NOT_RETRIEVED"),
        "bundle": (item("bundle", ["g"], [[mat([], ["g"])]], ["g"], [], available=["g"]), "S3_BUNDLE_EMPTY_OR_PARTIAL"),
        "s1": (item("s1", ["g"], [[mat(["g", "n"], ["n"])]], ["n"]), "S1_GOLD_SOURCE_NOT_SELECTED"),
        "s2": (item("s2", ["g"], [[mat(["g", "n"], ["g"])]], ["n"], [("n", "x")]), "S2_GOLD_SOURCE_NOT_BUNDLED"),
        "s3": (item("s3", ["g"], full, ["g"]), "S3_BUNDLE_EMPTY_OR_PARTIAL"),
        "s5": (item("s5", ["g"], [[mat(["g"], ["g"], [row("Ada")])]], ["g"], [("g", "Byron")]), "S5_GOLD_BINDING_MISSING"),
        "s6": (item("s6", ["g"], [[mat(["g"], ["g"], [row("Ada Byron"), row("Bob")])]], ["g"], [("g", "Bob")], prediction="Bob"), "S6_ENTITY_SELECTION_ERROR"),
        "s8": (item("s8", ["g"], two, ["g"], [("g", "Ada Byron")], prediction="Countess Ada Byron"), "S8_GENERATION_EM_WRONG"),
        "f1": (item("f1", ["g"], two, ["g"], [("g", "Ada Byron")], prediction="Ada"), "S8_GENERATION_EM_WRONG"),
        "low": (item("low", ["g"], full, ["g"], [("g", "Ada Byron")], prediction="nobody"), "S6_ENTITY_SELECTION_ERROR"),
        "s9": (item("s9", ["g"], two, ["g"], [("g", "Ada Byron")], prediction="nobody"), "S9_UNRESOLVED"),
        "none": (("none", *[None] * 9), "S3_BUNDLE_EMPTY_OR_PARTIAL"),
    }
    got = {r.question_id: (r.stage, r.confidence) for r in traces.loss_stage(spark.createDataFrame([c for c, _ in cases.values()], ITEM)).collect()}
    assert {q: s for q, (s, _) in got.items()} == {q: s for q, (_, s) in cases.items()}
    assert got["low"][1] == "low" and got["s6"][1] == "high"


def test_development_examples_fold_calls_and_gold(spark):
    rows = [
        item("strong", ["Alpha#0#chunk-2", "Beta#0"], [
            [mat(["noise#0", "Alpha#0"], ["noise#0"])],  # gold among the candidates, not selected
            [mat(["gone"], ["gone"], calls=5)],  # nothing known was selected: skipped, no calls
            [mat(["Alpha#0"], ["Alpha#0"], [("Alpha#0", {"who": " "})]), mat(["Alpha#0", "Alpha#0", "lost"], ["Alpha#0"], [("Alpha#0", {"who": "Ada"}), ("lost", {"who": "x"})], calls=2)],
            [mat(["Beta#0"], ["Beta#0"], [("Beta#0", {})], {"who": "Ada"})],
        ]),
        item("weak", [], [[mat(["Alpha#0"], ["Alpha#0"], [("Alpha#0", {"who": "ADA!"})])], [mat(["noise#0"], ["noise#0"], [("noise#0", {"who": "Ada"})])]], answers=["Ada"]),
        item("empty", ["x"], None),
    ]
    passages = spark.createDataFrame([("noise#0", "Unrelated."), ("Alpha#0", "Ada founded Alpha."), ("Beta#0", "Beta.")], "source_id string, text string")
    got = traces.development_examples(spark.createDataFrame(rows, ITEM), passages).orderBy("question_id", "trace_no", "materialization_no").collect()
    cols = ["supervision", "label", "expand_topk_recoverable", "complete_rows", "missing", "calls_used", "remaining_depth", "covered_gold"]
    assert [tuple(r[c] for c in cols) for r in got] == [
        ("strong_gold_evidence", 0, True, 0, 0, 1, 3, 0), ("strong_gold_evidence", 0, False, 0, 0, 2, 1, 1), ("strong_gold_evidence", 1, False, 1, 2, 4, 1, 1), ("strong_gold_evidence", 1, False, 1, 0, 5, 0, 2),
        ("weak_answer_surface", 1, False, 1, 0, 1, 1, 0), ("weak_answer_surface", 0, False, 1, 0, 2, 0, 0),
    ]


@pytest.mark.parametrize("cells, outcome, reason", [
    ([("Ada", "7", "yes", None)], "accepted", None),
    ([("Ada", "7", "yes", None), ("Ada", "8", "no", None)], "abstain_disagreement", None),
    ([("Ada", "7", "unknown", None)], "abstain_disagreement", None),
    ([("Ada", "7", "maybe", None), ("Ada", "8", "no", None)], "repair", "boolean_invalid"),
    ([("Ada", "seven", "yes", None)], "abstain_typed", "typed_invalid"),
    ([("Bob", "7", "yes", "Ada")], "repair", "propagated_mismatch"),
    ([("Zoe", "7", "yes", "zoé")], "repair", "propagated_ungrounded"),
    ([("Mr Ada", "7", "yes", None)], "abstain_role", "role_conflict"),
    ([("secret", "7", "yes", None)], "repair", "copies_protected"),
    ([("", "7", "yes", None)], "repair", "incomplete"),
    ([("Ada", "7", "yes", None), ("Ada", "x", " YES ", None)], "accepted", "typed_invalid"),
])
def test_contexts_and_reasons(spark, cells, outcome, reason):
    rows = spark.createDataFrame([(1, i, "p", *c, ["Secret"]) for i, c in enumerate(cells)], "context_id long, pos int, source_id string, mother string, n string, ok string, known_mother string, protected array<string>")
    passages = spark.createDataFrame([("p", "Ada was here.")], "source_id string, text string")
    good, verdict = traces.validate_extraction(rows, {"mother": "string", "n": "number", "ok": "boolean"}, passages)
    v = verdict.first()
    assert v.outcome == outcome and (reason is None or v[reason] == 1) and v.accepted == good.count() == (outcome == "accepted")
    assert verdict.count() == 1
    assert traces.validate_extraction(rows.withColumnRenamed("source_id", "s").selectExpr("*", "'zz' AS source_id").drop("s"), {"mother": "string", "n": "number", "ok": "boolean"}, passages)[1].first()["unknown_source"] + v["boolean_invalid"] + v["typed_invalid"] + v["propagated_mismatch"] >= 1
