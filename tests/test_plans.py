"""Plan invariants, compilation, optimization and execution."""

import pytest
from pyspark.sql import functions as F

from quillspan.operators import policy, stats
from quillspan.operators import evaluate as E
from quillspan.operators.retrieval import build_index
from quillspan.plans import compile as C
from quillspan.plans.execute import Relation, TableMaterializer, TextMaterializer, execute
from quillspan.plans.model import Join, LogicalPlan, Operator, PlanError, Slot, SlotPlan, structure
from quillspan.plans.optimize import SearchOptions, allocate, greedy_order, legal_orders, order_cost, regret, search
from quillspan.sources.providers import pattern_extractor


def two_slots(**kw):
    return SlotPlan([Slot("S1", "Founder", ["?person", "OpenAI"]), Slot("S2", "Founded", ["?person", "?company"])], ["?person", "?company"], [Join("S1", "person", "S2", "person")], **kw)


@pytest.mark.parametrize("joins,code", [([Join("S1", "person", "S9", "person")], "UNKNOWN_JOIN_SLOT"), ([], "DISCONNECTED"), ([Join("S1", "nobody", "S2", "nobody")], "UNDECLARED_JOIN_FIELD"), ([Join("S1", "person", "S1", "person")], "SELF_JOIN")])
def test_bad_plans_are_refused(joins, code):
    with pytest.raises(PlanError) as e:
        SlotPlan(two_slots().slots, ["?person"], joins)
    assert e.value.code == code


def test_templates():
    plan = C.compile_question("Which film has the director who was born first, Find Me Guilty or Tear Gas Squad?")
    assert [s.predicate for s in plan.slots] == ["DirectorOf", "BirthDate"] * 2 and plan.operators[0].kind == "field_argmin" and plan.operators[0].labels == ["Find Me Guilty", "Tear Gas Squad"]
    assert C.director_extremum("Which film has the director who was born first, A or A?") is None
    assert C.polar_comparison("Are both rivers in Asia?").slots[0].types == {"answer": "boolean"}
    assert C.polar_comparison("Can you tell both?") is None and C.polar_comparison("Which are the same?") is None
    assert C.compile_question("How many months after the war did the treaty start?").operators[0].operation == "date_diff_months"
    assert structure(plan)["topology"] == "complex" or structure(plan)["hops"] >= 3


def test_provider_gets_its_error_back():
    seen = []

    def provider(question, error):
        seen.append(error)
        if error is None:
            raise PlanError("UNGROUNDED", "try again")
        return two_slots()

    assert len(C.compile_question("Which company did the founder of OpenAI found?", provider).slots) == 2
    assert seen[0] is None and "try again" in seen[1]


def test_rewrites():
    fixed = C.repair_joins(two_slots().slots, [Join("S1", "wrong", "S2", "person")])
    assert fixed == [Join("S1", "person", "S2", "person")]
    slots = [Slot("S1", "Birth", ["Ann", "?a"]), Slot("S2", "Birth", ["Bob", "?b"]), Slot("S3", "DateCompare", ["?a", "?b"])]
    kept, joins, ops, n = C.rewrite_functions(slots, [], [], "Who was born later, Ann or Bob?")
    assert n == 1 and [s.id for s in kept] == ["S1", "S2"] and ops[0].kind == "field_argmax" and ops[0].labels == ["Ann", "Bob"]
    anchor = SlotPlan([Slot("S1", "Entity", ["?x", "Paris"]), Slot("S2", "MayorOf", ["?m", "?x"])], ["?m"], [Join("S1", "x", "S2", "x")])
    folded, n = C.fold_anchors(anchor, "Who is the mayor of Paris?")
    assert n == 1 and folded.slots[0].arguments == ["?m", "Paris"]
    chain = SlotPlan([Slot(f"S{i}", "R", [f"?v{i}", f"?v{i + 1}"], cardinality=10 * i + 1) for i in range(4)], ["?v0"], [Join(f"S{i}", f"v{i + 1}", f"S{i + 1}", f"v{i + 1}") for i in range(3)])
    assert [s.id for s in C.prune(chain, 2).slots] == ["S0", "S1"]


def test_optimizer():
    chain = SlotPlan([Slot(f"S{i}", "R", [f"?v{i}", f"?v{i + 1}"], cardinality=c) for i, c in enumerate((50, 5, 8))], ["?v0"], [Join("S0", "v1", "S1", "v1"), Join("S1", "v2", "S2", "v2")])
    plan = LogicalPlan.of(chain)
    assert plan.problems() == [] and greedy_order(plan)[0] == "S0"
    best, told = search(plan, SearchOptions(budget=8, importance={"S1": 3.0}))
    assert sum(best.calls.values()) == 8 and min(best.calls.values()) >= 1 and best.calls["S1"] == max(best.calls.values()) and told["considered"] == 2 * len(legal_orders(plan, 256))
    with pytest.raises(ValueError):
        allocate(["a", "b", "c"], {}, 2)
    assert order_cost(["a", "b"], {"a": 2, "b": 3}) == 8 and regret(["b", "a"], {"a": 2, "b": 3}) == 1


def test_execution_joins_and_stops(spark):
    t = spark.createDataFrame([(1, "Ada", "OpenAI"), (2, "Bob", "Other")], "id long, person string, org string")
    f = spark.createDataFrame([(1, "Ada", "X"), (2, "Bob", "Y")], "id long, person string, company string")
    source = TableMaterializer({"Founder": Relation(t, ["person", "org"], "id"), "Founded": Relation(f, ["person", "company"], "id")})
    out = execute(two_slots(), source, budget=4)
    assert out.status == "ok" and out.order == ["S1", "S2"] and out.observed == {"S1": 1, "S2": 1} and [(r.person, r.company) for r in out.rows.collect()] == [("Ada", "X")]
    assert execute(two_slots(), source, budget=4, late=True).rows.count() == 1
    assert execute(two_slots(), source, budget=1).status == "budget_exceeded"
    nobody = TableMaterializer({"Founder": Relation(t.filter("false"), ["person", "org"], "id"), "Founded": Relation(f, ["person", "company"], "id")})
    assert execute(two_slots(), nobody, budget=4).status == "empty"


def test_text_materializer_keeps_grounded_rows(spark):
    passages = spark.createDataFrame([(0, "Ada founded X. Unrelated."), (1, "Nothing here.")], "pos long, text string")
    source = TextMaterializer(build_index(passages), pattern_extractor({"Founded": r"(?P<person>\w+) founded (?P<company>\w+)"}))
    plan = SlotPlan([Slot("S1", "Founded", ["?person", "?company"])], ["?company"])
    assert [r.company for r in execute(plan, source, budget=1).rows.collect()] == ["X"]


def test_beam_widths(spark):
    def width(conf):
        rows = [(0, f"s{i}", c, n) for i, (n, c) in enumerate(conf)]
        d = spark.createDataFrame(rows, "query_id long, _source_id string, _confidence double, x string")
        return [r.x for r in policy.beam_select(policy.beam_candidates(d, ["x"]), most=3).orderBy("beam_rank").collect()]

    assert width([("Grace", 0.35), ("Ada", 0.95), ("Ada", 0.80)]) == ["Ada", "Grace"][: len(width([("Grace", 0.35), ("Ada", 0.95), ("Ada", 0.80)]))]
    assert len(width([("a", 0.32), ("b", 0.36), ("c", 0.40)])) == 3


def test_states_only_rise(spark):
    s = spark.createDataFrame([("r1", "satisfied"), ("r2", "unresolved")], "requirement_id string, status string")
    o = spark.createDataFrame([("r1", 0, 2, False), ("r2", 1, 2, False), ("r3", 2, 2, True)], "requirement_id string, covered int, total int, any_evidence boolean")
    assert {r.requirement_id: r.status for r in policy.advance(s, o).collect()} == {"r1": "satisfied", "r2": "partial", "r3": "satisfied"}


def test_mcnemar_and_power():
    p = stats.mcnemar_p(5, 0)
    assert p["p_exact"] == 0.0625 and p["p_mid"] < 0.05 and stats.mcnemar_p(0, 0)["p_exact"] == 1.0
    assert stats.mcnemar_p(5, 0, two_sided=False)["p_exact"] == 1 / 32
    n = stats.required_n(0.2, 0.1)
    assert stats.mcnemar_power(n, 0.2, 0.1) >= 0.8 > stats.mcnemar_power(n - 1, 0.2, 0.1)
    assert stats.bootstrap_vector([1.0], [0.0])["ci_low"] is None


def test_answers(spark):
    d = spark.createDataFrame([("The Cat, sat!", ["cat sat"]), ("4 yards", ["four yards", "4.0"]), ("", [""])], "p string, a array<string>")
    got = d.select(E.exact_match(F.col("p"), F.col("a")).alias("em"), E.token_f1(F.col("p"), F.col("a")).alias("f1"), E.drop_scores("p", "a").alias("d")).collect()
    assert [r.em for r in got] == [1.0, 0.0, 1.0] and got[0].f1 == 1.0 and got[2].f1 == 1.0
    assert got[1].d.f1 == 0.67 and got[1].d.em == 0.0


def test_evidence_golden(spark):
    ranked = spark.createDataFrame([("q", "d2#0", 1), ("q", "d3#0", 2), ("q", "d1#0", 3), ("n", "x", 1)], "query_id string, item string, rank int")
    gold = spark.createDataFrame([("q", "d1#0"), ("q", "d2#0")], "query_id string, item string")
    got = {r.query_id: r for r in E.evidence_scores(ranked, gold).collect()}
    assert (got["q"].hit_1, got["q"].recall_1, got["q"].recall_5, got["q"].precision_5, got["q"].mrr) == (1.0, 0.5, 1.0, 0.4, 1.0) and got["n"].recall is None


def test_bundles_spend_the_calls_that_they_are_allocated(spark):
    texts = ["Ann founded X", "Bob founded Y", "Ann founded X and Ann founded X", "something else"]
    passages = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "pos long, title string, text string")
    shape = pattern_extractor({"Founded": r"(?P<person>\w+) founded (?P<company>\w+)"})
    slot = Slot(id="s1", predicate="Founded", arguments=["?person", "?company"])
    one = TextMaterializer(build_index(passages), shape, top_k=2)
    both = TextMaterializer(one.index, shape, top_k=2, question="who is Bob")
    each = TextMaterializer(one.index, shape, top_k=2, question="who is Bob", per_path=True)
    assert (one.cost(2, False), both.cost(1, False), both.cost(2, True)) == (1, 1, 2)
    assert TextMaterializer(one.index, shape, 2, "q", bound_single=True).cost(2, True) == 1
    got = lambda m, calls: sorted((r.pos, r.person) for r in m.rows(slot, None, calls).collect())
    assert (1, "Bob") in got(both, 2) and set(got(both, 1)) == set(got(one, 1)) == set(got(one, 2))
    assert got(each, 2) == sorted(set(got(both, 2))), "equal rows of one source stay once"
    assert got(one.expanded(4), 1) == [(0, "Ann"), (1, "Bob"), (2, "Ann"), (2, "Ann")]


def test_bridges_mend_empty_slots_and_broken_joins(spark):
    asked = []

    class Source:
        def rows(self, slot, contexts, calls):
            asked.append((slot.id, None if contexts is None else sorted(tuple(r) for r in contexts.drop("pos").collect())))
            if slot.id == "a":
                data, names = [("Ann", "X")], ["person", "firm"]
            elif contexts is not None and any("Y" in tuple(r) or "X" in tuple(r) for r in contexts.drop("pos").collect()) and len(asked) > 2:
                data, names = [("X", "Rome")], ["firm", "city"]
            else:
                data, names = self.first, ["firm", "city"]
            schema = ", ".join(f"{n} string" for n in names)
            rows = spark.createDataFrame(data, schema)
            return rows.selectExpr(*names, f"'{slot.id}' AS _slot_id", "'1' AS _source_id", "'t' AS _source_span", "1.0D AS _confidence", "1.0D AS _retrieval_score", "0L AS pos")

    slots = [Slot(id="a", predicate="Works", arguments=["?person", "?firm"]), Slot(id="b", predicate="Seat", arguments=["?firm", "?city"])]
    plan = SlotPlan(slots=slots, joins=[Join(left_slot="a", left_field="firm", right_slot="b", right_field="firm")], outputs=["?city"])
    propose = lambda slot, variable, texts: ["", "X", "X", "Y"]
    for first in ([], [("Z", "Oslo")]):
        asked.clear()
        Source.first = first
        assert execute(plan, Source(), budget=4, strategy="question").status == "empty"
        asked.clear()
        out = execute(plan, Source(), budget=4, strategy="question", bridge=propose)
        assert out.status == "ok" and out.bridges == 1 and out.calls == 3
        assert [r.city for r in out.rows.collect()] == ["Rome"]
        out.release()
        asked.clear()
        assert execute(plan, Source(), budget=2, strategy="question", bridge=propose).status == "empty"
