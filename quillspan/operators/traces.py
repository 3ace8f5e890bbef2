"""Nested run traces: where gold evidence was lost, development examples, and checks of extracted rows.

A trace row has ``gold`` (array of ids), ``slot_traces`` (array of (slot_id, variables, materializations)) and, in each
materialisation, ``searches`` with ``candidates``, ``selected_source_ids``, ``extracted_rows``, ``binding_context`` and
``retrieval_calls``. What concerns one question is read inside its row, without a shuffle; only passages are looked up by joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words, canonical_id, grounded, plain_answer, role_conflict
from ..functions.values import typed
from ..sources.scratch import written

_NONE = "array<string>"


def _ids(c: Column) -> Column:
    """Distinct ids that are neither null nor empty; no array is an empty one."""
    return F.array_distinct(F.filter(F.coalesce(c, F.array().cast(_NONE)), lambda x: x.isNotNull() & (x != "")))


def _flat(c: Column) -> Column:
    return F.flatten(F.filter(c, lambda x: x.isNotNull()))


def _plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _words(c: Column) -> Column:
    return F.filter(F.split(_plain(F.coalesce(c, F.lit(""))), " "), lambda t: t != "")


def _values(bindings: Column) -> Column:
    """The filled values of an array of maps."""
    return F.filter(_flat(F.transform(F.filter(bindings, lambda m: m.isNotNull()), F.map_values)), lambda v: v.isNotNull() & (F.trim(v) != ""))


def multiset_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of words as multisets; 0 where either is empty."""
    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, t: n + F.least(F.size(F.filter(a, lambda x: x == t)), F.size(F.filter(b, lambda x: x == t))))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * shared / (F.size(a) + F.size(b))).otherwise(0.0)


def loss_stage(items: DataFrame) -> DataFrame:
    """Append (stage, confidence): the first level of a trace that lost what the answer needed.

    ``items``: gold, available (candidates of bundles, used where no search lists any), slot_traces, evidence and rows (arrays of
    (source_id, bindings)), gold_answer, prediction, em. Stages: EM_HIT; S0 a gold id is no candidate; S1 none selected it; S2
    it is in neither evidence nor rows; S3 no rows; S5 no binding holds the answer's words; S6 another bound value was chosen; S8 the
    answer is there but not exact; S9 unresolved. Absent arrays are empty; ids are compared as they are.
    """
    mats = _flat(F.col("slot_traces.materializations"))
    searched = _ids(_flat(_flat(F.transform(mats, lambda m: F.transform(F.coalesce(m["searches"]["candidates"], F.array()), lambda c: c["source_id"])))))
    pool = F.when(F.size(searched) > 0, searched).otherwise(_ids(F.col("available")))
    evidence, in_rows = _ids(F.col("evidence.source_id")), _ids(F.col("rows.source_id"))
    chosen = F.array_union(_ids(_flat(F.transform(mats, lambda m: m["selected_source_ids"]))), evidence)
    lost = lambda have: F.size(F.array_except(_ids(F.col("gold")), F.col(have))) > 0
    bound = F.concat(_values(_flat(F.transform(mats, lambda m: m["extracted_rows"]["bindings"]))), _values(F.col("rows.bindings")))
    more = F.concat(F.col("__bound"), _values(F.col("evidence.bindings")))
    covers = lambda words: F.size(F.array_except(F.col("__want"), words)) == 0
    want, said = F.array_distinct(_words(F.col("gold_answer"))), _words(F.col("prediction"))
    right = (F.coalesce(F.col("em"), F.lit(0.0)) >= 1) | ((F.size("__said") > 0) & (F.size("__want") > 0) & (_plain(F.col("prediction")) == _plain(F.col("gold_answer"))))
    read = items.withColumns({"__pool": pool, "__chosen": chosen, "__kept": F.array_union(evidence, in_rows), "__bound": bound, "__want": want, "__said": said})
    read = read.withColumns({"__all": F.array_distinct(F.transform(more, _plain)), "__named": covers(F.col("__said")) & (F.size("__said") > 0)})
    has_words = F.size("__want") > 0
    in_trace = F.exists("__bound", lambda v: covers(_words(v)))
    chosen_wrong = (F.size("__all") > 1) & F.exists("__all", lambda v: covers(_words(v))) & ~F.col("__named")
    exact = F.col("__named") | (multiset_f1(F.col("__said"), _words(F.col("gold_answer"))) >= 0.6)
    rules = [
        (F.coalesce(right, F.lit(False)), "EM_HIT", "high"), (lost("__pool"), "S0_GOLD_SOURCE_NOT_RETRIEVED", "high"), (lost("__chosen"), "S1_GOLD_SOURCE_NOT_SELECTED", "high"),
        (lost("__kept"), "S2_GOLD_SOURCE_NOT_BUNDLED", "medium"), (F.size(F.coalesce("rows", F.array())) == 0, "S3_BUNDLE_EMPTY_OR_PARTIAL", "high"),
        (has_words & ~in_trace, "S5_GOLD_BINDING_MISSING", "high"), (chosen_wrong, "S6_ENTITY_SELECTION_ERROR", "high"), (exact, "S8_GENERATION_EM_WRONG", "high"),
        (F.size(F.coalesce("slot_traces", F.array())) <= 1, "S6_ENTITY_SELECTION_ERROR", "low"),
    ]
    stage = F.struct(F.lit("S9_UNRESOLVED").alias("stage"), F.lit("low").alias("confidence"))
    for test, name, sure in reversed(rules):
        stage = F.when(test, F.struct(F.lit(name).alias("stage"), F.lit(sure).alias("confidence"))).otherwise(stage)
    return read.withColumn("__s", stage).select(*items.columns, "__s.stage", "__s.confidence")


# ---- development examples -------------------------------------------------------------------

_EXAMPLE = (
    "struct<slot_id:string,trace_no:int,materialization_no:int,supervision:string,label:int,gold_selected:boolean,candidate_gold_available:boolean,expansion_available:boolean,"
    "expand_topk_recoverable:boolean,selected_count:int,candidate_count:int,complete_rows:int,missing:int,calls_used:long,remaining_depth:int,covered_gold:int>"
)
_STATE = f"struct<calls:long,covered:array<string>,out:array<{_EXAMPLE}>>"


def known_sources(items: DataFrame, passages: DataFrame, key: str = "question_id") -> DataFrame:
    """(question, known): the question's candidates and sources that have a passage, and whether it holds an answer."""
    mats = F.explode(_flat(F.col("slot_traces.materializations"))).alias("m")
    answers = F.transform(F.coalesce("answers", F.array().cast(_NONE)), plain_answer).alias("answers")
    ids = items.select(key, answers, mats).select(key, "answers", F.explode(F.array_union(_ids(_flat(F.transform(F.col("m.searches"), lambda s: s["candidates"]["source_id"]))), _ids(F.col("m.extracted_rows.source_id")))).alias("source_id")).distinct()
    held = ids.join(passages.select("source_id", F.concat(F.lit(" "), plain_answer(F.col("text")), F.lit(" ")).alias("__t")), "source_id")
    answered = F.exists("answers", lambda a: (a != "") & F.contains(F.col("__t"), F.concat(F.lit(" "), a, F.lit(" "))))
    return held.select(key, F.struct("source_id", answered.alias("answered")).alias("e")).groupBy(key).agg(F.map_from_entries(F.collect_list("e")).alias("known"))


def development_examples(items: DataFrame, passages: DataFrame, key: str = "question_id") -> DataFrame:
    """One row for each materialisation of a trace: its label, what a wider window would have found, and the budget so far.

    Each materialisation is judged by itself; a fold over the ordered ones carries the retrieval calls and the set of gold ids selected so far. With gold ids
    the label is strong: a gold passage was selected and gave a row, and some row fills all requested variables. Without, it
    is weak: an answer stands in a selected passage and in a row. Materialisations whose selected sources have no passage at
    all are skipped and use no calls. ``passages`` has unique (source_id, text); candidates count once, in order of appearance.
    """
    both = items.join(known_sources(items, passages, key), key, "left").withColumns({
        "known": F.coalesce("known", F.create_map().cast("map<string,boolean>")),
        "__gold": _ids(F.transform("gold", lambda g: F.substring_index(g, "#chunk-", 1))),
        "__answers": F.transform(F.coalesce("answers", F.array().cast(_NONE)), plain_answer),
    })
    depth = F.size("slot_traces")
    flat = _flat(F.transform("slot_traces", lambda t, i: F.transform(F.coalesce(t["materializations"], F.array()), lambda m, j: F.struct(i.alias("i"), j.alias("j"), t["slot_id"].alias("slot_id"), t["variables"].alias("variables"), m.alias("m")))))

    def read(x: Column) -> Column:
        m = x["m"]
        asked = _ids(_flat(F.transform(m["searches"], lambda s: s["candidates"]["source_id"])))
        requested = F.array_except(F.coalesce(x["variables"], F.array().cast(_NONE)), F.map_keys(F.coalesce(m["binding_context"], F.create_map().cast("map<string,string>"))))
        rows = F.coalesce(m["extracted_rows"], F.array())
        held = F.filter(rows, lambda r: F.map_contains_key("known", r["source_id"]))
        found = F.transform(F.filter(asked, lambda c: F.map_contains_key("known", c)), lambda c: F.struct(c.alias("id"), canonical_id(c).alias("canon"), F.coalesce(F.array_contains(m["selected_source_ids"], c), F.lit(False)).alias("selected")))
        given = F.size(F.coalesce(m["selected_source_ids"], F.array().cast(_NONE))) > 0
        return F.struct(x["slot_id"].alias("slot_id"), x["i"].alias("i"), x["j"].alias("j"), F.size(asked).alias("asked"), requested.alias("requested"), F.size(rows).alias("rows"), held.alias("held"), found.alias("found"), given.alias("given"), F.coalesce(m["retrieval_calls"], F.lit(0)).alias("calls"))

    def sets(x: Column) -> Column:
        selected = F.filter(x["found"], lambda c: c["selected"])
        stated = F.concat(F.lit(" "), F.array_join(F.transform(_values(x["held"]["bindings"]), plain_answer), " "), F.lit(" "))
        complete = F.filter(x["held"], lambda r: F.forall(x["requested"], lambda v: F.trim(F.coalesce(F.try_element_at(r["bindings"], v), F.lit(""))) != ""))
        return F.struct(
            *[x[c].alias(c) for c in ("slot_id", "i", "j", "calls")], (x["asked"] - F.size(x["found"]) + x["rows"] - F.size(x["held"])).alias("missing"), ((F.size(selected) == 0) & x["given"]).alias("skip"), F.size(complete).alias("complete"),
            F.array_distinct(selected["canon"]).alias("chosen"), F.array_distinct(x["found"]["canon"]).alias("pool"), F.exists(selected, lambda c: F.try_element_at("known", c["id"])).alias("seen"), stated.alias("stated"),
            F.exists(x["held"], lambda r: F.array_contains("__gold", canonical_id(r["source_id"]))).alias("row_gold"),
        )

    def judged(x: Column) -> Column:
        hit, within = F.arrays_overlap(x["chosen"], "__gold"), F.arrays_overlap(x["pool"], "__gold")
        said = F.exists("__answers", lambda a: (a != "") & F.contains(x["stated"], F.concat(F.lit(" "), a, F.lit(" "))))
        label = F.when(strong, hit & x["row_gold"] & (x["complete"] > 0)).otherwise(x["seen"] & said)
        example = F.struct(
            x["slot_id"], x["i"], x["j"], F.when(strong, "strong_gold_evidence").otherwise("weak_answer_surface"), F.coalesce(label, F.lit(False)).cast("int"), strong & hit, strong & within, F.size(F.array_except(x["pool"], x["chosen"])) > 0,
            strong & ~hit & within, F.size(x["chosen"]), F.size(x["pool"]), x["complete"], x["missing"], x["calls"], F.greatest(depth - x["i"] - 1, F.lit(0)), F.lit(0),
        ).cast(_EXAMPLE)
        return F.struct(example.alias("example"), F.array_intersect(x["chosen"], "__gold").alias("gold"))

    def step(state: Column, x: Column) -> Column:
        calls, covered = state["calls"] + x["example"]["calls_used"], F.array_union(state["covered"], x["gold"])
        example = x["example"].withField("calls_used", calls).withField("covered_gold", F.size(covered))
        return F.struct(calls.alias("calls"), covered.alias("covered"), F.concat(state["out"], F.array(example)).alias("out")).cast(_STATE)

    strong = F.size("__gold") > 0
    start = F.struct(F.lit(0).cast("long").alias("calls"), F.array().cast(_NONE).alias("covered"), F.array().cast(f"array<{_EXAMPLE}>").alias("out")).cast(_STATE)
    # each transform names what the next one reads again and again, so that nothing is worked out twice
    steps = F.transform(F.filter(F.transform(F.transform(flat, read), sets), lambda x: ~x["skip"]), judged)
    return both.select(key, F.explode(F.aggregate(steps, start, step, lambda s: s["out"])).alias("e")).select(key, "e.*")


# ---- extracted rows -------------------------------------------------------------------------

REASONS = ["boolean_invalid", "typed_invalid", "propagated_mismatch", "unknown_source", "propagated_ungrounded", "copies_protected", "role_conflict", "incomplete"]


def validate_extraction(rows: DataFrame, kinds: dict[str, str], passages: DataFrame, key: str = "context_id") -> tuple[DataFrame, DataFrame]:
    """(accepted rows, verdict of each context) of extracted rows, by one conflict-resolving aggregate.

    ``rows``: key, pos, source_id, a string column for each field of ``kinds`` (string, number, date, boolean), ``known_<field>``
    where a value was propagated, optionally ``protected`` (array of upstream values that a row must not copy). Each row gets
    the first reason that rejects it, in the order of ``REASONS``; typed cells come back in canonical form. A context abstains if a boolean field
    is answered in two ways or by "unknown", or if all of its rows fail their types or their roles; a boolean cell
    that is neither yes, no nor unknown, or rows that are all rejected otherwise, ask for a repair.
    Verdict: outcome, rows, accepted and the count of each reason. Rows are checked once and written, for verdicts and accepted rows to read.
    """
    text = passages.select("source_id", ascii_words(F.col("text")).alias("__text"))
    df = rows.join(text, "source_id", "left")
    plain, clean = {}, {}
    for f, kind in kinds.items():
        plain[f"__c_{f}"] = F.lower(F.trim(f)) if kind == "boolean" else typed(F.col(f), kind)
        clean[f] = F.col(f"__c_{f}")
        plain[f"__p_{f}"] = ascii_words(F.col(f))
        if f"known_{f}" in rows.columns:
            plain[f"__k_{f}"] = ascii_words(F.col(f"known_{f}"))
    df = df.withColumns(plain)
    given = [f for f in kinds if f"known_{f}" in rows.columns]
    some = lambda tests: F.coalesce(sum((F.coalesce(t, F.lit(False)).cast("int") for t in tests), F.lit(0)) > 0, F.lit(False))
    free = lambda f: F.col(f"known_{f}").isNull() if f in given else F.lit(True)
    bools = [f for f, k in kinds.items() if k == "boolean"]
    filled = lambda f: F.trim(F.coalesce(f, F.lit(""))) != ""
    tests = {
        "boolean_invalid": some([~F.coalesce(clean[f], F.lit("")).isin("yes", "no", "unknown") for f in bools]),
        "typed_invalid": some([filled(f) & clean[f].isNull() for f, k in kinds.items() if k in ("number", "date")]),
        "propagated_mismatch": some([F.col(f"known_{f}").isNotNull() & ~F.col(f"__p_{f}").eqNullSafe(F.col(f"__k_{f}")) for f in given]),
        "unknown_source": F.col("__text").isNull(),
        "propagated_ungrounded": some([F.col(f"known_{f}").isNotNull() & ~grounded(F.col(f"__k_{f}"), F.col("__text")) for f in given]),
        "copies_protected": some([free(f) & F.array_contains(F.transform("protected", lambda a: F.lower(F.trim(a))), F.lower(F.trim(f))) for f, k in kinds.items() if k == "string"]) if "protected" in rows.columns else F.lit(False),
        "role_conflict": some([role_conflict(F.lit(f.replace("_", " ")), F.col(f"__p_{f}")) for f, k in kinds.items() if k == "string"]),
        "incomplete": some([~filled(f) for f in kinds]),
    }
    reason = F.lit(None).cast("string")
    for name in reversed(REASONS):
        reason = F.when(tests[name], name).otherwise(reason)
    checked = written(df.select(key, "pos", "source_id", *[f"__c_{f}" for f in kinds], reason.alias("__reason")), "checked-rows")
    verdicts = [F.count_distinct(F.when(clean[f].isin("yes", "no"), clean[f])).alias(f"__n_{f}") for f in bools] + [F.count_if(clean[f] == "unknown").alias(f"__u_{f}") for f in bools]
    each = checked.groupBy(key).agg(F.count("*").alias("rows"), *[F.count_if(F.col("__reason") == r).alias(r) for r in REASONS], *verdicts)
    split = some([(F.col(f"__n_{f}") != 1) | (F.col(f"__u_{f}") > 0) for f in bools])
    rejected = sum((F.col(r) for r in REASONS), F.lit(0))
    outcome = (
        F.when(F.col("boolean_invalid") > 0, "repair").when(split, "abstain_disagreement").when(F.col("typed_invalid") == F.col("rows"), "abstain_typed")
        .when(F.col("role_conflict") == F.col("rows"), "abstain_role").when(rejected == F.col("rows"), "repair").otherwise("accepted")
    )
    verdict = each.withColumn("outcome", outcome).withColumn("accepted", F.when(F.col("outcome") == "accepted", F.col("rows") - rejected).otherwise(0).cast("long"))
    good = checked.filter("__reason IS NULL").join(verdict.filter("outcome = 'accepted'").select(key), key, "left_semi")
    return good.select(key, "pos", "source_id", *[clean[f].alias(f) for f in kinds]), verdict.select(key, "outcome", "rows", "accepted", *REASONS)
