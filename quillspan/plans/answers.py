"""Answers from evidence, many questions at once: a model is called in batches on the executors, its replies are checked.

A model is a function (task, key, question, evidence texts, number) to a reply; tasks are ``spans`` (a list of candidates),
``select`` (one of them; the texts are the candidates), ``sample`` (the n-th try) and ``answer`` (first try 0, retry 1).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold, vote_answer
from .methods import evidence_boolean

Model = Callable[[str, object, str, list[str], int], object]


def generate_answers(questions: DataFrame, model: Model, select: bool = False, samples: int = 0, verify: bool = False, key: str = "query_id") -> DataFrame:
    """(key, answer, path, calls) of (key, question, texts): how each answer came about, and how many calls it took.

    With ``select`` the model lists spans and picks one; with ``samples`` its answers are put to a vote (ties: the first). Where these
    give nothing, it answers freely, once more if it said nothing, so no answer is lost by asking in stages. ``verify`` drops spans that no text holds. Paths:
    selected, voted, first, retry, none. Questions without texts are asked nothing.
    """
    kind = questions.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, question, texts in zip(b[key], b["question"], b["texts"]):
                texts = [] if texts is None else [t for t in texts if t is not None]
                picked, tries, replies, calls = None, [], [None, None], 0
                if texts and select:
                    spans = [s.strip() for s in model("spans", k, question, texts, 0) or [] if isinstance(s, str) and s.strip()]
                    spans = [s for s in spans if not verify or any(s in t for t in texts)]
                    calls += 1
                    if spans:
                        picked = str(model("select", k, question, spans, 0) or "").strip() or None
                        calls += 1
                if texts and picked is None and samples:
                    tries = [str(model("sample", k, question, texts, n) or "").strip() for n in range(samples)]
                    calls += samples
                rows.append((k, picked, tries, calls, texts, question))
            yield pd.DataFrame({key: [r[0] for r in rows], "picked": [r[1] for r in rows], "tries": [r[2] for r in rows], "calls": [r[3] for r in rows], "texts": [r[4] for r in rows], "question": [r[5] for r in rows]})

    staged = questions.select(key, "question", "texts").mapInPandas(run, f"{key} {kind}, picked string, tries array<string>, calls int, texts array<string>, question string")
    voted = staged.withColumn("voted", first_of_most(F.col("tries")))

    def free(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers, paths, calls = [], [], []
            for k, question, texts, picked, vote, used in zip(b[key], b["question"], b["texts"], b["picked"], b["voted"], b["calls"]):
                answer, path = (picked, "selected") if isinstance(picked, str) else (vote, "voted") if isinstance(vote, str) else ("", "none")
                for attempt in range(2 if not answer and len(texts) else 0):
                    answer = str(model("answer", k, question, list(texts), attempt) or "").strip()
                    used += 1
                    if answer:
                        path = ("first", "retry")[attempt]
                        break
                answers.append(answer or None)
                paths.append(path)
                calls.append(used)
            yield pd.DataFrame({key: b[key], "answer": answers, "path": paths, "calls": calls})

    return voted.mapInPandas(free, f"{key} {kind}, answer string, path string, calls int")


def first_of_most(tries: Column) -> Column:
    """The first try whose normal form occurs most often, ties by first appearance; blank ones don't vote."""
    cast = F.filter(F.transform(tries, lambda t, i: F.struct(vote_answer(t).alias("v"), i.alias("i"), F.trim(t).alias("t"))), lambda x: x["v"] != "")
    counted = F.transform(cast, lambda x: F.struct((-F.size(F.filter(cast, lambda y: y["v"] == x["v"]))).alias("n"), x["i"].alias("i"), x["t"].alias("t")))
    return F.array_min(counted)["t"]


def finalise(results: DataFrame, answers: DataFrame, boolean_datasets: tuple[str, ...] = ("strategyqa", "hover"), key: str = "query_id") -> DataFrame:
    """(key, answer, status, generation_calls, reconciled, evidence_only) of results (key, dataset, status, evidence, values, answer).

    A result that is neither ok nor empty, or has no evidence, stays as it is. In boolean datasets an answer that contradicts the extracted
    ``values`` gives way to them. An empty result with evidence becomes ok, by evidence alone.
    """
    made = answers.select(key, F.col("answer").alias("__a"), F.col("calls").alias("__c"))
    open_ = F.col("status").isin("ok", "empty") & (F.size(F.coalesce("evidence", F.array())) > 0)
    said = evidence_boolean(F.col("values"))
    fix = F.col("dataset").isin(*boolean_datasets) & said.isNotNull() & ~said.eqNullSafe(F.col("__a"))
    both = results.join(made, key, "left")
    return both.select(
        key, F.when(open_, F.when(fix, said).otherwise(F.col("__a"))).otherwise(F.col("answer")).alias("answer"), F.when(open_, "ok").otherwise(F.col("status")).alias("status"),
        F.when(open_, F.coalesce("__c", F.lit(0))).otherwise(0).alias("generation_calls"), (open_ & fix).alias("reconciled"), (open_ & (F.col("status") == "empty")).alias("evidence_only"),
    )


def worth_rewriting(slot_query: Column) -> Column:
    """Whether a slot query is more than a short name: eight characters or a digit, variables' marks left out."""
    plain = F.trim(F.replace(slot_query, F.lit("?"), F.lit("")))
    return (F.length(plain) >= 8) | plain.rlike(r"\p{Nd}")


def guarded_rewrite(slot_query: Column, reply: Column) -> Column:
    """A model's rewriting of a slot query, or the query itself where the reply is empty, the same, or nothing but thoughts.

    Of a reply that thinks aloud, the last line that is a query is taken.
    """
    strip = lambda c: F.regexp_replace(F.trim(c), r"""^["']+|["']+$""", "")
    plain = F.trim(F.replace(slot_query, F.lit("?"), F.lit("")))
    said = strip(F.coalesce(reply, F.lit("")))
    thinks = F.startswith(said, F.lit("Here's")) | F.contains(F.lower(F.substring(said, 1, 30)), F.lit("thinking"))
    lines = F.transform(F.split(said, r"\n"), strip)
    own = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("Here")) & ~F.contains(F.lower(F.substring(x, 1, 20)), F.lit("thinking")))
    taken = F.when(thinks, F.coalesce(F.try_element_at(own, F.lit(-1)), said)).otherwise(said)
    return F.when(~worth_rewriting(slot_query) | (said == "") | (fold(said) == fold(plain)) | (taken == ""), slot_query).otherwise(taken)
