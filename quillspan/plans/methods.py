"""Question-answering methods without slot plans: one question, static queries, iterative and agent loops.

All questions go through a method together: each round is one retrieval job for every question that is still
open, so the number of jobs is the call budget, whatever the number of questions. Providers (query lists, next
steps, answers) are called in Arrow batches on the executors; a question's evidence is at most rounds times top k passages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: (query_id, query) to (query_id, source_id, score, text)
Search = Callable[[DataFrame], DataFrame]
#: (question, texts so far, round) to (next query, stop)
Step = Callable[[str, list[str], int], tuple[str, bool]]
Answer = Callable[[str, list[str]], str]


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop: a table in the shared scratch folder."""
    return written(df, "method-round")


def evidence_texts(questions: DataFrame, items: DataFrame) -> DataFrame:
    """Questions with the texts of their items in order of (round, score, id)."""
    order = F.struct("round", (-F.col("score")).alias("s"), "source_id", "text")
    texts = items.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda r: r["text"]).alias("texts"))
    return questions.join(texts, "query_id", "left").withColumn("texts", F.coalesce("texts", F.array().cast("array<string>")))


def whole_question(questions: DataFrame, search: Search) -> tuple[DataFrame, DataFrame]:
    """(items, calls): the question itself is the one query."""
    items = search(questions.select("query_id", F.col("question").alias("query")))
    return items.withColumn("round", F.lit(0)), questions.select("query_id", F.lit(1).alias("calls"), F.lit(False).alias("stopped"))


def static_queries(questions: DataFrame, search: Search, plan: Callable[[str], list[str]]) -> tuple[DataFrame, DataFrame]:
    """All queries of a list are asked at once; blank ones are counted but not asked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "queries": [list(plan(q)) for q in b["question"]]})

    planned = _cut(questions.select("query_id", "question").mapInPandas(run, f"query_id {_id_type(questions)}, queries array<string>"))
    each = planned.select("query_id", F.posexplode("queries").alias("round", "query")).filter(F.trim("query") != "")
    # one search for each (question, round): a key of both keeps the lists apart
    keyed = each.select(F.concat_ws("\x1f", F.col("query_id").cast("string"), F.col("round").cast("string")).alias("key"), "query_id", "round", "query")
    found = search(keyed.select(F.col("key").alias("query_id"), "query")).withColumnRenamed("query_id", "key")
    return found.join(keyed.select("key", "query_id", "round"), "key").drop("key"), planned.select("query_id", F.size("queries").alias("calls"), F.lit(False).alias("stopped"))


def _id_type(questions: DataFrame) -> str:
    return questions.schema["query_id"].dataType.simpleString()


def loop(questions: DataFrame, search: Search, step: Step, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(items, calls, stopped) of at most ``most`` rounds.

    A stop counts only with evidence. A blank query is the question itself in the first round, and the end after it.
    """
    if most < 1:
        raise ValueError("a loop needs a round")
    schema = f"query_id {_id_type(questions)}, question string, query string, stop boolean"
    open_, items, ledger = questions.select("query_id", "question"), None, []
    for n in range(most):
        known = evidence_texts(open_, items) if items is not None else open_.withColumn("texts", F.array().cast("array<string>"))

        def run(batches: Iterator[pd.DataFrame], n: int = n) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for i, q, texts in zip(b["query_id"], b["question"], b["texts"]):
                    query, stop = step(q, list(texts), n)
                    out.append((i, q, query.strip() or (q if n == 0 else ""), bool(stop and len(texts))))
                yield pd.DataFrame(out, columns=["query_id", "question", "query", "stop"])

        decided = _cut(known.select("query_id", "question", "texts").mapInPandas(run, schema))
        asked = decided.filter(~F.col("stop") & (F.col("query") != ""))
        ledger.append(decided.select("query_id", F.col("stop").alias("stopped"), (~F.col("stop") & (F.col("query") != "")).cast("int").alias("calls")))
        found = search(asked.select("query_id", "query")).withColumn("round", F.lit(n))
        items = _cut(found if items is None else items.unionByName(found))
        open_ = asked.select("query_id", "question")
    each = ledger[0]
    for x in ledger[1:]:
        each = each.unionByName(x)
    return items, each.groupBy("query_id").agg(F.sum("calls").cast("int").alias("calls"), F.max("stopped").alias("stopped"))


def finalize(questions: DataFrame, items: DataFrame, answer: Answer) -> DataFrame:
    """(query_id, answer, status, documents, passages): no answer is asked for without evidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "answer": [answer(q, list(t)) if len(t) else None for q, t in zip(b["question"], b["texts"])], "passages": [len(t) for t in b["texts"]]})

    said = evidence_texts(questions.select("query_id", "question"), items).mapInPandas(run, f"query_id {_id_type(questions)}, answer string, passages long")
    seen = items.groupBy("query_id").agg(F.count_distinct("source_id").alias("documents"))
    return said.join(seen, "query_id", "left").select("query_id", "answer", F.when(F.col("passages") > 0, "ok").otherwise("empty").alias("status"), F.coalesce("documents", F.lit(0)).alias("documents"), "passages")


def evidence_boolean(values: Column) -> Column:
    """True or False by the first of an array of values that begins with yes, no, true or false; else null."""
    token = F.transform(values, lambda v: F.lower(F.regexp_extract(v, r"(?i)^\s*(yes|no|true|false)\b", 1)))
    first = F.get(F.filter(token, lambda t: t != ""), F.lit(0))
    return F.when(first.isin("yes", "true"), "True").when(first.isin("no", "false"), "False")


def reconciled(answer: Column, values: Column) -> Column:
    """A polar answer, corrected by what was extracted."""
    return F.coalesce(evidence_boolean(values), answer)


@dataclass(frozen=True)
class Method:
    """A named way to gather evidence: its family, and how many retrieval calls it may make."""

    name: str
    family: str
    calls: int


#: Method names and the provider that each needs beside a search.
METHODS = {m.name: m for m in (Method("whole_question", "baseline", 1), Method("hybrid", "baseline", 1), Method("static_plan", "planned", 8), Method("iterative", "loop", 4), Method("agent", "loop", 4))}


def gather(name: str, questions: DataFrame, search: Search, plan: Callable[[str], list[str]] | None = None, step: Step | None = None, calls: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Run a method of ``METHODS`` by name."""
    m = METHODS[name]
    if m.family == "baseline":
        return whole_question(questions, search)
    if m.family == "planned":
        if plan is None:
            raise ValueError(f"{name} needs a provider of query lists")
        return static_queries(questions, search, plan)
    if step is None:
        raise ValueError(f"{name} needs a provider of steps")
    return loop(questions, search, step, calls or m.calls)
