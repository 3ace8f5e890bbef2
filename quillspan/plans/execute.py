"""The driver loop: one Spark job for each slot, sideways bindings, a call budget, joins and operators.

A materialiser turns a slot and a frame of binding contexts into binding rows. ``TableMaterializer`` scans
tables that stand for relations; ``TextMaterializer`` retrieves passages and extracts cells with a
provider. Any object with ``rows(slot, contexts, calls)`` will do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_words, grounded, lexical
from ..functions.values import typed
from ..operators import algebra, retrieval
from ..operators.evidence import first_of_each
from ..operators.policy import Budget
from .model import Join, Slot, SlotPlan
from .optimize import PhysicalPlan


class Materializer(Protocol):
    def rows(self, slot: Slot, contexts: DataFrame | None, calls: int) -> DataFrame: ...


@dataclass
class Relation:
    """A table as a relation: one column for each argument, and the column that names its source."""

    frame: DataFrame
    arguments: list[str]
    source: str


class TableMaterializer:
    """Relations over tables; contexts reduce the scan by a semi-join, constants by pushed filters."""

    def __init__(self, relations: dict[str, Relation]):
        self.relations = relations

    def rows(self, slot: Slot, contexts: DataFrame | None, calls: int) -> DataFrame:
        rel = self.relations[slot.predicate]
        df = rel.frame
        for arg, name in zip(slot.arguments, rel.arguments):
            if not arg.startswith("?"):
                df = df.filter(F.col(name) == F.lit(arg).try_cast(df.schema[name].dataType))
        shown = {arg[1:]: F.col(name) for arg, name in zip(slot.arguments, rel.arguments) if arg.startswith("?")}
        cols = [c.cast("string").alias(v) for v, c in shown.items()]
        out = df.select(*cols, F.lit(slot.id).alias("_slot_id"), F.col(rel.source).cast("string").alias("_source_id"), F.lit("").alias("_source_span"), F.lit(1.0).alias("_confidence"), F.lit(None).cast("double").alias("_retrieval_score"), F.col(rel.source).alias("pos"))
        if contexts is not None:
            keys = [v for v in shown if v in contexts.columns]
            out = out.join(contexts.select(*keys).distinct(), keys, "left_semi")
        return out


Extractor = Callable[[Slot, str, str], list[dict[str, str]]]


class TextMaterializer:
    """Retrieve passages for a slot's query, extract rows with a provider in Arrow batches, keep grounded typed ones.

    With a ``question`` and two calls at hand a slot is asked twice: by its own query, and by the question and the lexical
    slot query. The passages of both are extracted from once, or, ``per_path``, path by path; equal rows of one source stay once,
    the first path's. ``bound_single`` asks once where bindings narrow the query already.
    """

    def __init__(self, index: retrieval.Index, extract: Extractor, top_k: int = 10, question: str = "", per_path: bool = False, bound_single: bool = False):
        self.index, self.extract, self.top_k = index, extract, top_k
        self.question, self.per_path, self.bound_single = question, per_path, bound_single

    def expanded(self, top_k: int) -> "TextMaterializer":
        """The same retrieval with a larger evidence window."""
        if top_k <= self.top_k:
            raise ValueError("an expanded window must be larger than the present one")
        return TextMaterializer(self.index, self.extract, top_k, self.question, self.per_path, self.bound_single)

    def cost(self, calls: int, bound: bool) -> int:
        """Retrieval calls of one slot when ``calls`` are allocated to it."""
        return 2 if self.question and calls >= 2 and not (bound and self.bound_single) else 1

    def _queries(self, slot: Slot, contexts: DataFrame | None) -> DataFrame:
        if contexts is None:
            one = self.index.passages.sparkSession.createDataFrame([("{}", slot.query())], "query_id string, query string")
            return one.select("query_id", lexical(F.col("query")).alias("query"))
        known = [v for v in slot.variables if v in contexts.columns]
        parts: list[Column] = [F.lit(slot.predicate)] + [F.col(a[1:]) if a[1:] in known and a.startswith("?") else F.lit(a) for a in slot.arguments] + [F.lit(f"{k}={v}") for k, v in sorted(slot.constraints.items())]
        return contexts.select(F.to_json(F.struct(*known)).alias("query_id"), lexical(F.concat_ws(" ", *parts)).alias("query"))

    def rows(self, slot: Slot, contexts: DataFrame | None, calls: int) -> DataFrame:
        own = self._queries(slot, contexts)
        paths = [own]
        if self.cost(calls, contexts is not None) == 2:
            paths.append(own.withColumn("query", F.concat_ws(" ", F.lit(self.question), "query")))
        hits = reduce(lambda x, y: x.unionByName(y), [retrieval.bm25_top_k(self.index, q, self.top_k).select("query_id", "pos", "score", F.lit(i).alias("path")) for i, q in enumerate(paths)])
        best = hits.groupBy("pos", "path").agg(F.max("score").alias("score")) if self.per_path else hits.groupBy("pos").agg(F.max("score").alias("score"), F.min("path").alias("path"))
        found = best.join(self.index.passages.select("pos", "text"), "pos")
        names, extract = slot.variables, self.extract
        made = [*names, "pos", "_source_span", "_retrieval_score", "_path", "_nth"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for p, text, score, path in zip(b["pos"], b["text"], b["score"], b["path"]):
                    out += [{**{v: row.get(v) for v in names}, "pos": p, "_source_span": text, "_retrieval_score": score, "_path": path, "_nth": n} for n, row in enumerate(extract(slot, str(p), text))]
                yield pd.DataFrame(out, columns=made)

        schema = ", ".join([*(f"`{v}` string" for v in names), "pos long, _source_span string, _retrieval_score double, _path int, _nth int"])
        rows = found.mapInPandas(run, schema)
        text = ascii_words(F.col("_source_span"))
        for v in names:
            kind = slot.types.get(v, "string")
            rows = rows.withColumn(v, typed(F.col(v), kind, keep_surface=True))
            if kind != "boolean":
                rows = rows.filter(F.col(v).isNotNull() & grounded(ascii_words(F.col(v)), text))
        if contexts is not None:  # a row belongs to a binding that asked for its passage and repeats the bound values
            known = [v for v in names if v in contexts.columns]
            bound = contexts.select(F.to_json(F.struct(*known)).alias("query_id"), *[ascii_words(F.col(v)).alias(f"__k_{v}") for v in known]).distinct()
            asked = hits.select("query_id", "pos").distinct().join(bound, "query_id")
            same = [ascii_words(F.col(v)).eqNullSafe(F.col(f"__k_{v}")) for v in known]
            rows = rows.join(asked, "pos").filter(reduce(lambda x, y: x & y, same, F.lit(True))).select(rows.columns).distinct()
        if self.per_path:
            rows = first_of_each(rows, [F.col("pos"), *map(F.col, names)], "_path", "_nth")
        return rows.drop("_path", "_nth").withColumns({"_slot_id": F.lit(slot.id), "_source_id": F.col("pos").cast("string"), "_confidence": F.lit(1.0)})


#: (slot, variable, evidence texts) to values that the variable may have
Bridge = Callable[[Slot, str, list[str]], list[str]]


def bridge_contexts(rows: DataFrame, contexts: DataFrame | None, variable: str, values: list[str], most: int = 3) -> DataFrame | None:
    """Contexts in which a variable takes each of the first ``most`` distinct proposed values; none without a value."""
    kept = list(dict.fromkeys(v.strip() for v in values if v and v.strip()))[:most]
    if not kept:
        return None
    if contexts is None or set(contexts.columns) <= {variable, "pos"}:
        return rows.sparkSession.createDataFrame([(v,) for v in kept], f"`{variable}` string")
    return contexts.drop(variable).distinct().withColumn(variable, F.explode(F.array(*map(F.lit, kept))))


@dataclass
class Result:
    status: str
    rows: DataFrame | None
    order: list[str] = field(default_factory=list)
    observed: dict[str, int] = field(default_factory=dict)
    evidence: DataFrame | None = None
    calls: int = 0
    bridges: int = 0
    frames: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give up the cached rows of the slots; results that were not read yet are then computed anew."""
        for f in self.frames:
            f.unpersist()


def choose_slot(left: list[Slot], bound: set[str], seen: dict[str, int], strategy: str, near: Callable[[str], set[str]], done: set[str], fixed: list[str], seed: int = 2027) -> Slot:
    """The next slot: next to what is done where possible; oracle: fewest rows; adaptive: most bound and important for the least cost."""
    pool = [s for s in left if not done or near(s.id) & done] or left
    if strategy == "question":
        return pool[0]
    if strategy == "fixed":
        return next((s for x in fixed for s in pool if s.id == x), pool[0])
    if strategy == "random":  # a seeded hash, so a retried run takes the same order
        return min(pool, key=lambda s: hashlib.sha256(f"{seed}:{s.id}".encode()).digest())
    if strategy == "oracle":
        return min(pool, key=lambda s: (seen.get(s.id, s.cardinality), left.index(s)))
    return max(pool, key=lambda s: ((sum(v in bound for v in s.variables) + s.importance) / (s.cost * max(seen.get(s.id, s.cardinality), 1e-9)), -left.index(s)))


def execute(plan: SlotPlan, source: Materializer, physical: PhysicalPlan | None = None, budget: int = 8, strategy: str = "adaptive", contexts_limit: int = 32, late: bool = False, bridge: Bridge | None = None, bridge_passages: int = 8, bridge_chars: int = 1200) -> Result:
    """Materialise the slots one by one, join each to what is there, and run the operators.

    A call is kept back for every slot still to come. Bindings of shared variables reach the next slot
    as contexts unless ``late``. A slot takes the calls that were allocated to it where its materialiser can use them and
    the budget has them. An empty slot or join ends the run at once, unless ``bridge`` proposes values for the slot's first open
    variable, or for the variable that the join broke on: then the slot is asked once more with them.
    """
    spent, left, done = Budget(budget), list(plan.slots), set()
    near = plan.neighbours()
    out = Result("ok", None)
    current: DataFrame | None = None
    frames: list[DataFrame] = []
    while left:
        bound = set(algebra.variables(current)) if current is not None else set()
        if physical and strategy == "fixed":
            slot = choose_slot(left, bound, out.observed, "fixed", near.__getitem__, done, physical.order)
        else:
            slot = choose_slot(left, bound, out.observed, strategy, near.__getitem__, done, [])
        shared = [v for v in slot.variables if v in bound]
        contexts = algebra.binding_contexts(current, shared, contexts_limit) if current is not None and shared and not late else None
        calls = physical.calls.get(slot.id, 1) if physical else 1
        wanted = source.cost(calls, contexts is not None) if hasattr(source, "cost") else 1
        if wanted > 1 and spent.take(slot.id, wanted, reserve=len(left) - 1):
            pass
        elif spent.take(slot.id, 1, reserve=len(left) - 1):
            calls = 1
        else:
            return Result("budget_exceeded", None, out.order, out.observed, out.evidence, spent.used, out.bridges, out.frames)

        def ask(contexts: DataFrame | None, calls: int, slot: Slot = slot) -> DataFrame:
            rows = source.rows(slot, contexts, calls).persist()
            out.frames.append(rows)
            out.observed[slot.id] = rows.count()
            return rows

        def texts() -> list[str]:
            if out.evidence is None:
                return []
            first = out.evidence.groupBy("_source_id").agg(F.min("_source_span").alias("t")).orderBy("_source_id").limit(bridge_passages)
            return [r[0] for r in first.select(F.substring("t", 1, bridge_chars)).collect()]

        rows = ask(contexts, calls)
        unbound = [v for v in sorted(slot.variables) if v not in shared]
        if not out.observed[slot.id] and bridge and unbound and spent.take(slot.id, 1, reserve=len(left) - 1):
            out.bridges += 1
            proposed = bridge_contexts(rows, contexts, unbound[0], bridge(slot, unbound[0], texts()))
            rows = rows if proposed is None else ask(proposed, 1)
        out.order.append(slot.id)
        left.remove(slot)
        done.add(slot.id)
        before = current
        if bridge and shared and not late and before is not None and out.observed[slot.id]:
            joined = _attach(plan, before, rows, slot, done)
            if joined is not None and not joined.limit(1).count() and spent.take(slot.id, 1, reserve=len(left)):
                out.bridges += 1
                proposed = bridge_contexts(rows, contexts, shared[0], bridge(slot, shared[0], texts()))
                rows = rows if proposed is None else ask(proposed, 1)
        shown = sorted(algebra.variables(rows))
        seen = rows.select("_slot_id", "_source_id", "_source_span", F.to_json(F.struct(*shown)).alias("_bindings") if shown else F.lit("{}").alias("_bindings")).distinct()
        out.evidence = seen if out.evidence is None else out.evidence.unionByName(seen)
        frames.append(rows)
        out.calls = spent.used
        if not out.observed[slot.id]:
            out.status = "empty"
            return out
        if current is None:
            current = rows
        elif not late:
            current = _attach(plan, current, rows, slot, done)
            if current is None:
                out.status = "failed"
                return out
    if late and len(frames) > 1:
        current, inside = frames[0], {out.order[0]}
        for f, x in zip(frames[1:], out.order[1:]):
            inside.add(x)
            current = _attach(plan, current, f, plan.slot(x), inside)
            if current is None:
                out.status = "failed"
                return out
    answer = algebra.output_rows(algebra.apply_operators(current, plan.operators), plan.outputs)
    filled = reduce(lambda a, b: a | b, [F.trim(F.col(c)) != "" for c in answer.columns if c != "pos"])
    out.rows = answer
    out.status = "ok" if answer.filter(filled).limit(1).count() else "empty"
    return out


def _attach(plan: SlotPlan, current: DataFrame, rows: DataFrame, slot: Slot, done: set[str]) -> DataFrame | None:
    """Join by the first join that reaches the slot; without one, pair up the branches of an extremum operator."""
    j: Join | None = next((j for j in plan.joins if slot.id in (j.left_slot, j.right_slot) and {j.left_slot, j.right_slot} <= done), None)
    if j:
        return algebra.join_rows(current, rows, j.left_field, j.right_field) if j.right_slot == slot.id else algebra.join_rows(rows, current, j.left_field, j.right_field)
    here, there = set(slot.variables), set(algebra.variables(current))
    if any(op.reads() & here and op.reads() & there for op in plan.operators if op.kind.startswith("field_") or op.operation == "date_diff_months"):
        return algebra.bridge_rows(current, rows)
    return None
