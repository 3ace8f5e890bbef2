"""Sufficiency features, calibration, action choice, binding beams, evidence states and answer votes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import polar_answer, vote_answer
from ..sources.scratch import partitions_for
from .resample import poisson_bootstrap

# ---- binding beam ---------------------------------------------------------------------------


def beam_candidates(rows: DataFrame, relevant: list[str], query: str = "query_id") -> DataFrame:
    """The best row of each binding context with its score, ranked within each query.

    Rows have (query_id, _source_id, _confidence) and one column for each variable. They are counted first: windows are dealt to as many tasks as the rows need.
    """
    n = partitions_for(rows)
    named = [c for c in rows.columns if not c.startswith("_") and c not in (query, "pos")]
    filled = sum((F.coalesce(F.trim(F.col(c)) != "", F.lit(False)).cast("int") for c in named), F.lit(0))
    reach = sum((F.coalesce(F.trim(F.col(c)) != "", F.lit(False)).cast("int") for c in relevant), F.lit(0)) / float(len(relevant)) if relevant else F.lit(1.0)
    same = F.count("*").over(Window.partitionBy(query, "_source_id"))
    scored = rows.repartition(n, query, "_source_id").withColumn("__same", same).withColumn(
        "beam_score",
        0.55 * F.col("_confidence") + 0.15 * reach + 0.10 / F.col("__same") + 0.10 * reach - 0.05 * (F.col("__same") - 1) / F.col("__same") - 0.05 / F.greatest(filled, F.lit(1)),
    )
    order = [F.round("beam_score", 12).desc(), F.col("_confidence").desc(), F.col("_source_id").desc(), *[F.col(c) for c in relevant]]
    context = {f"__x{i}": F.coalesce(F.col(c), F.lit("")) for i, c in enumerate(relevant)}
    dealt = scored.withColumns(context).repartition(n, query, *context)
    best = dealt.withColumn("__n", F.row_number().over(Window.partitionBy(query, *context).orderBy(*order))).filter("__n = 1")
    return best.repartition(n, query).withColumn("beam_rank", F.row_number().over(Window.partitionBy(query).orderBy(*order))).drop("__n", "__same", *context)


def beam_select(candidates: DataFrame, least: int = 1, most: int = 4, budget: int | None = None, query: str = "query_id") -> DataFrame:
    """Keep the beam: as wide as the gap between the two best confidences leaves doubt."""
    w = Window.partitionBy(query)
    top = F.max(F.when(F.col("beam_rank") == 1, F.col("_confidence"))).over(w)
    second = F.coalesce(F.max(F.when(F.col("beam_rank") == 2, F.col("_confidence"))).over(w), top)
    doubt = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.greatest(top - second, F.lit(0.0))))
    cap = F.least(F.lit(most if budget is None else min(most, max(budget, 1))), F.max("beam_rank").over(w))
    width = F.when(doubt >= 0.75, cap).when(doubt >= 0.45, F.least(cap, F.lit(max(least, 2)))).otherwise(F.least(cap, F.lit(least)))
    return candidates.withColumns({"uncertainty": doubt, "width": width}).filter(F.col("beam_rank") <= F.col("width"))


# ---- logistic calibration -------------------------------------------------------------------


@dataclass
class Calibrator:
    """Logistic model on standardised features, as a column expression or JSON."""

    names: list[str]
    means: list[float]
    scales: list[float]
    weights: list[float]
    intercept: float
    threshold: float = 0.5
    partial: float = 0.25

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for n, m, s, w in zip(self.names, self.means, self.scales, self.weights):
            z = z + w * (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - m) / s
        return 1 / (1 + F.exp(-z))

    def status(self, p: Column) -> Column:
        return F.when(p >= self.threshold, "SUFFICIENT").when(p >= self.partial, "PARTIAL").otherwise("INSUFFICIENT")

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @classmethod
    def from_json(cls, s: str) -> "Calibrator":
        return cls(**json.loads(s))


def frozen_report(held: DataFrame, used: DataFrame, question: str, draws: int = 2000) -> DataFrame:
    """(dataset, examples, selected_brier, comparator_brier, brier_delta, ci_low, ci_high) of frozen predictions.

    ``held`` has (dataset, question, label, selected, comparator), ``used`` the questions that took part in fitting or selection:
    any that is held out as well is an error. The interval is a percentile one over draws of whole questions.
    """
    shared = held.join(used.select(question).distinct(), question, "left_semi").select(question).limit(5).collect()
    if shared:
        raise ValueError(f"validation questions overlap selection data: {', '.join(str(r[0]) for r in shared)}")
    loss = lambda c: F.pow(F.col(c) - F.col("label"), F.lit(2))
    means = held.groupBy("dataset").agg(F.count("*").alias("examples"), F.avg(loss("selected")).alias("selected_brier"), F.avg(loss("comparator")).alias("comparator_brier"))
    pairs = held.select("dataset", F.col(question).alias("__q"), loss("comparator").alias("reference"), loss("selected").alias("treatment"))
    drawn = poisson_bootstrap(pairs, ["dataset"], F.col("__q"), draws)
    return means.join(drawn, "dataset").select("dataset", "examples", "selected_brier", "comparator_brier", F.col("mean_difference").alias("brier_delta"), "ci_low", "ci_high")


def calibration_report(scored: DataFrame, p: str = "p", label: str = "label", threshold: float = 0.5, bins: int = 10) -> tuple[DataFrame, DataFrame]:
    """(summary row, reliability bins); the last bin is closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    reliability = scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(label).cast("double")).alias("rate"))
    hit, pos = F.col(p) >= threshold, F.col(label) == 1
    total = scored.agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(label), F.lit(2))).alias("brier"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.avg((hit == pos).cast("double")).alias("accuracy"))
    ece = reliability.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"))
    out = total.crossJoin(F.broadcast(ece))  # one row each
    return out.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))}), reliability


# ---- actions --------------------------------------------------------------------------------


@dataclass(frozen=True)
class ActionCosts:
    call: float = 0.08
    token: float = 5e-5
    millisecond: float = 5e-4


def action_candidates(p: Column, state: dict[str, Column], costs: ActionCosts = ActionCosts()) -> Column:
    """Array of struct(utility, gain, action, calls, tokens, ms) of the actions that are open.

    ``state`` names columns: has_rows, answerable, calls_left, can_expand, can_question, can_slot, can_rewrite,
    can_switch, can_beam, can_backtrack (booleans but calls_left), and the features score_entropy,
    predicate_coverage, bound_coverage, agreement, entity_coverage, join_coverage, sufficient.
    """
    s = state
    doubt = F.greatest(1.0 - p, F.lit(0.0))
    paid = s["calls_left"] > 0

    def some(open_: Column, action: str, gain: Column, calls: int, tokens: int, ms: int) -> Column:
        gain = F.least(gain, F.lit(1.0))
        utility = gain - costs.call * calls - costs.token * tokens - costs.millisecond * ms
        return F.when(open_, F.struct(F.round(utility, 12).alias("utility"), gain.alias("gain"), F.lit(action).alias("action"), F.lit(calls).alias("calls"), F.lit(tokens).alias("tokens"), F.lit(ms).alias("ms")))

    return F.array_compact(
        F.array(
            some(s["answerable"] & s["has_rows"], "ANSWER", p, 0, 32, 15),
            some(s["has_rows"], "STOP_SLOT", p * F.when(s["sufficient"], 0.95).otherwise(0.80), 0, 0, 0),
            some(s["can_expand"] & paid, "EXPAND_TOPK", p + doubt * (0.35 + 0.35 * s["score_entropy"]), 1, 512, 120),
            some(s["can_question"] & paid, "RETRIEVE_QUESTION_PLUS_SLOT", p + doubt * (0.25 + 0.25 * (1 - s["predicate_coverage"])), 1, 256, 110),
            some(s["can_slot"] & paid, "RETRIEVE_SLOT_ONLY", p + doubt * (0.20 + 0.20 * (1 - s["predicate_coverage"])), 1, 256, 100),
            some(s["can_rewrite"] & paid, "REWRITE_QUERY", p + doubt * (0.20 + 0.30 * (1 - s["bound_coverage"])), 1, 256, 100),
            some(s["can_switch"] & paid, "SWITCH_RETRIEVER", p + doubt * (0.15 + 0.25 * (1 - s["agreement"])), 1, 128, 90),
            some(s["can_beam"], "EXPAND_BINDING_BEAM", 0.35 * F.greatest(1 - s["entity_coverage"], F.lit(0.0)), 0, 128, 20),
            some(s["can_backtrack"], "BACKTRACK", 0.45 * F.greatest(1 - s["join_coverage"], F.lit(0.0)), 1, 128, 80),
            some(F.lit(True), "ABSTAIN", F.lit(0.0), 0, 0, 0),
        )
    )


def choose_action(candidates: Column) -> Column:
    """The candidate of most utility; ties by gain, then by name."""
    return F.array_max(candidates)


# ---- evidence state -------------------------------------------------------------------------

#: The status lattice: evidence only accumulates, so a status never falls.
STATUS = ["unresolved", "partial", "satisfied"]


def observed_rank(covered: Column, total: Column, any_evidence: Column) -> Column:
    return F.when((total > 0) & (covered >= total), 2).when(any_evidence | (covered > 0), 1).otherwise(0)


def status_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, STATUS)), rank)


def advance(states: DataFrame, observations: DataFrame) -> DataFrame:
    """Merge observations (requirement_id, covered, total, any_evidence) into states (requirement_id, status)."""
    seen = observations.groupBy("requirement_id").agg(F.max(observed_rank(F.col("covered"), F.col("total"), F.col("any_evidence"))).alias("r"))
    now = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status")).cast("int") - 1
    joined = states.join(seen, "requirement_id", "full_outer")
    rank = F.greatest(F.coalesce(now, F.lit(0)), F.coalesce("r", F.lit(0)))
    return joined.select("requirement_id", status_name(rank).alias("status"), (rank > F.coalesce(now, F.lit(0))).alias("advanced"))


# ---- answers --------------------------------------------------------------------------------


def majority_vote(answers: DataFrame, query: str = "query_id") -> DataFrame:
    """The most frequent normalised answer of each query (ties: seen first), in its first surface form."""
    each = answers.withColumn("norm", vote_answer(F.col("answer"))).filter("norm <> ''")
    votes = each.groupBy(query, "norm").agg(F.count("*").alias("votes"), F.min("pos").alias("first"), F.min_by("answer", "pos").alias("answer"))
    return votes.groupBy(query).agg(F.max_by(F.struct("answer", "votes"), F.struct(F.col("votes"), (-F.col("first")).alias("f"))).alias("b")).select(query, "b.answer", "b.votes")


def single_answer(rows: DataFrame, field: str, query: str = "query_id") -> DataFrame:
    """The one distinct non-blank value of a field that is not a serialised container; null if there are more."""
    v = F.nullif(F.trim(F.col(field)), F.lit(""))
    one = rows.select(query, F.when(~v.rlike(r"^[\[{(].*[\]})]$"), v).alias("v"), v.alias("any"))
    return one.groupBy(query).agg(F.when((F.min("any") == F.max("any")) & (F.count("any") == F.count("v")), F.min("v")).alias("answer"))


def polar_consensus(rows: DataFrame, field: str, query: str = "query_id") -> DataFrame:
    """yes or no where all rows that say either agree, else null."""
    p = polar_answer(F.col(field))
    return rows.groupBy(query).agg(F.when(F.min(p) == F.max(p), F.min(p)).alias("answer"))


# ---- metrics of runs ------------------------------------------------------------------------


def merge_metrics(rows: DataFrame, key: str, sums: list[str], maxima: list[str], lists: list[str], last: list[str]) -> DataFrame:
    """Merge metric rows: numbers add up, some take the maximum, lists join in order, some keep the last value."""
    ordered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", c))), lambda s: s[c]))
    aggs = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima] + [ordered(c).alias(c) for c in lists]
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in last]
    return rows.groupBy(key).agg(*aggs)


@dataclass
class Budget:
    """Calls are counted for each logical query, whatever jobs it takes."""

    total: int
    used: int = 0
    spent: list[str] = field(default_factory=list)

    def take(self, what: str, calls: int = 1, reserve: int = 0) -> bool:
        if self.used + calls + reserve > self.total:
            return False
        self.used += calls
        self.spent.append(what)
        return True
