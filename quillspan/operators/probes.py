"""Query-variant probes, comparisons with a fixed baseline, and classifiers of questions with their agreement audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resample import poisson_bootstrap
from .retrieval import rank_fusion
from .stats import holm

# ---- variants -------------------------------------------------------------------------------


def probe_strategies(baseline: DataFrame, variants: DataFrame, has_rows: DataFrame, top_k: int, candidate_k: int) -> DataFrame:
    """(query_id, strategy, pos, extra_calls): what each way to ask would have brought to a materialisation.

    ``baseline`` (query_id, pos, rank) are the slot query's candidates, ``variants`` (query_id, variant, pos, rank) those of other forms,
    ``has_rows`` (query_id, has_rows) says whether the slot gave rows. A variant alone takes no further call; fused with the slot's it takes one; the
    adaptive form fuses only where the slot gave no rows.
    """
    own = baseline.filter(F.col("rank") <= top_k).select("query_id", F.lit("slot").alias("strategy"), "pos", F.lit(0).alias("extra_calls"))
    alone = variants.filter(F.col("rank") <= top_k).select("query_id", F.col("variant").alias("strategy"), "pos", F.lit(0).alias("extra_calls"))
    near = variants.filter(F.col("rank") <= candidate_k)
    base = baseline.filter(F.col("rank") <= candidate_k).join(variants.select("query_id", "variant").distinct(), "query_id")
    both = base.select(F.struct("query_id", "variant").alias("query_id"), F.lit(0).alias("list_id"), "pos", "rank").unionByName(near.select(F.struct("query_id", "variant").alias("query_id"), F.lit(1).alias("list_id"), "pos", "rank"))
    fused = rank_fusion(both, top_k).select("query_id.query_id", "query_id.variant", "pos").join(has_rows, "query_id")
    name = F.concat(F.lit("slot_plus_"), "variant")
    joined = fused.select("query_id", name.alias("strategy"), "pos", F.lit(1).alias("extra_calls"))
    adaptive = F.concat(F.lit("adaptive_empty_"), name)
    asked = fused.filter(~F.col("has_rows")).select("query_id", adaptive.alias("strategy"), "pos", F.lit(1).alias("extra_calls"))
    names = variants.select("query_id", "variant").distinct().join(has_rows.filter("has_rows"), "query_id")
    kept = own.select("query_id", "pos").join(names, "query_id").select("query_id", adaptive.alias("strategy"), "pos", F.lit(0).alias("extra_calls"))
    return reduce(lambda x, y: x.unionByName(y), [own, alone, joined, asked, kept])


def probe_recall(strategies: DataFrame, questions: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, strategy, gold_count, hit_count, recall, full_support, any_support, extra_calls).

    ``questions`` maps query_id to question_id; the sets of a question's materialisations are united, their extra calls added up. Questions
    without gold ids do not count.
    """
    named = strategies.join(questions, "query_id")
    calls = named.select("question_id", "strategy", "query_id", "extra_calls").distinct().groupBy("question_id", "strategy").agg(F.sum("extra_calls").alias("extra_calls"))
    found = named.select("question_id", "strategy", "pos").distinct().withColumn("hit", F.lit(1))
    wanted = gold.select("question_id", "pos").distinct()
    asked = calls.join(wanted, "question_id").join(found, ["question_id", "strategy", "pos"], "left")
    out = asked.groupBy("question_id", "strategy", "extra_calls").agg(F.count("*").alias("gold_count"), F.count("hit").alias("hit_count"))
    return out.withColumns({"recall": F.col("hit_count") / F.col("gold_count"), "full_support": F.col("hit_count") == F.col("gold_count"), "any_support": F.col("hit_count") > 0})


# ---- fixed baseline -------------------------------------------------------------------------


def compare_with_baseline(runs: DataFrame, baseline: str, candidates: list[str], draws: int = 2000) -> DataFrame:
    """(dataset, method, n, mean_difference, wins, ties, losses, ci_low, ci_high, p_value, p_holm) of runs (dataset, question_id, method, score).

    Candidates are paired with the fixed baseline by question, missing scores of a pair are 0, questions that the baseline lacks don't count;
    Holm's correction goes over all rows.
    """
    base = runs.filter(F.col("method") == baseline).select("dataset", "question_id", F.coalesce("score", F.lit(0.0)).alias("reference"))
    pairs = runs.filter(F.col("method").isin(*candidates)).select("dataset", "question_id", "method", F.coalesce("score", F.lit(0.0)).alias("treatment")).join(base, ["dataset", "question_id"])
    d = F.col("treatment") - F.col("reference")
    counts = pairs.groupBy("dataset", "method").agg(F.count_if(d > 1e-8).alias("wins"), F.count_if(F.abs(d) <= 1e-8).alias("ties"), F.count_if(d < -1e-8).alias("losses"))
    drawn = poisson_bootstrap(pairs, ["dataset", "method"], F.col("question_id"), draws)
    return holm(drawn.join(counts, ["dataset", "method"])).select("dataset", "method", "n", "mean_difference", "wins", "ties", "losses", "ci_low", "ci_high", "p_value", "p_holm")


def compare_metrics(runs: DataFrame, baseline: str, candidates: list[str], metrics: list[str]) -> DataFrame:
    """(dataset, method, metric, n, candidate_mean, reference_mean, delta): one pass over the pairs for all metrics; a metric's pair needs both values."""
    cells = lambda side: F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(side)) for m in metrics])
    long = lambda rows, side: rows.select("dataset", "question_id", "method", F.explode(cells(side)).alias("x")).select("dataset", "question_id", "method", "x.metric", f"x.{side}").filter(F.col(side).isNotNull())
    base = long(runs.filter(F.col("method") == baseline), "reference").drop("method")
    pairs = long(runs.filter(F.col("method").isin(*candidates)), "candidate").join(base, ["dataset", "question_id", "metric"])
    out = pairs.groupBy("dataset", "method", "metric").agg(F.count("*").alias("n"), F.avg("candidate").alias("candidate_mean"), F.avg("reference").alias("reference_mean"))
    return out.withColumn("delta", F.col("candidate_mean") - F.col("reference_mean"))


def trigger_audit(pairs: DataFrame, trigger: str, group: str = "dataset") -> DataFrame:
    """(group, triggered, total, exact_gains, exact_losses, exact_ties) of pairs (group, trigger count, candidate_em, baseline_em) whose trigger fired."""
    c, b = F.coalesce("candidate_em", F.lit(0.0)), F.coalesce("baseline_em", F.lit(0.0))
    fired = pairs.filter(F.coalesce(trigger, F.lit(0)) > 0)
    return fired.groupBy(group).agg(F.count("*").alias("triggered"), F.sum(trigger).alias("total"), F.count_if((c == 1) & (b < 1)).alias("exact_gains"), F.count_if((c < 1) & (b == 1)).alias("exact_losses"), F.count_if(c == b).alias("exact_ties"))


# ---- questions ------------------------------------------------------------------------------

#: The patterns that name what a question asks for.
NUMERIC = r"(?i)\b(how many|how much|sum|total|difference|product|average|minus|plus|times|multiply|divide|percentage|percent|number of|increased by|decreased by|population|how large|how long|how far|how tall|how old|how big|how wide|area|distance|amount|age range|uppermost|length|width|height|weight|size of|rate of|quantity|how many people|what was the total|what is the area)\b"
SUPERLATIVE = r"(?i)\b(earlier|later|older|younger|before|after|first|last|shortest|longest|highest|lowest|fastest|slowest|largest|smallest|oldest|newest|closest|farthest|most|least|fewest|youngest)\b"
EXTREMUM = r"(?is)\b(?:which|who|what|which one)\b.*?\b(?:older|younger|earlier|later|born|died|released|established|first|last|taller|shorter)\b"
EITHER_OR = r"(?is)\b(?:does|do|did|is|are|was|were)\b.*?\b(?:higher|lower|larger|smaller|bigger|older|younger|more|less|greater|faster|slower|earlier|later)\b.*?\b(?:or)\b"
BOOLEAN_LEAD = r"(?i)^\s*(?:was|were|is|are|does|did|do|has|have|had|would|could|will|can|shall|is it|are there|were there)\b"
YEAR = r"(?i)\b(what year|in what year|what date|on what date)\b"
DATE = r"(?i)\b(when|what month|what decade|what era|what day|when exactly)\b"
MONTH = r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\b"
MULTI = r"(?i)\b(what are|list|name (both|all)|enumerate|each other|and also)\b"


def answer_spec(question: Column) -> Column:
    """struct(cardinality, value_type, category) that a question asks for, by its structure alone."""
    q = F.lower(question)
    made = lambda a, b, c: F.struct(F.lit(a).alias("cardinality"), F.lit(b).alias("value_type"), F.lit(c).alias("category"))
    many = F.contains(q, F.lit(" and ")) | F.contains(q, F.lit(",")) | F.contains(q, F.lit("list"))
    entity = made("ONE", "SCALAR_ENTITY", "ENTITY")
    return (
        F.when(q.rlike(EITHER_OR), entity).when(q.rlike(NUMERIC) & many, made("MANY_MULTISET", "NUMERIC_LIST", "NUMBER")).when(q.rlike(NUMERIC) | q.rlike(YEAR), made("ONE", "NUMBER", "NUMBER"))
        .when(q.rlike(DATE), made("ONE", "DATE", "DATE")).when(q.rlike(BOOLEAN_LEAD), made("ONE", "BOOLEAN", "BOOLEAN")).when(q.rlike(SUPERLATIVE) | q.rlike(EXTREMUM), entity)
        .when(q.rlike(MULTI), made("MANY_SET", "MULTI_SPAN", "MULTI")).otherwise(entity)
    )


def needs_typed_operator(question: Column) -> Column:
    """Whether a question asks for a comparison, an extremum or arithmetic."""
    return question.rlike(NUMERIC) | question.rlike(SUPERLATIVE) | question.rlike(EXTREMUM)


def gold_category(answers: Column, question: Column) -> Column:
    """What kind of value the gold answers (an array) are."""
    joined = F.array_join(answers, " ")
    numeric = F.forall(answers, lambda a: F.trim(F.replace(a, F.lit(","), F.lit(""))).rlike(r"^[+-]?\d+(\.\d+)?$"))
    dated = joined.rlike(MONTH) | joined.rlike(r"(?i)\b\d{1,2}\s+(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)")
    when = question.rlike(YEAR) | question.rlike(DATE)
    return (
        F.when(F.size(answers) == 0, "ENTITY").when(dated, "DATE").when(numeric & when, "DATE").when(numeric, "NUMBER")
        .when(joined.rlike(r"(?i)^\s*(?:yes|no|true|false|y|n)\s*$"), "BOOLEAN").when(F.size(answers) > 1, "MULTI").otherwise("ENTITY")
    )


def spec_audit(items: DataFrame, family: Column) -> DataFrame:
    """(dataset, n, schema_ok, needs_op, family_ok): agreement of inferred and gold categories, and of operator needs with the family found."""
    needs = needs_typed_operator(F.col("question"))
    return items.groupBy("dataset").agg(
        F.count("*").alias("n"), F.count_if(answer_spec(F.col("question"))["category"] == gold_category(F.col("answers"), F.col("question"))).alias("schema_ok"),
        F.count_if(needs).alias("needs_op"), F.count_if(needs & (family != "scan")).alias("family_ok"),
    )
