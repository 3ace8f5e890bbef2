"""Candidates, access paths and evidence of slot materialisations as joins and grouped sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def binding_key(bindings: Column) -> Column:
    """A comparable form of a map: maps themselves can not be grouped by."""
    return F.array_sort(F.map_entries(bindings))


def first_of_each(rows: DataFrame, keys: list[Column], *order: str) -> DataFrame:
    """The first row of each key by ``order``: the key's rows are reduced map-side before they move."""
    rest = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in order])
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    best = rows.select(*named, rest.alias("__r")).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("__r", F.struct(*[F.col(f"__r.{c}") for c in order])).alias("__r"))
    return best.select(*[F.col(f"__r.{c}").alias(c) for c in rows.columns])


def candidate_inventory(candidates: DataFrame, selected: DataFrame, passages: DataFrame, query: str = "query_id") -> DataFrame:
    """Each query's candidates once, at their first place, with their passage if there is one.

    ``candidates``: query_id, pos, source_id; ``selected``: query_id, place, source_id; ``passages``: source_id and other
    columns. Adds found, and place (the rank among the selected ones, null if not selected or not found).
    Null and blank ids are no candidates.
    """
    named = candidates.filter(F.coalesce("source_id", F.lit("")) != "")
    once = named.groupBy(query, "source_id").agg(F.min("pos").alias("pos"))
    places = selected.groupBy(query, "source_id").agg(F.min("place").alias("place"))
    text = passages.withColumn("found", F.lit(True))
    out = once.join(text, "source_id", "left").join(places, [query, "source_id"], "left")
    return out.withColumns({"found": F.coalesce("found", F.lit(False)), "place": F.when(F.col("found"), F.col("place"))})


def binding_evidence(rows: DataFrame, passages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the text of their passage as source_span, rows whose source is unknown)."""
    span = passages.select("source_id", F.col("text").alias("source_span"))
    return rows.join(span, "source_id"), rows.join(span, "source_id", "left_anti")


def merge_paths(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """Rows of several access paths (path, pos, source_id, bindings) once for each source and bindings, the first path's."""
    return first_of_each(rows, [F.col(query), F.col("source_id"), binding_key(F.col("bindings"))], "path", "pos")


def merge_counts(rows: DataFrame, query: str = "query_id") -> DataFrame:
    """(query_id, before, after) of ``merge_paths``."""
    each = rows.groupBy(query, "source_id", binding_key(F.col("bindings")).alias("b")).count()
    return each.groupBy(query).agg(F.sum("count").alias("before"), F.count("*").alias("after"))


def distinct_evidence(rows: DataFrame, retrieved: DataFrame, query: str = "query_id") -> DataFrame:
    """Evidence once for each (source, slot, bindings) in execution order; the retrieved passages where a query has none.

    ``rows``: query_id, step, pos, slot_id, source_id, source_span, bindings. ``retrieved``: the same but bindings.
    """
    own = first_of_each(rows, [F.col(query), F.col("source_id"), F.col("slot_id"), binding_key(F.col("bindings"))], "step", "pos")
    bare = retrieved.join(rows.select(query).distinct(), query, "left_anti")
    return own.unionByName(bare.withColumn("bindings", F.lit(None).cast(rows.schema["bindings"].dataType)))


def path_coverage(left: DataFrame, right: DataFrame, top_k: int, query: str = "query_id") -> DataFrame:
    """Union and overlap of the first ``top_k`` distinct ids of two access paths, left ids first."""

    def firsts(df: DataFrame) -> DataFrame:
        once = df.groupBy(query, "source_id").agg(F.min("rank").alias("rank"))
        kept = once.withColumn("__n", F.row_number().over(Window.partitionBy(query).orderBy("rank", "source_id"))).filter(F.col("__n") <= top_k)
        return kept.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", "source_id"))), lambda r: r["source_id"]).alias("ids"))

    none = F.array().cast("array<string>")
    both = firsts(left).withColumnRenamed("ids", "l").join(firsts(right).withColumnRenamed("ids", "r"), query, "full_outer").withColumns({"l": F.coalesce("l", none), "r": F.coalesce("r", none)})
    return both.select(query, F.array_union("l", "r").alias("union_ids"), F.array_sort(F.array_intersect("l", "r")).alias("overlap_ids"))


def bundle_recall(coverage: DataFrame, gold: DataFrame, baseline: DataFrame, query: str = "query_id") -> DataFrame:
    """Recall of each question's united ids against its gold ids, and its change from ``baseline`` (query_id, recall)."""
    found = coverage.select(query, F.explode("union_ids").alias("source_id")).distinct()
    hits = gold.select(query, "source_id").distinct().join(found.withColumn("hit", F.lit(1)), [query, "source_id"], "left")
    r = hits.groupBy(query).agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("bundle_recall"))
    return r.join(baseline, query).select(query, "bundle_recall", (F.col("bundle_recall") - F.col("recall")).alias("delta_recall"), (F.col("bundle_recall") == 1).alias("full_support"), (F.col("bundle_recall") > 0).alias("any_support"))


def retrieval_calls(bound: Column, question: bool, dual: bool = False, bundle: bool = False, unbound_only: bool = False, bound_single: bool = False) -> Column:
    """Calls that one context takes: 2 where both access paths are asked, else 1. ``bound``: the context has bindings."""
    two = F.lit(question and (dual or bundle)) & (~bound | F.lit(not unbound_only))
    return F.when(bound & F.lit(bundle and bound_single), 1).when(two, 2).otherwise(1)
