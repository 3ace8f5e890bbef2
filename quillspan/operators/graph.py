"""Graph ranking of candidate passages: links by rare shared terms, personalised PageRank as a sparse join.

A question may have any number of candidates. Nothing of a question meets in one task: terms group at most
``commonest`` passages, a round sends each passage's share along its links and adds up what arrives, and every
``cut_every`` rounds the scores are written to the shared scratch folder, so that a lost executor costs these rounds at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import graph_terms
from ..sources.scratch import discard, written


def shared_term_links(terms: DataFrame, rarest: int = 2, commonest: int = 20) -> DataFrame:
    """(query_id, pos, nbr), both ways: passages that share a term of ``rarest`` to ``commonest`` of the query's passages.

    ``terms`` has (query_id, pos, t array of distinct terms). Common terms are counted away before any list is made.
    """
    each = terms.select("query_id", "pos", F.explode("t").alias("term"))
    rare = each.groupBy("query_id", "term").agg(F.count("*").alias("n")).filter(F.col("n").between(rarest, commonest))
    held = each.join(rare, ["query_id", "term"], "left_semi").groupBy("query_id", "term").agg(F.collect_list("pos").alias("all"))
    pairs = held.select("query_id", F.explode("all").alias("pos"), "all").select("query_id", "pos", F.explode("all").alias("nbr"))
    return pairs.filter("pos <> nbr").distinct()


def personalised_pagerank(seeds: DataFrame, links: DataFrame, iterations: int = 30, damping: float = 0.85, cut_every: int = 10) -> DataFrame:
    """(query_id, pos, score) after ``iterations`` rounds from the seeds.

    ``seeds`` has (query_id, pos, seed), summing to one in each query, ``links`` (query_id, pos, nbr) both ways. What
    passages without links hold returns to the seed. As nothing is sent to them, their mass follows from
    their seeds' sum alone: m' = sum * (1 - damping + damping * m), so it needs no aggregation in a round.
    """
    ends = links.groupBy("query_id", "pos").agg(F.collect_list("nbr").alias("nbrs"))
    known = seeds.join(ends, ["query_id", "pos"], "left")
    idle = known.filter("nbrs IS NULL").groupBy("query_id").agg(F.sum("seed").alias("idle"))
    graph = written(known.join(idle, "query_id", "left").withColumn("idle", F.coalesce("idle", F.lit(0.0))), "pagerank-graph")
    state: DataFrame = graph.withColumn("score", F.col("seed"))
    mass: Column = F.col("idle")
    kept: DataFrame | None = None
    for i in range(iterations):
        sent = state.filter("nbrs IS NOT NULL").select("query_id", (F.col("score") / F.size("nbrs")).alias("share"), F.explode("nbrs").alias("pos"))
        got = sent.groupBy("query_id", "pos").agg(F.sum("share").alias("got"))
        score = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + mass * F.col("seed"))
        state = graph.join(got, ["query_id", "pos"], "left").withColumn("score", score).drop("got")
        mass = F.col("idle") * (1 - damping + damping * mass)
        if (i + 1) % cut_every == 0 and i + 1 < iterations:
            kept = state = written(state, "pagerank", kept)
    out = written(state.select("query_id", "pos", "score"), "pagerank-scores", kept)
    discard(graph)
    return out


def graph_rank(candidates: DataFrame, k: int = 10, rarest: int = 2, commonest: int = 20, iterations: int = 30, damping: float = 0.85, cut_every: int = 10) -> DataFrame:
    """(query_id, pos, score, rank): the ``k`` best of (query_id, query, pos, text) by PageRank, then query overlap, then order.

    The seed is each passage's share of the query's terms that passages hold; without any, all passages are equal.
    """
    terms = written(candidates.select("query_id", "pos", graph_terms(F.col("text")).alias("t"), graph_terms(F.col("query")).alias("q")), "pagerank-terms")
    overlap = terms.select("query_id", "pos", F.size(F.array_intersect("q", "t")).alias("overlap"))
    total = overlap.groupBy("query_id").agg(F.sum("overlap").alias("total"), F.count("*").alias("n"))
    seed = F.when(F.col("total") > 0, F.col("overlap") / F.col("total")).otherwise(1 / F.col("n"))
    seeds = overlap.join(total, "query_id").select("query_id", "pos", "overlap", seed.alias("seed"))
    scores = personalised_pagerank(seeds.drop("overlap"), shared_term_links(terms.select("query_id", "pos", "t"), rarest, commonest), iterations, damping, cut_every)
    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("overlap").desc(), "pos")
    ranked = scores.join(overlap, ["query_id", "pos"]).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "pos", "score", "rank")
