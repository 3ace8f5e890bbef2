"""Retrieval and ranking as joins and windows: BM25 and its fielded form, cosine, rank fusion.

A corpus is passages (pos, text[, title]); an index is three tables: postings (field, term, pos, tf,
size), terms (field, term, idf) and, by a one-row table, sizes. Queries are (query_id, query). Results are
(query_id, pos, score, rank) with rank from 1. Scores are compared at nine decimals and ties
go to the smaller ``pos``; documents without any hit score 0 and fill up short lists in order of ``pos``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..sources.scratch import written


@dataclass
class Index:
    passages: DataFrame
    postings: DataFrame
    #: statistics; a builder for the store may leave them out
    terms: DataFrame | None = None
    totals: DataFrame | None = None
    #: the smallest places, for short result lists; null if they are not kept
    lowest: list | None = None
    #: the postings in blocks, as ``count_blocks`` makes them; null if they are kept one by one
    blocks: DataFrame | None = None


_TOKEN = re.compile(r"\w+")


def build_index(passages: DataFrame, fields: tuple[str, ...] = ("text",)) -> Index:
    """Postings and term statistics of each field.

    Terms are counted inside the passage's row, so no text is shuffled; postings are written once to the shared scratch
    folder, from which statistics and searches read them.
    """
    return index_of(passages, written(count_terms(passages, fields), "bm25-postings"), fields)


def _text_slices(batches: Iterator[pa.RecordBatch], most: int = 1_000_000, columns: tuple[str, ...] = ("text",)) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about ``most`` bytes of text (one row at least), so that a worker's memory does not follow the size of its input."""
    for b in batches:
        ends = np.cumsum(sum(pa.compute.binary_length(b[c]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns))
        at = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
            yield b.slice(at, end - at)
            at = end


def count_terms(passages: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(field, term, pos, tf, size) of every passage: a token is a run of letters, digits and underscores in lower case."""
    each = [passages.select(F.lit(f).alias("field"), "pos", F.lower(f).alias("text")).filter("text IS NOT NULL") for f in fields]
    held = each[0]
    for e in each[1:]:
        held = held.unionByName(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _text_slices(batches):
            terms, counts, ends, sizes = [], [], [0], []
            for text in b["text"].to_pylist():
                found = _TOKEN.findall(text)
                c = Counter(found)
                terms += c.keys()
                counts += c.values()
                ends.append(len(terms))
                sizes.append(len(found))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_pydict({"field": b["field"], "pos": b["pos"], "size": pa.array(sizes, pa.int32()), "terms": pa.ListArray.from_arrays(ends, pa.array(terms, pa.string())), "tfs": pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))})

    pos = passages.schema["pos"].dataType.simpleString()
    counted = held.mapInArrow(run, f"field string, pos {pos}, size int, terms array<string>, tfs array<bigint>")
    return counted.select("field", "pos", "size", F.explode(F.arrays_zip("terms", "tfs")).alias("x")).select("field", F.col("x.terms").alias("term"), "pos", F.col("x.tfs").alias("tf"), "size")


#: Passages of a slice, queries of a group: what a search holds of both at once.
_SLICE_ROWS, _ASKING = 20_000, 256


def count_blocks(passages: DataFrame, fields: tuple[str, ...] = ("text",), most: int = 8_000_000) -> DataFrame:
    """(range, slice, field, term, df, words, held): a term's postings (pos, tf, size) in a slice of one range are one row.

    A slice is some passages, with about ``most`` bytes of text, in all of their fields. Blocks are a fraction of the postings, so they are sorted and
    written at a fraction of the cost; statistics read only ``df`` and ``words``. ``range`` is a column of the passages, 0 without one; passages
    that come in its order make the fewest blocks.
    """
    ranged = passages if "range" in passages.columns else passages.withColumn("range", F.lit(0))
    given = ranged.select("range", "pos", *[F.lower(f).alias(f"f{i}") for i, f in enumerate(fields)])
    texts_ = tuple(f"f{i}" for i in range(len(fields)))
    names = pa.array(list(fields), pa.string())

    def block_rows(rows: list[pa.RecordBatch], terms: dict[str, int], codes: list[int], tfs: list[int], counts: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        if not codes:
            return
        at = pa.Table.from_batches(rows).combine_chunks()
        pos, part = at["pos"].chunk(0), at["range"].to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(counts)), counts)  # texts are (passage, field) in order
        key = (part[text // len(fields)] * len(fields) + text % len(fields)) * len(terms) + np.array(codes, dtype=np.int64)
        order = np.argsort(key, kind="stable")
        key, text, tf = key[order], text[order], np.array(tfs, dtype=np.int64)[order]
        starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
        ends = np.append(starts, len(key))
        postings = pa.StructArray.from_arrays([pos.take(pa.array(text // len(fields))), pa.array(tf), pa.array(np.array(sizes, dtype=np.int32)[text])], names=["pos", "tf", "size"])
        yield pa.RecordBatch.from_pydict({
            "range": pa.array((key[starts] // len(terms) // len(fields)).astype(np.int32)), "slice": pa.array([str(pos[0].as_py())] * len(starts), pa.string()), "field": names.take(pa.array(text[starts] % len(fields))),
            "term": pa.array(list(terms), pa.string()).take(pa.array(key[starts] % len(terms))), "df": pa.array(np.diff(ends)), "words": pa.array(np.add.reduceat(tf, starts)),
            "held": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), postings),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, terms, codes, tfs, counts, sizes, taken = [], {}, [], [], [], [], 0
        for b in _text_slices(batches, min(most, 1_000_000), texts_):
            for texts in zip(*[b[f].to_pylist() for f in texts_]):
                for text in texts:
                    found = _TOKEN.findall(text) if text else []
                    c = Counter(found)
                    codes += [terms.setdefault(t, len(terms)) for t in c]
                    tfs += c.values()
                    counts.append(len(c))
                    sizes.append(len(found))
            rows.append(b.select(["range", "pos"]))
            taken += sum(b[f].nbytes for f in texts_)
            if taken >= most or len(sizes) >= _SLICE_ROWS * len(fields):
                yield from block_rows(rows, terms, codes, tfs, counts, sizes)
                rows, terms, codes, tfs, counts, sizes, taken = [], {}, [], [], [], [], 0
        yield from block_rows(rows, terms, codes, tfs, counts, sizes)

    pos_type = passages.schema["pos"].dataType.simpleString()
    return given.mapInArrow(run, f"range int, slice string, field string, term string, df bigint, words bigint, held array<struct<pos:{pos_type},tf:bigint,size:int>>")


def single_blocks(postings: DataFrame, place: Column) -> DataFrame:
    """Postings that are kept one by one as blocks of one."""
    return postings.select(place.alias("range"), F.pmod(F.xxhash64("pos"), F.lit(1 << 14)).cast("string").alias("slice"), "field", "term", F.lit(1).cast("bigint").alias("df"), F.col("tf").alias("words"), F.array(F.struct("pos", "tf", "size")).alias("held"))


def block_index(passages: DataFrame, blocks: DataFrame) -> Index:
    """An index without statistics over blocks; its postings are the blocks' rows."""
    return Index(passages, blocks.select("field", "term", F.inline("held")), blocks=blocks)


def index_of(passages: DataFrame, postings: DataFrame, fields: tuple[str, ...], blocks: DataFrame | None = None) -> Index:
    """The index over given postings, with document frequencies, idf and mean sizes of each field."""
    counted = blocks if blocks is not None else postings.withColumn("df", F.lit(1)).withColumn("words", F.col("tf"))
    found = counted.groupBy("field", "term").agg(F.sum("df").alias("df"))
    held = passages.agg(F.count("*").alias("n"), *[F.count(f).alias(f"__{f}") for f in fields])
    present = held.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__{f}").alias("texts")) for f in fields])).alias("x")).select("n", "x.field", "x.texts")
    totals = present.join(counted.groupBy("field").agg(F.sum("words").alias("words")), "field", "left").select("field", "n", F.try_divide(F.coalesce("words", F.lit(0)).cast("double"), F.col("texts").cast("double")).alias("mean_size"))
    raw = found.join(F.broadcast(totals), "field").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("field").agg(F.avg("raw").alias("mean_idf"))
    terms = raw.join(F.broadcast(mean), "field").select("field", "term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    return Index(passages, postings, terms, totals, blocks=blocks)


def _asked(index: Index, queries: DataFrame, weights: dict[str, float] | None) -> tuple[DataFrame, DataFrame]:
    """The queries' (query_id, field, term, times, weight), and those that the index knows, with their idf."""
    weights = weights or {"text": 1.0}
    per_field = F.col("weights") if "weights" in queries.columns else F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(float(w)))])
    asked = queries.select("query_id", per_field.alias("w"), F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"), F.first("w").alias("w"))
    asked = asked.select("query_id", "term", "times", F.explode("w").alias("field", "weight")).filter("weight <> 0")
    return asked, asked.join(index.terms.select("field", "term", "idf"), ["field", "term"])


def bm25_scores(index: Index, queries: DataFrame, weights: dict[str, float] | None = None, k1: float = 1.5, b: float = 0.75, also: DataFrame | None = None) -> DataFrame:
    """(query_id, pos, score) of every passage that shares a term with a query; repeated query terms count again.

    ``also`` are further (query_id, pos, score) that are added up with the hits.

    ``weights`` weighs the fields; a query column ``weights`` (map) overrides it for each query.
    """
    asked, known = _asked(index, queries, weights)
    postings = index.postings.join(asked.select("field", "term").distinct(), ["field", "term"], "left_semi")
    hits = postings.join(known, ["field", "term"]).join(F.broadcast(index.totals), "field")
    part = F.col("weight") * F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean_size")))
    parts = hits.select("query_id", "pos", part.alias("score"))
    return (parts if also is None else parts.unionByName(also)).groupBy("query_id", "pos").agg(F.sum("score").alias("score"))


def _best_of_slices(index: Index, queries: DataFrame, k: int, weights: dict[str, float] | None, always: list, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, pos, score) of each slice's ``k`` best hits of each query, and of all hits among the places ``always``.

    A slice has all of its passages' postings, so their scores add up in one task and only the best leave it. The terms that
    are asked for go to the blocks; what a task holds is bounded by the slice and by a group of queries.
    """
    groups = max(1, -(-queries.count() // _ASKING))
    known = _asked(index, queries, weights)[1].join(F.broadcast(index.totals), "field")
    weighed = F.struct("query_id", (F.col("weight") * F.col("times") * F.col("idf")).alias("w"))
    asking = known.groupBy("field", "term", "mean_size", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("group")).agg(F.collect_list(weighed).alias("asking"))
    met = index.blocks.select("slice", "field", "term", "held").join(written(asking, "bm25-asking"), ["field", "term"])
    pos_type, query = index.passages.schema["pos"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        held, asking_ = t["held"].combine_chunks(), t["asking"].combine_chunks()
        bounds = lambda a: np.append(0, np.cumsum(pa.compute.list_value_length(a).to_numpy(zero_copy_only=False)))
        p, a = bounds(held), bounds(asking_)
        pos, tf, size = held.flatten().flatten()
        ids, w = asking_.flatten().flatten()
        pos, ids = pos.dictionary_encode(), ids.dictionary_encode()
        place, asker, w = pos.indices.to_numpy(), ids.indices.to_numpy(), w.to_numpy()
        tf, size, mean = tf.to_numpy(), size.to_numpy(), np.repeat(t["mean_size"].to_numpy(), np.diff(p))
        under = tf + k1 * (1 - b + b * size / mean)
        score, hit = np.zeros((len(ids.dictionary), len(pos.dictionary))), np.zeros((len(ids.dictionary), len(pos.dictionary)), dtype=bool)
        for r in range(len(t)):
            at, times, below = place[p[r] : p[r + 1]], tf[p[r] : p[r + 1]], under[p[r] : p[r + 1]]
            for q, x in zip(asker[a[r] : a[r + 1]].tolist(), w[a[r] : a[r + 1]].tolist()):
                np.add.at(score[q], at, x * times * (k1 + 1) / below)
                hit[q, at] = True
        order = pa.compute.rank(pos.dictionary, tiebreaker="first").to_numpy().astype(np.int64)
        fixed = pa.compute.is_in(pos.dictionary, value_set=pa.array(always, pos.dictionary.type)).to_numpy(zero_copy_only=False)
        chosen = []
        for q in range(len(score)):
            some = np.flatnonzero(hit[q])
            best = some[np.lexsort((order[some], -np.round(score[q, some], 9)))]
            chosen.append(np.concatenate((best[:k], best[k:][fixed[best[k:]]])))
        who, where = np.repeat(np.arange(len(score)), [len(c) for c in chosen]), np.concatenate(chosen)
        return pa.table({"query_id": ids.dictionary.take(pa.array(who)), "pos": pos.dictionary.take(pa.array(where)), "score": score[who, where]})

    return met.groupBy("slice", "group").applyInArrow(run, f"query_id {query}, pos {pos_type}, score double")


def top_k(scores: DataFrame, k: int, order: list[Column] | None = None) -> DataFrame:
    """The k best rows of each query, with their rank."""
    w = Window.partitionBy("query_id").orderBy(*(order or [F.round("score", 9).desc(), F.col("pos")]))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_top_k(index: Index, queries: DataFrame, k: int, weights: dict[str, float] | None = None, pad: bool = True) -> DataFrame:
    """Best k passages of each query; with ``pad``, passages that score 0 fill up, smallest ``pos`` first."""
    filler, first = None, []
    if pad:
        first = index.lowest[:k] if index.lowest is not None and len(index.lowest) >= k else [r.pos for r in index.passages.select("pos").orderBy("pos").limit(k).collect()]  # k numbers
        filler = queries.select("query_id", F.explode(F.array(*[F.lit(p).cast("long") for p in first])).alias("pos"), F.lit(0.0).alias("score"))
    if index.blocks is None:
        return top_k(bm25_scores(index, queries, weights, also=filler), k)
    found = _best_of_slices(index, queries, k, weights, first)
    return top_k((found if filler is None else found.unionByName(filler)).groupBy("query_id", "pos").agg(F.sum("score").alias("score")), k)


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """Exact cosine search of (query_id, vector) queries in all (pos, vector) rows.

    Blocks of queries meet blocks of vectors, one task group each, which keeps the k best of its rows for each of
    its queries; these are merged. The plan is the same for any number of queries. Zero vectors score 0.
    """
    spark = vectors.sparkSession
    asked = max(1, -(-queries.count() // block))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-vectors.count() // (16 * block)))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.select("pos", "vector", place("pos", parts).alias("part"), upto(asked).alias("asked"))
    right = queries.select(F.col("query_id").alias("query"), F.col("vector").alias("wanted"), place("query_id", asked).alias("asked"), upto(parts).alias("part"))
    pos, query = vectors.schema["pos"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def run(rows: pa.Table, asking: pa.Table) -> pa.Table:
        matrix = lambda c: np.stack(c.combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
        if not len(rows) or not len(asking):
            return pa.table({"query_id": asking["query"].slice(0, 0), "pos": rows["pos"].slice(0, 0), "score": pa.array([], pa.float64())})
        v, q = matrix(rows["vector"]), matrix(asking["wanted"])
        q_norm, v_norm = np.sqrt((q * q).sum(axis=1)), np.sqrt((v * v).sum(axis=1))
        score = np.where(q_norm[:, None] == 0, 0.0, q @ v.T / np.maximum(q_norm[:, None] * v_norm[None, :], 1e-12))
        place = pa.compute.rank(rows["pos"].combine_chunks(), tiebreaker="first").to_numpy().astype(np.int64)
        best = np.lexsort((np.broadcast_to(place, score.shape), -np.round(score, 9)), axis=1)[:, :k]
        take = pa.array(best.ravel())
        return pa.table({"query_id": asking["query"].take(pa.array(np.repeat(np.arange(len(q)), best.shape[1]))), "pos": rows["pos"].take(take), "score": np.take_along_axis(score, best, axis=1).ravel()})

    found = left.groupBy("part", "asked").cogroup(right.groupBy("part", "asked")).applyInArrow(run, f"query_id {query}, pos {pos}, score double")
    return top_k(found, k)


def rank_fusion(ranked: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list_id, pos, rank); ties go to the best rank, then the id."""
    fused = ranked.groupBy("query_id", "pos").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score"), F.min("rank").alias("best_rank"))
    return top_k(fused, k, [F.round("score", 12).desc(), F.col("best_rank"), F.col("pos")])


def hybrid(sparse: DataFrame, dense: DataFrame, k: int, rrf_k: int = 60, sparse_weight: float = 1.0, dense_weight: float = 1.0) -> DataFrame:
    """Weighted fusion of two ranked lists; ties keep the sparse order, then the dense order."""
    s = sparse.select("query_id", "pos", F.col("score").alias("bm25_score"), F.col("rank").alias("sparse_rank"))
    d = dense.select("query_id", "pos", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank"))
    both = s.join(d, ["query_id", "pos"], "full_outer")
    part = lambda w, r: F.coalesce(w / (rrf_k + F.col(r)), F.lit(0.0))
    both = both.withColumn("score", part(sparse_weight, "sparse_rank") + part(dense_weight, "dense_rank"))
    return top_k(both, k, [F.round("score", 12).desc(), F.col("sparse_rank").asc_nulls_last(), F.col("dense_rank").asc_nulls_last()])


def sparse_only(sparse: DataFrame, k: int, rrf_k: int = 60, weight: float = 1.0) -> DataFrame:
    """The batch form without dense vectors: the score is the fused score of the sparse rank alone."""
    return sparse.filter(F.col("rank") <= k).withColumn("bm25_score", F.col("score")).withColumn("score", weight / (rrf_k + F.col("rank")))


def dual_fusion(slot: DataFrame, question: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """Fuse a slot's and a question's lists; the score of each list's best row is kept beside the fused one."""
    both = slot.select("query_id", "pos", "score", "rank").unionByName(question.select("query_id", "pos", "score", "rank"))
    fused = both.groupBy("query_id", "pos").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("fused"), F.max("score").alias("best_score"))
    return top_k(fused, k, [F.round("fused", 12).desc(), F.round("best_score", 9).desc(), F.col("pos")])


def gate_second_query(slot: DataFrame, threshold: float) -> DataFrame:
    """(query_id, needs_second): whether the slot's best score leaves room for a second query."""
    return slot.groupBy("query_id").agg((F.max("score") < threshold).alias("needs_second"))


def guard_lists(slot: DataFrame, question: DataFrame, relaxed: bool = False) -> DataFrame:
    """(query_id, use_slot_only): the slot's list stands alone where the question's best is weaker and shares no passage."""
    s = slot.groupBy("query_id").agg(F.max("score").alias("slot_max"), F.collect_set("pos").alias("slot_ids"))
    q = question.groupBy("query_id").agg(F.max("score").alias("question_max"), F.collect_set("pos").alias("question_ids"))
    apart = F.size(F.array_intersect("slot_ids", "question_ids")) == 0
    weaker = F.col("question_max") < F.col("slot_max")
    return s.join(q, "query_id").select("query_id", (weaker & (F.lit(relaxed) | apart)).alias("use_slot_only"))


def access_bundle(paths: DataFrame, rrf_k: int = 60) -> DataFrame:
    """Union of access paths (query_id, path, passage_id, score, rank): most paths first, then fused score, best rank, id."""
    merged = paths.groupBy("query_id", "passage_id").agg(
        F.count_distinct("path").alias("n_paths"), F.sum(1.0 / (rrf_k + F.col("rank"))).alias("fused"), F.min("rank").alias("best_rank"), F.max("score").alias("score")
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("n_paths"), F.round("fused", 12).desc(), "best_rank", "passage_id")
    return merged.withColumn("rank", F.row_number().over(w))


def curate(ranked: DataFrame, most: int = 8, by: str = "source_id") -> DataFrame:
    """The first row of each source, at most ``most`` sources for each query."""
    w = Window.partitionBy("query_id", by).orderBy("rank")
    first = ranked.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return first.withColumn("item", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).filter(F.col("item") <= most)


def dedupe_best(ranked: DataFrame) -> DataFrame:
    """One row for each (query, passage) with its best score, by score, ties by first appearance."""
    best = ranked.groupBy("query_id", "pos").agg(F.max("score").alias("score"), F.min("rank").alias("first_rank"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "first_rank", "pos")
    return best.withColumn("rank", F.row_number().over(w))


def rerank(ranked: DataFrame, scores: DataFrame, most: int = 8) -> DataFrame:
    """Replace scores by a reranker's (query_id, pos, rerank_score), best first; rows it does not know keep their order after."""
    both = ranked.join(scores, ["query_id", "pos"], "left")
    both = both.withColumnRenamed("rank", "old_rank")
    return top_k(both, most, [F.col("rerank_score").desc_nulls_last(), F.col("old_rank"), F.col("pos")])
