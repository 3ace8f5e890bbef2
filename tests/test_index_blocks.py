import pytest
from pyspark.sql import functions as F

from quillspan.operators import retrieval
from quillspan.sources import store

WEIGHTS = {"text": 1.0, "title": 2.0}


@pytest.fixture
def stored(spark, tmp_path):
    passages = spark.range(400).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 11 != 0, F.concat_ws(" ", *[F.concat(F.lit(w), (F.col("id") * i % 7).cast("string")) for i, w in enumerate("abcdefgh", 1)], F.lit("all"))).alias("text"), F.concat(F.lit("a"), (F.col("id") % 5).cast("string")).alias("title"),
    )
    build = lambda p: retrieval.block_index(p, retrieval.count_blocks(p, ("text", "title"), 1000))
    return store.open_or_build(spark, f"{tmp_path}/i", passages, build, store.Identity(fields=("text", "title")))[0], passages


def test_blocks_hold_the_postings_in_fewer_rows(stored):
    index, passages = stored
    one = retrieval.count_terms(passages, ("text", "title"))
    key = ["field", "term", "pos", "tf", "size"]
    assert sorted(map(tuple, index.postings.select(key).collect())) == sorted(map(tuple, one.select(key).collect()))
    assert index.blocks.count() < one.count() / 2
    assert index.postings.select("pos").distinct().count() == index.blocks.select("slice", F.explode("held.pos").alias("pos")).distinct().count() == 400  # all of a passage's postings lie in one slice


@pytest.mark.parametrize("pad", [True, False])
def test_only_the_best_leave_a_slice_and_they_are_the_best(spark, stored, pad):
    index, passages = stored
    plain = retrieval.index_of(passages, retrieval.count_terms(passages, ("text", "title")), ("text", "title"))
    queries = spark.createDataFrame([(1, "a1 a1 b3 all"), (2, "all"), (3, "h6"), (4, "nothing")], "query_id long, query string")
    rows = lambda i: [(r.query_id, r["rank"], r.pos, round(r.score, 9)) for r in retrieval.bm25_top_k(i, queries, 6, WEIGHTS, pad).orderBy("query_id", "rank").collect()]
    assert rows(index) == rows(plain) and len(rows(index)) == (24 if pad else 18)
    slices = index.blocks.select("slice").distinct().count()
    left = retrieval._best_of_slices(index, queries, 6, WEIGHTS, [0, 1, 2]).count()
    assert slices > 3 and left <= slices * 3 * 6 + 9 < retrieval.bm25_scores(plain, queries, WEIGHTS).count()
