import re

from pyspark.sql import functions as F

from quillspan.operators import retrieval
from quillspan.sources import store


def test_a_passage_lies_in_one_file_of_each_field(spark, tmp_path):
    passages = spark.range(60).select(F.col("id").alias("pos"), F.concat_ws(" ", *[F.concat(F.lit(w), (F.col("id") * i % 7).cast("string")) for i, w in enumerate("abcdefgh", 1)]).alias("text"))
    index, _ = store.open_or_build(spark, f"{tmp_path}/i", passages, lambda p: retrieval.Index(p, retrieval.count_terms(p)))
    files = index.postings.withColumn("file", F.input_file_name()).groupBy("pos", "field").agg(F.count_distinct("file").alias("n"), F.count("*").alias("terms"))
    assert files.filter("n > 1").count() == 0 and files.count() == 60 and files.agg(F.sum("terms")).first()[0] == 480


def test_fillers_join_the_one_sum(spark):
    index = retrieval.build_index(spark.createDataFrame([(1, "red fox"), (2, "fox"), (3, "owl")], "pos long, text string"))
    got = retrieval.bm25_top_k(index, spark.createDataFrame([(7, "red")], "query_id long, query string"), 3)
    assert [(r.pos, r["rank"]) for r in got.orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3)]
    assert len(re.findall(r"Aggregate \[query_id#\d+L?, pos#\d+L?\]", got._jdf.queryExecution().optimizedPlan().toString())) == 1
