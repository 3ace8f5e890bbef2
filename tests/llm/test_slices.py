import time

import pyarrow as pa
from pyspark.sql import functions as F

from quillspan.llm import common
from quillspan.llm import sentencepiece_lattice as lattice


def test_rare_answers_are_read_without_an_object_for_each_word():
    kind = pa.list_(pa.struct([("k", pa.int32()), ("ids", pa.list_(pa.int32()))]))
    rare = pa.array([[{"k": 2, "ids": [7, 8]}, {"k": 0, "ids": [1]}, {"k": 1, "ids": []}], None, [], [{"k": 5, "ids": [9]}]], kind)
    assert [lattice._answers(x.values) for x in rare] == [[[1], [], [7, 8]], [], [], [[9]]]  # the second slice's do not begin the flat values
    words = pa.array(["a\0b", "", "é😀"], pa.large_string())
    assert lattice._strings(words) == lattice._strings(pa.chunked_array([words])) == words.to_pylist()


def test_the_words_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_") and f.getName().endswith(".data")}
    words = spark.range(20_000).select(F.concat(F.lit("w"), (F.col("id") % 9_000).cast("string")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    seen = files()
    with common.shuffles_dropped(spark):
        assert common.materialize(words, "words").count() == 9_000
    left = {f.split("_")[1] for f in files() - seen}
    for _ in range(100):  # they are removed by messages
        if len(left) <= 1:
            break
        time.sleep(0.1)
        left = {f.split("_")[1] for f in files() - seen}
    seen, kept = files(), spark.conf.get(common._CLEANUP)
    plain = common.materialize(words.withColumn("n", F.col("n") + 1), "words")
    assert len(left) <= 1 and plain.count() == 9_000 and files() - seen and kept == "false"


def test_a_slice_key_is_a_number_and_follows_the_texts():
    key = lambda *t: lattice._slice_key(pa.RecordBatch.from_pydict({"text": list(t)}))
    assert key("ab", "c") == key("ab", "c") != key("a", "bc") and -(2**63) <= key("") < 2**63


def test_texts_are_split_once_for_short_and_long_words(spark, tmp_path):
    from quillspan.llm.queries import public_path

    marks = str(tmp_path)

    def count(batches):
        open(f"{marks}/{time.time_ns()}", "w").close()
        yield from batches

    docs = spark.createDataFrame([(1, "short words"), (2, "x" * 70)], "doc_id long, text string").coalesce(1).mapInArrow(count, "doc_id long, text string")
    assert lattice.digests(docs, lambda: public_path("piece_bpe_32k.model")).count() == 2
    assert len(list(tmp_path.iterdir())) <= 3  # for the words, the rare words and the slices
