from pyspark.sql import functions as F

from quillspan.functions import text as T


def test_clauses_line_by_line_equal_the_whole_texts(spark):
    texts = ["", None, "no brackets. at all", "a (b) c (d. e) f", "one (open\nclosed) two", "x\n\ny (z)\n(w)\r\n) q (", "((n) m) k!(l)", "A. B? C (d)(e) f" + "(" * 3 + "g)", "w" * 60_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.filter("i < 8").select(T.parenthesised_clauses(F.col("t")).alias("a"), F.regexp_extract_all("t", F.lit(r"([^.!?\n]*\([^\n]*?\))"), F.lit(1)).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert df.filter("i = 8").select(T.parenthesised_clauses(F.col("t")).alias("a")).first().a == []
