import unicodedata

from pyspark.sql import functions as F

from quillspan.functions.text import ascii_words
from quillspan.operators import traces


def test_rows_are_checked_once(spark):
    rows = spark.createDataFrame([(1, 0, "p", "Ada", "7")], "context_id long, pos int, source_id string, name string, n string")
    passages = spark.createDataFrame([("p", "Ada was here.")], "source_id string, text string")
    good, verdict = traces.validate_extraction(rows, {"name": "string", "n": "number"}, passages)
    for d in (good, verdict):  # neither result normalises names again
        assert "ascii_words" not in d._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in good.collect()] == [(1, 0, "p", "Ada", "7")] and verdict.first().outcome == "accepted"


def test_ascii_words_of_any_character(spark):
    given = ["", "Mr O'Neil-2_x", "ÀÉ ﬁne ß ½ Ⅷ", "\0\ttab\x7f", "İstanbul ſ", None, *map(chr, range(300))]

    def plain(x):
        flat = unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().casefold()
        return " ".join("".join(ch if ch.isalnum() else " " for ch in flat).split())

    d = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, x string")
    got = [r.w for r in d.select("i", ascii_words(F.col("x")).alias("w")).orderBy("i").collect()]
    assert got == [None if x is None else plain(x) for x in given]
