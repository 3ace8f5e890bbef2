"""Registered queries of sources and sinks: JSON lines, run records, metric cells, vector caches, windows and baseline methods."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import text as T
from .operators import records as R
from .operators import retrieval
from .plans import methods
from .queries import WORDS, _bm25_sql, _corpus, _index, query, table
from .sources import store
from .sources.records import read_jsonl, write_jsonl
from .sources.scratch import scratch_root


def _folder(spark, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


# ---- JSON -----------------------------------------------------------------------------------


@query("SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def jsonl_roundtrip(spark, sf):
    """All documents written as JSON lines and read back with a schema; separators inside texts don't split lines."""
    d = table(spark, sf, "documents")
    path = _folder(spark, "jsonl")
    write_jsonl(d, path)
    return read_jsonl(spark, path, d.schema).select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


_CELLS_SQL = """
WITH m AS (SELECT o_orderstatus AS dataset, o_orderpriority AS method, o_orderkey % 6 + 1 AS v, o_custkey % 9 AS hits, o_orderkey % 7 / 2.0 AS calls, o_custkey % 2 = 0 AS ok, o_orderkey % 3 AS reasons, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 10 / 10.0 END AS em FROM orders),
 c AS (SELECT dataset, method, 'cache_hits' AS name, CAST(hits AS DOUBLE) AS value FROM m UNION ALL SELECT dataset, method, 'phase.calls', calls FROM m WHERE v >= 4 UNION ALL SELECT dataset, method, 'phase.ok', CAST(ok AS DOUBLE) FROM m UNION ALL SELECT dataset, method, 'reasons_count', reasons FROM m UNION ALL SELECT dataset, method, 'score_em', em FROM m WHERE em IS NOT NULL)
SELECT dataset, method, name, count(value) AS n, round(avg(value), 7) AS mean, min(value) AS low, max(value) AS high FROM c GROUP BY ALL
"""


@query(_CELLS_SQL)
def metric_cells(spark, sf):
    """Every metric of run records of unknown shape, by dataset and method."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    reasons = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (k % 3).cast("int"))
    record = F.struct((k % 6 + 1).alias("schema_version"), F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method"), F.struct(F.struct((c % 9).alias("cache_hits"), F.struct((k % 7 / 2.0).alias("calls"), (c % 2 == 0).alias("ok"), F.lit("x").alias("note")).alias("phase"), reasons.alias("reasons"), F.lit("text").alias("status")).alias("metrics")).alias("result"), F.struct(F.when(k % 5 > 0, k % 10 / 10.0).alias("em")).alias("scores"))
    lines = table(spark, sf, "orders").select(k.alias("record_id"), F.to_json(record).alias("value"))
    since = spark.createDataFrame([("phase.calls", 4)], "name string, version int")
    return R.metric_report(R.metric_cells(lines, since), ["dataset", "method"]).withColumn("mean", F.round("mean", 7))


# ---- vectors and windows --------------------------------------------------------------------


@query("SELECT sha256(text) AS key, any_value(text) AS text FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL) GROUP BY 1")
def vector_cache_gaps(spark, sf):
    """Texts for which a cache filled with every other document lacks a vector."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("pos"), "text")
    cache = d.filter("pos % 2 = 0").select(F.sha2("text", 256).alias("key")).distinct()
    return store.missing_vectors(d, cache)


@query(r"""
WITH d AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{L}]{7,}')[1] AS anchor, string_split(regexp_replace(text, '([.!?])\s+(["''A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM conversations WHERE text IS NOT NULL),
 h AS (SELECT *, list_position(list_transform(parts, lambda s: anchor IS NOT NULL AND contains(lower(s), lower(anchor))), true) - 1 AS i FROM d)
SELECT conv_id, turn, CASE WHEN i IS NULL OR i < 0 THEN '' ELSE array_to_string(parts[greatest(i - 1, 0) + 1 : i + 1 + 1], ' ') END AS win FROM h
""")
def anchor_windows(spark, sf):
    """The sentences around the first one that holds the turn's first long word."""
    c = table(spark, sf, "conversations").filter("text IS NOT NULL")
    anchor = F.regexp_extract_all("text", F.lit(r"(\p{L}{7,})"), F.lit(1))
    win = T.anchor_window(F.col("text"), F.lit("~none~"), F.filter(F.slice(anchor, 1, 1), lambda a: a != ""), 1)
    return c.select("conv_id", "turn", F.coalesce(win, F.lit("")).alias("win"))


@query(_bm25_sql({"text": "text"}, "1.0", 5).replace("SELECT query_id, pos, rank, round(score, 6) AS score FROM r WHERE rank <= 5", "SELECT query_id, count(*) AS passages, CAST(1 AS INTEGER) AS calls, round(max(score), 6) AS best, min(pos) FILTER (rank = 1) AS first FROM r WHERE rank <= 5 GROUP BY query_id"))
def whole_question_baseline(spark, sf):
    """The baseline that asks each item's whole text once."""
    index, docs = _index(spark, sf), _corpus(spark, sf)

    def search(queries):
        return retrieval.bm25_top_k(index, queries, 5).join(docs.select("pos", "text"), "pos").select("query_id", F.col("pos").alias("source_id"), "score", "text")

    questions = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    items, calls = methods.whole_question(questions, search)
    best = items.groupBy("query_id").agg(F.count("*").alias("passages"), F.round(F.max("score"), 6).alias("best"), F.min(F.struct(-F.round("score", 9), "source_id"))["source_id"].alias("first"))
    return best.join(calls, "query_id").select("query_id", "passages", F.col("calls").cast("int").alias("calls"), "best", "first")


@query(f"SELECT doc_id, len({WORDS.format('text')}) AS words, len(list_distinct({WORDS.format('text')})) AS terms FROM documents WHERE text IS NOT NULL AND len({WORDS.format('text')}) > 0")
def counted_terms(spark, sf):
    """Postings summed by document: the index's counts against the tokenizer's."""
    p = retrieval.count_terms(_corpus(spark, sf).select("pos", "text"))
    return p.groupBy(F.col("pos").alias("doc_id")).agg(F.sum("tf").alias("words"), F.count("*").alias("terms"))
