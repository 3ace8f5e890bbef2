"""Registered queries of the engine with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as T
from .functions import values as V
from .operators import algebra as A
from .operators import evaluate as E
from .operators import graph, policy, retrieval, stats
from .plans.compile import director_extremum
from .plans.execute import Relation, TableMaterializer, execute
from .plans.model import Join, LogicalPlan, Operator, Slot, SlotPlan
from .plans.optimize import SearchOptions, search
from .sources import store
from .sources.records import dense_positions
from .sources.scratch import partitions_for, scratch_root, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

# ---- text -----------------------------------------------------------------------------------


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY term")
def term_frequencies(spark, sf):
    counted = retrieval.count_terms(table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text"))  # in the document's row: only sums by term are shuffled
    return counted.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
     c AS (SELECT doc_id, text, w, len(w) AS n, unnest(range(0, greatest(0, CAST(ceil((len(w) - 384) / 320.0) AS BIGINT)) + 1)) AS chunk_no FROM w)
SELECT doc_id, chunk_no, chunk_no * 320 AS token_start, least(chunk_no * 320 + 384, n) AS token_end,
       md5(CASE WHEN n <= 384 THEN text ELSE array_to_string(w[chunk_no * 320 + 1 : chunk_no * 320 + 384], ' ') END) AS digest FROM c
""")
def doc_chunks(spark, sf):
    c = T.chunks(table(spark, sf, "documents").select("doc_id", "text"))
    return c.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("token_start").cast("long").alias("token_start"), F.col("token_end").cast("long").alias("token_end"), F.md5(F.col("text").cast("binary")).alias("digest"))


_SLOT_SQL = "'born_in ?person Item_' || item_id || ' ?place'"


@query(rf"SELECT item_id, trim(regexp_replace(regexp_replace(replace({_SLOT_SQL}, '_', ' '), '(^|\s)\?[\p{{L}}\p{{N}}_]+', ' ', 'g'), '\s+', ' ', 'g')) AS lexical FROM benchmark")
def lexical_queries(spark, sf):
    q = F.concat(F.lit("born_in ?person Item_"), F.col("item_id"), F.lit(" ?place"))
    return table(spark, sf, "benchmark").select("item_id", T.lexical(q).alias("lexical"))


@query("""
WITH s AS (SELECT item_id, text, 'cites Item_' || item_id AS slot, 'cites Item ' || item_id AS lexical FROM benchmark)
SELECT item_id, slot, text AS question, text || ' ' || slot AS question_plus_slot, lexical AS lexical_slot, text || ' ' || lexical AS question_plus_lexical_slot FROM s
""")
def formulated_queries(spark, sf):
    slot = F.concat(F.lit("cites Item_"), F.col("item_id"))
    forms = ["slot", "question", "question_plus_slot", "lexical_slot", "question_plus_lexical_slot"]
    return table(spark, sf, "benchmark").select("item_id", *[T.formulate(F.col("text"), slot, v).alias(v) for v in forms])


@query("SELECT source, count(*) AS copies, min(doc_id) AS first_id, md5(text) AS digest, row_number() OVER (ORDER BY source, min(doc_id)) - 1 AS pos FROM documents GROUP BY source, text")
def corpus_dedupe(spark, sf):
    d = table(spark, sf, "documents").withColumn("digest", F.md5(F.col("text").cast("binary")))
    one = d.groupBy("source", "digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    return dense_positions(one.select("source", "copies", "first_id", "digest"), ["source", "first_id"])


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '\s+'), lambda w: w NOT IN ('', 'a', 'an', 'the')) AS w FROM documents)
SELECT doc_id, md5(array_to_string(w, ' ')) AS answer, md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')) AS plain FROM w
""")
def answer_forms(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.md5(T.squad_answer(c).cast("binary")).alias("answer"), F.md5(T.plain_answer(c).cast("binary")).alias("plain"))


@query("""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'how many years|how much earlier|how much later|difference between|what is the difference') THEN 'arithmetic'
  WHEN regexp_matches(lower(text), 'how many|how much|number of|count') THEN 'counting'
  WHEN regexp_matches(lower(text), 'first|last|earliest|latest|before|after') THEN 'sorting'
  WHEN regexp_matches(lower(text), 'list|name all|what are all') THEN 'listing'
  WHEN regexp_matches(lower(text), 'more|less|greater|longer|farther|higher|lower') THEN 'comparison' ELSE 'other' END AS operation FROM conversations
""")
def operation_classes(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.operation_class(F.col("text")).alias("operation"))


@query("""
WITH v AS (SELECT doc_id, 'docs:' || source || ':' || source || '#' || (doc_id % 3) || '#chunk-' || (doc_id % 5) AS raw FROM documents)
SELECT doc_id, split_part(split_part(raw, '#chunk-', 1), ':', 3) AS canonical FROM v
""")
def canonical_ids(spark, sf):
    d = table(spark, sf, "documents")
    raw = F.concat(F.lit("docs:"), F.col("source"), F.lit(":"), F.col("source"), F.lit("#"), (F.col("doc_id") % 3).cast("string"), F.lit("#chunk-"), (F.col("doc_id") % 5).cast("string"))
    return d.select("doc_id", T.canonical_id(raw).alias("canonical"))


@query("""
WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: length(x) >= 3 AND NOT list_contains(['the','and','for','that','with','from','was','were','are','this','what','which','who','how'], x))) AS t FROM documents)
SELECT doc_id, len(t) AS n_terms FROM t
""".replace("\\\\", "\\"))
def graph_term_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.graph_terms(F.col("text"))).cast("long").alias("n_terms"))


# ---- retrieval ------------------------------------------------------------------------------


def _bm25_sql(fields: dict[str, str], weight: str, k: int) -> str:
    docs = " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id AS pos, {WORDS.format(c)} AS t FROM documents" for f, c in fields.items())
    return f"""
WITH tok AS ({docs}), doc AS (SELECT field, pos, len(t) AS size FROM tok),
 post AS (SELECT field, pos, term, count(*) AS tf FROM (SELECT field, pos, unnest(t) AS term FROM tok) GROUP BY ALL),
 st AS (SELECT field, count(*) AS n, avg(size) AS mean FROM doc GROUP BY field),
 raw AS (SELECT field, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post JOIN st USING (field) GROUP BY field, term),
 m AS (SELECT field, avg(r) AS a FROM raw GROUP BY field),
 idf AS (SELECT field, term, CASE WHEN r < 0 THEN 0.25 * a ELSE r END AS idf FROM raw JOIN m USING (field)),
 q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({WORDS.format('text')}) AS term FROM benchmark) GROUP BY ALL),
 s AS (SELECT item_id AS query_id, post.pos, sum({weight} * times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))) AS score
       FROM q JOIN idf USING (term) JOIN post USING (field, term) JOIN doc ON doc.field = post.field AND doc.pos = post.pos JOIN st ON st.field = post.field GROUP BY ALL),
 pad AS (SELECT item_id AS query_id, pos, 0.0 AS score FROM benchmark, (SELECT doc_id AS pos FROM documents ORDER BY 1 LIMIT {k})),
 a AS (SELECT query_id, pos, sum(score) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM pad) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM a)
SELECT query_id, pos, rank, round(score, 6) AS score FROM r WHERE rank <= {k}"""


def _corpus(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), "text", F.col("source").alias("title"))


def _items(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "pos", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


_FIELDS = ("text", "title")


def _index(spark, sf) -> retrieval.Index:
    """The one stored index of the documents' texts and titles that all retrieval queries share; built where it is absent or does not fit."""
    path = f"{scratch_root(spark)}/bm25-{hashlib.sha256(sf.encode()).hexdigest()[:16]}"
    return store.open_or_build(spark, path, _corpus(spark, sf), lambda p: retrieval.block_index(p, retrieval.count_blocks(p, _FIELDS)), store.Identity(dataset=sf, fields=_FIELDS))[0]


@query(_bm25_sql({"text": "text"}, "1.0", 10))
def bm25_topk(spark, sf):
    return _ranked(retrieval.bm25_top_k(_index(spark, sf), _items(spark, sf), 10))


@query(_bm25_sql({"text": "text", "title": "source"}, "(CASE post.field WHEN 'title' THEN 2.0 ELSE 1.0 END)", 10))
def bm25f_topk(spark, sf):
    index = _index(spark, sf)
    return _ranked(retrieval.bm25_top_k(index, _items(spark, sf), 10, {"text": 1.0, "title": 2.0}))


@query(_bm25_sql({"text": "text", "title": "source"}, "(CASE WHEN post.field = 'text' THEN 1.0 WHEN item_id % 2 = 0 THEN 0.0 ELSE 2.0 END)", 10))
def bm25_access_modes(spark, sf):
    index = _index(spark, sf)
    title = F.when(F.col("query_id") % 2 == 0, 0.0).otherwise(2.0)
    q = _items(spark, sf).withColumn("weights", F.create_map(F.lit("text"), F.lit(1.0), F.lit("title"), title))
    return _ranked(retrieval.bm25_top_k(index, q, 10))


@query("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, v.vec_id AS pos, list_dot_product(q.e, v.e) / greatest(sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)), 1e-12) AS score FROM v AS q, v WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS rank FROM s)
SELECT query_id, pos, rank, round(score, 6) AS score FROM r WHERE rank <= 5
""")
def cosine_topk(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))
    q = v.filter("pos % 50 = 0").select(F.col("pos").alias("query_id"), "vector")  # the stated query set, against all rows
    return _ranked(retrieval.cosine_top_k(v, q, 5))


_LISTS_SQL = """
WITH g AS (SELECT l_suppkey AS query_id, l_partkey % 500 AS pos, max(l_quantity) AS a, max(l_extendedprice) / 1000 AS b FROM lineitem GROUP BY 1, 2),
 la AS (SELECT query_id, pos, a AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(a, 9) DESC, pos) AS rank FROM g QUALIFY rank <= 20),
 lb AS (SELECT query_id, pos, b AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(b, 9) DESC, pos) AS rank FROM g QUALIFY rank <= 20)
"""


def _lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two ranked lists for each supplier: parts by largest quantity and by largest price. Lines are dealt once, to as many tasks as they need."""
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 500).alias("pos"), "l_quantity", "l_extendedprice")
    g = li.repartition(partitions_for(li), "query_id").groupBy("query_id", "pos")
    g = g.agg(F.max("l_quantity").alias("a"), (F.max("l_extendedprice") / 1000).alias("b"))
    return tuple(retrieval.top_k(g.select("query_id", "pos", F.col(c).alias("score")), 20) for c in ("a", "b"))


@query(_LISTS_SQL + """, f AS (SELECT query_id, pos, sum(1.0 / (60 + rank)) AS s, min(rank) AS best FROM (SELECT * FROM la UNION ALL SELECT * FROM lb) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, best, pos) AS rank FROM f)
SELECT query_id, pos, rank, round(s, 6) AS score FROM r WHERE rank <= 10""")
def rrf_fuse(spark, sf):
    a, b = _lists(spark, sf)
    return _ranked(retrieval.rank_fusion(a.unionByName(b), 10))


@query(_LISTS_SQL + """, f AS (SELECT coalesce(la.query_id, lb.query_id) AS query_id, coalesce(la.pos, lb.pos) AS pos, coalesce(1.0 / (60 + la.rank), 0) + coalesce(0.5 / (60 + lb.rank), 0) AS s, la.rank AS ra, lb.rank AS rb
   FROM la FULL JOIN lb ON la.query_id = lb.query_id AND la.pos = lb.pos),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, ra NULLS LAST, rb NULLS LAST) AS rank FROM f)
SELECT query_id, pos, rank, round(s, 6) AS score FROM r WHERE rank <= 10""")
def hybrid_rrf(spark, sf):
    a, b = _lists(spark, sf)
    return _ranked(retrieval.hybrid(a, b, 10, dense_weight=0.5))


@query(_LISTS_SQL + "SELECT query_id, pos, rank, round(1.0 / (60 + rank), 6) AS score FROM la WHERE rank <= 10")
def sparse_batch(spark, sf):
    return _ranked(retrieval.sparse_only(_lists(spark, sf)[0], 10))


@query(_LISTS_SQL + """, f AS (SELECT query_id, pos, sum(1.0 / (60 + rank)) AS s, max(score) AS best FROM (SELECT * FROM la UNION ALL SELECT * FROM lb) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, round(best, 9) DESC, pos) AS rank FROM f)
SELECT query_id, pos, rank, round(s, 6) AS score FROM r WHERE rank <= 10""")
def dual_query_fusion(spark, sf):
    a, b = _lists(spark, sf)
    return _ranked(retrieval.dual_fusion(a, b, 10).withColumn("score", F.col("fused")))


@query(_LISTS_SQL + "SELECT query_id, max(score) < 50 AS needs_second FROM la GROUP BY query_id")
def dual_query_gate(spark, sf):
    return retrieval.gate_second_query(_lists(spark, sf)[0], 50.0)


@query(_LISTS_SQL + """, x AS (SELECT query_id, max(score) AS m, list(pos) AS ids FROM la GROUP BY 1), y AS (SELECT query_id, max(score) AS m, list(pos) AS ids FROM lb GROUP BY 1)
SELECT x.query_id, y.m < x.m AND len(list_intersect(x.ids, y.ids)) = 0 AS use_slot_only FROM x JOIN y ON x.query_id = y.query_id""")
def dual_query_guard(spark, sf):
    return retrieval.guard_lists(*_lists(spark, sf))


@query(_LISTS_SQL + """, p AS (SELECT 'slot' AS path, * FROM la UNION ALL SELECT 'question', * FROM lb),
 f AS (SELECT query_id, pos % 100 AS passage_id, count(DISTINCT path) AS n_paths, sum(1.0 / (60 + rank)) AS fused, min(rank) AS best_rank, max(score) AS score FROM p GROUP BY 1, 2)
SELECT query_id, passage_id, n_paths, best_rank, round(fused, 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY n_paths DESC, round(fused, 12) DESC, best_rank, passage_id) AS rank FROM f""")
def dual_access_bundle(spark, sf):
    a, b = _lists(spark, sf)
    both = a.withColumn("path", F.lit("slot")).unionByName(b.withColumn("path", F.lit("question"))).withColumn("passage_id", F.col("pos") % 100)
    out = retrieval.access_bundle(both)
    return out.select("query_id", "passage_id", "n_paths", F.col("best_rank").cast("long").alias("best_rank"), F.round("fused", 6).alias("fused"), F.col("rank").cast("long").alias("rank"))


@query(_LISTS_SQL + """, f AS (SELECT query_id, pos, rank, row_number() OVER (PARTITION BY query_id, pos % 7 ORDER BY rank) AS n FROM la), f1 AS (SELECT * FROM f WHERE n = 1)
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS item FROM f1 QUALIFY item <= 8""")
def evidence_curate(spark, sf):
    a, _ = _lists(spark, sf)
    return retrieval.curate(a.withColumn("source_id", F.col("pos") % 7)).select("query_id", "pos", F.col("item").cast("long").alias("item"))


@query(_LISTS_SQL + """, u AS (SELECT * FROM la UNION ALL SELECT * FROM lb), f AS (SELECT query_id, pos, max(score) AS score, min(rank) AS first FROM u GROUP BY ALL)
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first, pos) AS rank, round(score, 6) AS score FROM f""")
def retrieval_dedupe(spark, sf):
    a, b = _lists(spark, sf)
    return _ranked(retrieval.dedupe_best(a.unionByName(b)))


@query(_LISTS_SQL + """, j AS (SELECT la.query_id, la.pos, la.rank AS old, lb.score AS s FROM la LEFT JOIN lb ON la.query_id = lb.query_id AND la.pos = lb.pos)
SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, old, pos) AS rank FROM j QUALIFY rank <= 8""")
def evidence_rerank(spark, sf):
    a, b = _lists(spark, sf)
    out = retrieval.rerank(a, b.select("query_id", "pos", F.col("score").alias("rerank_score")))
    return out.select("query_id", "pos", F.col("rank").cast("long").alias("rank"))


def _graph_sql(candidates: int, k: int = 10, iterations: int = 30) -> str:
    """Rounds written out one after the other over (query, passage) links."""
    stop = ", ".join(f"'{w}'" for w in T.GRAPH_STOP_WORDS)
    terms = lambda c: f"list_distinct(list_filter({WORDS.format(c)}, lambda w: length(w) >= 3 AND w NOT IN ({stop})))"
    found = _bm25_sql({"text": "text"}, "1.0", candidates)
    parts = [
        f"hit AS MATERIALIZED ({found})",
        f"n AS MATERIALIZED (SELECT h.query_id, h.pos, {terms('d.text')} AS t, {terms('b.text')} AS q FROM hit AS h JOIN documents AS d ON d.doc_id = h.pos JOIN benchmark AS b ON b.item_id = h.query_id)",
        "x AS MATERIALIZED (SELECT query_id, pos, unnest(t) AS term FROM n)",
        "rare AS MATERIALIZED (SELECT query_id, term FROM x GROUP BY ALL HAVING count(*) BETWEEN 2 AND 20)",
        "xr AS MATERIALIZED (SELECT x.* FROM x JOIN rare USING (query_id, term))",
        "e AS MATERIALIZED (SELECT DISTINCT a.query_id, a.pos, b.pos AS nbr FROM xr AS a JOIN xr AS b ON a.query_id = b.query_id AND a.term = b.term AND a.pos <> b.pos)",
        "deg AS MATERIALIZED (SELECT query_id, pos, count(*) AS deg FROM e GROUP BY ALL)",
        "ov AS MATERIALIZED (SELECT query_id, pos, len(list_intersect(t, q)) AS overlap FROM n)",
        "seed AS MATERIALIZED (SELECT query_id, pos, overlap, deg, CASE WHEN sum(overlap) OVER w > 0 THEN overlap / sum(overlap) OVER w ELSE 1.0::DOUBLE / count(*) OVER w END AS seed FROM ov LEFT JOIN deg USING (query_id, pos) WINDOW w AS (PARTITION BY query_id))",
        "r0 AS MATERIALIZED (SELECT query_id, pos, overlap, deg, seed, seed AS score FROM seed)",
    ]
    for i in range(iterations):
        parts.append(f"g{i} AS MATERIALIZED (SELECT e.query_id, e.nbr AS pos, sum(score / deg) AS got FROM r{i} JOIN e USING (query_id, pos) GROUP BY ALL)")
        parts.append(f"i{i} AS MATERIALIZED (SELECT query_id, sum(score) AS idle FROM r{i} WHERE deg IS NULL GROUP BY query_id)")
        parts.append(f"r{i + 1} AS MATERIALIZED (SELECT query_id, r.pos, overlap, deg, seed, 0.15 * seed + 0.85 * (coalesce(got, 0) + coalesce(idle, 0) * seed) AS score FROM r{i} AS r LEFT JOIN g{i} AS g USING (query_id, pos) LEFT JOIN i{i} USING (query_id))")
    parts.append(f"o AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, overlap DESC, pos) AS rank FROM r{iterations})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT query_id, pos, rank, round(score, 9) AS score FROM o WHERE rank <= {k}"


@query(_graph_sql(100))
def graph_ranking(spark, sf):
    """The hundred best passages of each item, ranked by how they hang together."""
    docs, items = _corpus(spark, sf), _items(spark, sf)
    hits = written(retrieval.bm25_top_k(_index(spark, sf), items, 100).select("query_id", "pos"), "graph-hits")  # once written its size is known, and texts are not dealt to meet a few rows
    return graph.graph_rank(hits.join(docs.select("pos", "text"), "pos").join(items, "query_id")).withColumn("score", F.round("score", 9))


# ---- the plan operators ---------------------------------------------------------------------

_ORDERS_SQL = """
WITH o AS (SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS id, printf('%.2f', o_totalprice) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority, o_orderstatus AS state, CAST(o_custkey AS VARCHAR) AS cust FROM orders)
"""


def _orders(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("pos"), F.col("o_orderkey").cast("string").alias("id"), F.format_string("%.2f", "o_totalprice").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"), F.col("o_custkey").cast("string").alias("cust"),
    )


@query(_ORDERS_SQL + "SELECT id, price FROM o WHERE CAST(price AS DOUBLE) > 200000 AND lower(priority) >= '3' AND contains(lower(priority), 'n')")
def op_filter_cmp(spark, sf):
    d = A.filter_rows(A.filter_rows(A.filter_rows(_orders(spark, sf), "price", "200,000", "gt"), "priority", "3", "ge"), "priority", "N", "contains")
    return d.select("id", "price")


@query(_ORDERS_SQL + "SELECT id, day FROM o")
def op_project(spark, sf):
    return A.project(_orders(spark, sf), ["id", "day", "absent"]).drop("pos")


@query(_ORDERS_SQL + "SELECT priority, state, arg_min(id, pos) AS id FROM o GROUP BY priority, state")
def op_distinct(spark, sf):
    return A.distinct_on(_orders(spark, sf), ["priority", "state"]).select("priority", "state", "id")


@query("SELECT CAST(count(*) AS VARCHAR) AS n FROM orders")
def op_count(spark, sf):
    return A.count_rows(_orders(spark, sf), "n").select("n")


@query(_ORDERS_SQL + "SELECT id, price FROM o ORDER BY CAST(price AS DOUBLE) DESC, pos LIMIT 25")
def op_sort_limit(spark, sf):
    return A.sort_rows(_orders(spark, sf), "price", True, 25).select("id", "price")


@query(_ORDERS_SQL + "SELECT id, priority, day FROM o ORDER BY lower(day) DESC, pos LIMIT 25")
def op_sort_text(spark, sf):
    return A.sort_rows(_orders(spark, sf), "day", True, 25).select("id", "priority", "day")


@query(_ORDERS_SQL + "SELECT id, price FROM o ORDER BY CAST(price AS DOUBLE), pos LIMIT 1")
def op_argmin(spark, sf):
    return A.extreme_row(_orders(spark, sf), "price", False).select("id", "price")


@query(_ORDERS_SQL + "SELECT id, price FROM o ORDER BY CAST(price AS DOUBLE) DESC, pos LIMIT 1")
def op_argmax(spark, sf):
    return A.extreme_row(_orders(spark, sf), "price", True).select("id", "price")


def _extreme_dates(spark, sf) -> DataFrame:
    o = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return o.select(F.date_format("a", "MMMM d, yyyy").alias("first"), F.date_format("b", "d MMM yyyy").alias("last"), F.ascii("o_orderstatus").alias("pos"))


@query("SELECT 'opened' AS answer WHERE (SELECT bool_and(a < b) FROM (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY o_orderstatus))")
def op_field_extremum(spark, sf):
    return A.field_extremum(_extreme_dates(spark, sf), ["first", "last"], ["opened", "closed"], False).select("answer")


@query("SELECT CASE WHEN o_totalprice > o_custkey THEN 'True' ELSE 'False' END AS comparison FROM orders ORDER BY o_orderkey LIMIT 1")
def op_compare(spark, sf):
    return A.compare_fields(_orders(spark, sf), ["price", "cust"], "gt").select("comparison")


@query("SELECT CASE WHEN count(*) > 0 THEN 'True' ELSE 'False' END AS answer FROM orders WHERE o_totalprice > 1e9")
def op_boolean(spark, sf):
    return A.any_rows(A.filter_rows(_orders(spark, sf), "price", "1e9", "gt")).select("answer")


# Rendering is exact to ten decimals, so the oracle's printf of the double is the measure.
_RENDER = r"CASE WHEN {0} = round({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.10f', {0}), '\.?0+$', '') END"


@query("WITH f AS (SELECT CAST(printf('%.2f', o_totalprice) AS DOUBLE) AS p, CAST(o_custkey AS DOUBLE) AS c FROM orders ORDER BY o_orderkey LIMIT 1)\n" + " UNION ALL ".join(f"SELECT '{n}' AS operation, {_RENDER.format(x)} AS result FROM f" for n, x in (("add", "(p + c)"), ("subtract", "(p - c)"), ("multiply", "(p * c)"), ("divide", "(p / c)"))))
def op_arithmetic(spark, sf):
    o = _orders(spark, sf)
    parts = [A.arithmetic(o, ["price", "cust"], n).select(F.lit(n).alias("operation"), "result") for n in ("add", "subtract", "multiply", "divide")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT CAST((year(b) - year(a)) * 12 + month(b) - month(a) AS VARCHAR) AS months FROM (SELECT min(o_orderdate) AS a, max(o_orderdate) AS b, ascii(o_orderstatus) AS pos FROM orders GROUP BY o_orderstatus) ORDER BY pos LIMIT 1")
def op_month_diff(spark, sf):
    return A.arithmetic(_extreme_dates(spark, sf), ["first", "last"], "date_diff_months", "months").select("months")


@query(r"""
WITH c AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '1,234.5' WHEN 2 THEN '1_000' WHEN 3 THEN '5d' WHEN 4 THEN '-5' WHEN 5 THEN '1906' WHEN 6 THEN '2nd May 1906' WHEN 7 THEN 'May 5, 1906' ELSE source END AS cell FROM documents)
SELECT doc_id, CASE doc_id % 9 WHEN 1 THEN 1234.5 WHEN 2 THEN 1000 WHEN 4 THEN -5 WHEN 5 THEN 1906 END::DOUBLE AS num,
  CASE doc_id % 9 WHEN 5 THEN '1906-01-01' WHEN 6 THEN '1906-05-02' WHEN 7 THEN '1906-05-05' END AS day,
  CASE doc_id % 9 WHEN 1 THEN '1234.5' WHEN 2 THEN '1000' WHEN 4 THEN '-5' WHEN 5 THEN '1906' END AS normal FROM c
""")
def typed_cells(spark, sf):
    cells = ["", "1,234.5", "1_000", "5d", "-5", "1906", "2nd May 1906", "May 5, 1906"]
    cell = F.coalesce(F.get(F.array(*map(F.lit, cells)), (F.col("doc_id") % 9).cast("int")), F.col("source"))
    d = table(spark, sf, "documents").select("doc_id", cell.alias("cell"))
    return d.select("doc_id", V.number(F.col("cell")).alias("num"), F.date_format(V.date(F.col("cell")), "yyyy-MM-dd").alias("day"), V.typed(F.col("cell"), "number").alias("normal"))


# ---- joins and unions -----------------------------------------------------------------------


def _meta(df: DataFrame, slot: str, source: str, score: str | None = None) -> DataFrame:
    s = F.col(score) if score else F.lit(None).cast("double")
    return df.withColumns({"_slot_id": F.lit(slot), "_source_id": F.concat(F.lit(f"{slot}-"), F.col(source).cast("string")), "_source_span": F.lit("span"), "_confidence": F.lit(1.0) if slot == "S1" else F.lit(0.5), "_retrieval_score": s})


def _customers(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("pos"), F.col("c_custkey").cast("string").alias("cust"), F.when(F.col("c_nationkey") > 2, F.col("c_nationkey").cast("string")).otherwise("").alias("nation"), F.col("c_mktsegment").alias("segment"))


_JOIN_SQL = _ORDERS_SQL + ", c AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS cust, CASE WHEN c_nationkey > 2 THEN CAST(c_nationkey AS VARCHAR) ELSE '' END AS nation, c_mktsegment AS segment FROM customer), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS nation, n_name FROM nation)"


@query(_JOIN_SQL + "SELECT id, o.cust, segment, 'S1+S2' AS slot_id, 'S1-' || id || '|S2-' || o.cust AS source_id, 0.5 AS confidence FROM o JOIN c ON o.cust = c.cust")
def slot_join(spark, sf):
    left, right = _meta(_orders(spark, sf).select("pos", "id", "cust"), "S1", "id"), _meta(_customers(spark, sf).select("pos", "cust", "segment"), "S2", "cust")
    j = A.join_rows(left, right, "cust", "cust")
    return j.select("id", "cust", "segment", F.col("_slot_id").alias("slot_id"), F.col("_source_id").alias("source_id"), F.col("_confidence").alias("confidence"))


@query(_JOIN_SQL + "SELECT o.id, c.cust, CASE WHEN o.pos % 3 = 0 THEN 'BUILDING' ELSE c.segment END AS segment FROM o JOIN c ON o.cust = c.cust WHERE o.pos % 3 <> 0 OR c.segment = 'BUILDING'")
def slot_join_conflict(spark, sf):
    o = _orders(spark, sf).withColumn("segment", F.when(F.col("pos") % 3 == 0, "BUILDING"))
    return A.join_rows(o.select("pos", "id", "cust", "segment"), _customers(spark, sf).select("pos", "cust", "segment"), "cust", "cust").select("id", "cust", "segment")


@query("SELECT a.r_name AS left_name, b.n_name AS right_name FROM region AS a, nation AS b")
def slot_cross_bridge(spark, sf):
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("pos"), F.col("r_name").alias("left_name"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("right_name"))
    return A.bridge_rows(n, r).select("left_name", "right_name")


@query(_JOIN_SQL + "SELECT nation, segment FROM (SELECT nation, segment, min(c_custkey) AS p FROM c WHERE nation <> '' GROUP BY ALL) ORDER BY p LIMIT 32")
def sip_contexts(spark, sf):
    return A.binding_contexts(_customers(spark, sf), ["nation", "segment"], 32).select("nation", "segment")


@query(_JOIN_SQL + "SELECT id, o.cust, c.nation, n_name FROM o JOIN c ON o.cust = c.cust JOIN n ON c.nation = n.nation WHERE c.nation <> ''")
def late_join(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_nationkey").cast("string").alias("nation"), "n_name")
    frames = [_orders(spark, sf).select("pos", "id", "cust"), _customers(spark, sf).select("pos", "cust", "nation"), n]
    return A.late_join(frames, [(0, "cust", 1, "cust"), (1, "nation", 2, "nation")]).select("id", "cust", "nation", "n_name")


_BIND_SQL = """
WITH b AS (SELECT l_orderkey * 10 + l_linenumber AS pos, CAST(l_suppkey AS VARCHAR) AS source_id, l_returnflag AS flag, l_linestatus AS state, l_discount * 10 AS confidence, CASE WHEN l_linenumber > 1 THEN l_quantity END AS score FROM lineitem)
"""


def _bindings(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_suppkey").cast("string").alias("_source_id"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
        (F.col("l_discount") * 10).alias("_confidence"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity")).alias("_retrieval_score"), F.lit("S1").alias("_slot_id"), F.lit("").alias("_source_span"),
    )


@query(_BIND_SQL + ", r AS (SELECT *, row_number() OVER (PARTITION BY source_id, flag, state ORDER BY confidence DESC, coalesce(score, 0) DESC, pos % 2, pos) AS n FROM b) SELECT source_id, flag, state, pos AS best, round(confidence, 6) AS confidence FROM r WHERE n = 1")
def binding_merge(spark, sf):
    b = _bindings(spark, sf)
    m = A.merge_bindings(b.filter("pos % 2 = 0").withColumn("_best", F.col("pos")), b.filter("pos % 2 = 1").withColumn("_best", F.col("pos")))
    return m.select(F.col("_source_id").alias("source_id"), "flag", "state", F.col("_best").alias("best"), F.round("_confidence", 6).alias("confidence"))


@query(_BIND_SQL + "SELECT source_id, flag, state, min(pos) AS first_pos FROM b GROUP BY ALL")
def materialize_merge(spark, sf):
    return A.first_bindings(_bindings(spark, sf)).select(F.col("_source_id").alias("source_id"), "flag", "state", F.col("pos").alias("first_pos"))


@query("SELECT e_user AS user_id, least(s, e) AS both_sides, greatest(s - e, 0) AS only_left, greatest(e - s, 0) AS only_right FROM (SELECT user_id AS e_user, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'click') AS e FROM events GROUP BY 1)")
def multiset_actions(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("s"), F.count_if(F.col("event_type") == "click").alias("e"))
    return A.multiset_overlap(c, "user_id", "s", "e").withColumnRenamed("both", "both_sides")
