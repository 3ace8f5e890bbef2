"""Registered queries of text rules, records and outcomes, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import evaluate as E
from .operators import stats
from .plans import optimize
from .queries import query, table
from .sources.records import hop_stratum, normalize_passages, normalize_questions, safe_metadata

_ASCII = r"trim(regexp_replace(lower(regexp_replace(strip_accents({}), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query("SELECT n_nationkey, 'located_in ?nation ' || n_name || ' key=' || n_nationkey || ' region=' || n_regionkey AS slot_query FROM nation")
def slot_queries(spark, sf):
    pairs = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("key"), F.col("n_nationkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", T.slot_query(F.lit("located_in"), F.array(F.lit("?nation"), F.col("n_name")), pairs).alias("slot_query"))


@query(f"SELECT doc_id, md5({_ASCII.format('text')}) AS digest FROM documents")
def ascii_forms(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.ascii_words(F.col("text")).cast("binary")).alias("digest"))


_GROUND = f"(SELECT p_partkey, {_ASCII.format('p_name')} AS v, {_ASCII.format('p_type')} AS t, {_ASCII.format('p_brand')} AS b FROM part)"


@query(f"""
SELECT p_partkey, contains(' ' || t || ' ', ' ' || split_part(v, ' ', 1) || ' ') AS first_word,
       contains(' ' || v || ' ' || t || ' ', ' ' || split_part(t, ' ', 2) || ' ') AND split_part(t, ' ', 2) <> '' AS second_word FROM {_GROUND}
WHERE split_part(v, ' ', 1) <> ''
""")
def grounded_values(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", T.ascii_words(F.col("p_name")).alias("v"), T.ascii_words(F.col("p_type")).alias("t"))
    word = lambda c, i: F.coalesce(F.get(F.split(c, " "), F.lit(i)), F.lit(""))
    return p.filter(word("v", 0) != "").select("p_partkey", T.grounded(word("v", 0), F.col("t")).alias("first_word"), T.grounded(word("t", 1), F.col("v"), F.col("t")).alias("second_word"))


@query(f"""
WITH c AS (SELECT conv_id, turn, {_ASCII.format('text')} AS t, list_filter(string_split({_ASCII.format('text')}, ' '), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 1.0 ELSE (CASE WHEN contains(' ' || t || ' ', ' ' || w[1] || ' ') THEN 1 ELSE 0 END + CASE WHEN contains(' ' || t || ' ', ' zebra quilt ') THEN 1 ELSE 0 END) / 2.0 END AS coverage FROM c
""")
def value_coverage(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", T.ascii_words(F.col("text")).alias("t"))
    values = F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.array(F.get(F.split("t", " "), F.lit(0)), F.lit("zebra quilt")))
    return c.select("conv_id", "turn", T.coverage(values, F.col("t"), 1.0).alias("coverage"))


_REPLIES_SQL = r"""
WITH c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '<think>' || text || '</think> ' || replace(text, ' ', chr(10)) WHEN 2 THEN text || ' Answer: ' || text || ' done.' ELSE '<answer id=1>' || text || '</answer> or <FINAL>' || substr(text, 1, 40) || '</final>' END AS t FROM conversations)
"""


@query(_REPLIES_SQL + r"""
, a AS (SELECT *, regexp_replace(t, '(?is)<think\b[^>]*>.*?</think\s*>', '', 'g') AS s FROM c),
 b AS (SELECT *, trim(coalesce(regexp_extract_all(s, '(?is)<(?:answer|final|output|result)\b[^>]*>(.*?)</(?:answer|final|output|result)\s*>', 1)[-1], regexp_split_to_array(s, '(?i)</think\s*>')[-1])) AS u FROM a),
 d AS (SELECT *, trim(regexp_split_to_array(u, '(?i)(?:final\s+answer|answer)\s*(?:is)?\s*[:：]')[-1]) AS v FROM b),
 e AS (SELECT *, list_filter(string_split(v, chr(10)), lambda x: trim(x) <> '') AS l FROM d),
 f AS (SELECT *, CASE WHEN len(l) > 1 AND length(trim(l[-1])) <= 256 THEN trim(l[-1]) ELSE v END AS w FROM e)
SELECT conv_id, turn, trim(replace(regexp_replace(w, '(?i)\s*\b(done|end|finished)\.?\s*$', ''), '`', '')) AS answer FROM f
""")
def answer_spans(spark, sf):
    """Answers in replies made of whole turns: thoughts, tags, marks and lines stand where the text puts them."""
    t, turn = F.col("text"), F.col("turn")
    said = (
        F.when(turn % 4 == 0, t).when(turn % 4 == 1, F.concat(F.lit("<think>"), t, F.lit("</think> "), F.replace(t, F.lit(" "), F.lit("\n")))).when(turn % 4 == 2, F.concat(t, F.lit(" Answer: "), t, F.lit(" done.")))
        .otherwise(F.concat(F.lit("<answer id=1>"), t, F.lit("</answer> or <FINAL>"), F.substring(t, 1, 40), F.lit("</final>")))
    )
    return table(spark, sf, "conversations").select("conv_id", "turn", T.answer_span(said).alias("answer"))


@query(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, '[^.!?\n]*\([^\n]*?\)', 0) AS s FROM documents UNION ALL SELECT p_partkey + 1000000000, [p_name || ' (' || p_brand || ' ' || p_name || ')', p_type || ' (' || p_name || ')  '] FROM part),
 u AS (SELECT doc_id, unnest(s) AS c FROM t),
 h AS (SELECT *, regexp_extract(c, '^(.*?)\s*\((.*)\)\s*$', 1) AS head, regexp_extract(c, '^(.*?)\s*\((.*)\)\s*$', 2) AS inside FROM u)
SELECT doc_id, CASE WHEN head <> '' AND contains(lower(inside), lower(head)) THEN head ELSE c END AS head, count(*) AS n FROM h GROUP BY ALL
""")
def restated_answers(spark, sf):
    """Every parenthesised clause of the documents, and part names restated in their parentheses."""
    docs = table(spark, sf, "documents").select("doc_id", T.parenthesised_clauses(F.col("text")).alias("s"))
    parts = table(spark, sf, "part").select((F.col("p_partkey") + 1_000_000_000).alias("doc_id"), F.array(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(" "), "p_name", F.lit(")")), F.concat("p_type", F.lit(" ("), "p_name", F.lit(")  "))).alias("s"))
    return docs.unionByName(parts).select("doc_id", F.explode("s").alias("c")).select("doc_id", T.unparenthesised(F.col("c")).alias("head")).groupBy("doc_id", "head").agg(F.count("*").alias("n"))


@query(r"""
WITH v AS (SELECT p_partkey, split_part(p_type, ' ', 1) AS value, p_type || ' ' || split_part(p_type, ' ', 1) || 's ' || p_name AS source FROM part),
     w AS (SELECT *, list_filter(regexp_extract_all(source, '[A-Za-z][A-Za-z''-]*'), lambda x: lower(x) <> lower(value) AND abs(length(x) - length(value)) <= 2 AND (starts_with(lower(x), lower(value)) OR starts_with(lower(value), lower(x)))) AS near FROM v)
SELECT p_partkey, CASE WHEN length(value) >= 5 THEN near[1] END AS variant FROM w
""")
def surface_variants(spark, sf):
    value = F.get(F.split("p_type", " "), F.lit(0))
    source = F.concat_ws(" ", "p_type", F.concat(value, F.lit("s")), "p_name")
    return table(spark, sf, "part").select("p_partkey", T.surface_variant(value, source).alias("variant"))


_RUNS = """(SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'budget_exceeded' WHEN 2 THEN 'failed' ELSE 'error' END AS status,
  CASE WHEN event_id % 8 < 4 THEN ' ' ELSE event_type END AS answer,
  CASE event_id % 7 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'Server Error' WHEN 2 THEN 'connection timed out' WHEN 3 THEN 'ValidationError in plan' WHEN 4 THEN NULL WHEN 5 THEN 'rate limit, code 500' ELSE 'other' END AS error FROM events)"""


@query(f"""
SELECT event_id, CASE WHEN status = 'ok' THEN CASE WHEN trim(answer) <> '' THEN 'ok' ELSE 'empty_answer' END
  WHEN status = 'budget_exceeded' THEN status
  WHEN contains(lower(coalesce(error, '')), '429') OR contains(lower(coalesce(error, '')), 'rate limit') THEN 'provider_http_429'
  WHEN contains(lower(coalesce(error, '')), 'server error') THEN 'provider_http_5xx'
  WHEN contains(lower(coalesce(error, '')), 'connection') THEN 'provider_connect'
  WHEN contains(lower(coalesce(error, '')), 'validationerror') THEN 'configuration' ELSE 'other' END AS category FROM {_RUNS}
""")
def failure_categories(spark, sf):
    pick = lambda m, values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % m).cast("int"))
    status = pick(4, ["ok", "budget_exceeded", "failed", "error"])
    answer = F.when(F.col("event_id") % 8 < 4, " ").otherwise(F.col("event_type"))
    error = pick(7, ["HTTP 429", "Server Error", "connection timed out", "ValidationError in plan", None, "rate limit, code 500", "other"])
    return table(spark, sf, "events").select("event_id", T.failure_category(status, error, answer).alias("category"))


@query(r"SELECT doc_id, left(regexp_replace(text, '[^A-Za-z0-9_-]+', '-', 'g'), 80) || '-' || left(sha256(text), 12) AS safe FROM documents WHERE text IS NOT NULL")
def safe_ids(spark, sf):
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", T.safe_id(F.col("text")).alias("safe"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN (o_custkey % 2) * 1.0 WHEN 'O' THEN o_custkey % 7 / 10.0 ELSE o_custkey % 11 / 20.0 END AS score FROM orders
""")
def primary_scores(spark, sf):
    dataset = F.when(F.col("o_orderstatus") == "F", "strategyqa").when(F.col("o_orderstatus") == "O", "drop").otherwise("hotpotqa")
    return table(spark, sf, "orders").select("o_orderkey", E.primary_score(dataset, F.col("o_custkey") % 11 / 20.0, F.col("o_custkey") % 7 / 10.0, (F.col("o_custkey") % 2).cast("double")).alias("score"))


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 5 THEN 'S0' WHEN l_discount < 0.02 THEN 'S1' WHEN l_tax < 0.01 THEN 'S2' WHEN l_returnflag = 'N' THEN 'S3' ELSE 'none' END AS lost FROM lineitem
""")
def first_losses(spark, sf):
    kept = [("S0", F.col("l_quantity") >= 5), ("S1", F.col("l_discount") >= 0.02), ("S2", F.col("l_tax") >= 0.01), ("S3", F.col("l_returnflag") != "N")]
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", E.first_loss(kept).alias("lost"))


# ---- records --------------------------------------------------------------------------------


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'q' || o_orderkey ELSE o_orderpriority END AS question, o_orderstatus AS answer, o_custkey % 2 = 0 AS has_note FROM orders
""")
def question_records(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("q"), F.col("o_orderkey").cast("string"))).alias("question"),
        F.col("o_orderpriority").alias("query"), F.col("o_orderstatus").alias("answer"), F.when(F.col("o_custkey") % 2 == 0, "x").alias("note"),
    )
    q = normalize_questions(raw)
    return q.select("id", "question", F.element_at("answers", 1).alias("answer"), F.map_contains_key("metadata", F.lit("note")).alias("has_note"))


@query("""
SELECT CASE WHEN p_partkey % 2 = 0 THEN 'p' || p_partkey ELSE p_name || '#0' END AS id, CASE WHEN p_partkey % 5 = 0 THEN p_type ELSE p_brand || ' ' || p_type END AS text, p_name AS doc_id FROM part
""")
def passage_records(spark, sf):
    raw = table(spark, sf, "part").select(
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("p"), F.col("p_partkey").cast("string"))).otherwise("").alias("id"), F.col("p_name").alias("title"),
        F.when(F.col("p_partkey") % 5 != 0, F.array("p_brand", "p_type")).alias("text"), F.col("p_type").alias("context"),
    )
    return normalize_passages(raw)


@query("""
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN '2hop' WHEN 1 THEN '3hop' WHEN 2 THEN '4hop' ELSE 'unknown' END AS stratum FROM conversations
""")
def hop_strata(spark, sf):
    prefix = F.get(F.array(F.lit("2hop__"), F.lit("3hop1__"), F.lit("4hop3__"), F.lit("5hop__")), (F.col("conv_id") % 4).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", hop_stratum(F.concat(prefix, F.col("conv_id").cast("string"), F.lit("_2hop"))).alias("stratum"))


@query("SELECT c_custkey, c_mktsegment AS segment, CAST(1 AS BIGINT) AS keys FROM customer")
def safe_metadata_keys(spark, sf):
    m = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("Gold_Evidence"), F.col("c_name"), F.lit("supporting_facts"), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", safe_metadata(m).alias("m")).select("c_custkey", F.col("m")["segment"].alias("segment"), F.size("m").cast("long").alias("keys"))


# ---- outcomes and plans ---------------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 > l_partkey % 2 THEN 'exact_gain' WHEN l_linenumber % 2 < l_partkey % 2 THEN 'exact_loss'
  WHEN l_tax > l_discount THEN 'overlap_gain' WHEN l_tax < l_discount THEN 'overlap_loss' ELSE 'unchanged' END AS change FROM lineitem
""")
def answer_changes(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", stats.change_class(F.col("l_discount"), F.col("l_tax"), F.col("l_partkey") % 2, F.col("l_linenumber") % 2).alias("change"))


@query("""
WITH r AS (SELECT p_brand AS dataset, p_partkey % 3 > 0 AS t, p_size % 2 = 0 AS r FROM part UNION ALL SELECT 'none', true, true FROM part WHERE p_partkey < 3 UNION ALL SELECT 'orders', o_custkey % 9 < 5, o_orderkey % 7 < 4 FROM orders),
 c AS (SELECT dataset, count(*) FILTER (t AND NOT r) AS b, count(*) FILTER (r AND NOT t) AS c FROM r GROUP BY dataset),
 e AS (SELECT dataset, b, c, least(b, c) AS m, b + c AS n, unnest(range(0, least(b, c) + 1)) AS i FROM c),
 s AS (SELECT dataset, b, c, n, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) AS tail, max(CASE WHEN i = m THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) END) AS last FROM e GROUP BY ALL)
SELECT dataset, b, c, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 6) AS p_exact, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * tail - last) END, 6) AS p_mid FROM s
""")
def mcnemar_exact(spark, sf):
    """Exact and mid-p values of discordant pairs counted from the tables."""
    part, orders = table(spark, sf, "part"), table(spark, sf, "orders")
    score = lambda t, r: (t.cast("double").alias("treatment"), r.cast("double").alias("reference"))
    pairs = part.select(F.col("p_brand").alias("dataset"), *score(F.col("p_partkey") % 3 > 0, F.col("p_size") % 2 == 0))
    pairs = pairs.unionByName(part.filter("p_partkey < 3").select(F.lit("none").alias("dataset"), *score(F.lit(True), F.lit(True)))).unionByName(orders.select(F.lit("orders").alias("dataset"), *score(F.col("o_custkey") % 9 < 5, F.col("o_orderkey") % 7 < 4)))
    return stats.mcnemar_exact(pairs, ["dataset"]).select("dataset", "b", "c", F.round("p_exact", 6).alias("p_exact"), F.round("p_mid", 6).alias("p_mid"))


_CARDS = "(SELECT n_regionkey AS plan, count(*) * 1.0 AS a, 2.0 + n_regionkey AS b, 1.5 AS c FROM nation GROUP BY n_regionkey)"


@query(f"""
SELECT plan, a + a * b + a * b * c AS cost, a + a * b + a * b * c - least(a + a*b + a*b*c, a + a*c + a*b*c, b + a*b + a*b*c, b + b*c + a*b*c, c + a*c + a*b*c, c + b*c + a*b*c) AS regret FROM {_CARDS}
""")
def order_regret(spark, sf):
    """Plans of three slots whose cardinalities come from the regions."""
    sizes = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("plan")).agg(F.count("*").cast("double").alias("a")).withColumns({"b": 2.0 + F.col("plan"), "c": F.lit(1.5)})
    cards = {x: F.col(x) for x in "abc"}
    return sizes.select("plan", optimize.order_cost(["a", "b", "c"], cards).alias("cost"), optimize.regret_column(["a", "b", "c"], cards).alias("regret"))
