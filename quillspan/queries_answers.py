"""Registered queries of answer generation, finalisation, rewriting guards, query-variant probes and baseline comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import values as V
from .operators import probes
from .plans import answers as A
from .queries import _LISTS_SQL, _lists, query, table
from .queries_eval import _SCORES_SQL, _scores
from .queries_models import _COUNT, _draws_sql
from .sources.scratch import written

# ---- answers --------------------------------------------------------------------------------

_TEXTS_SQL = """
l AS (SELECT l_orderkey AS k, p_name AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS i FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 20),
q AS (SELECT o_orderkey AS query_id, list(t ORDER BY i) FILTER (t IS NOT NULL) AS ts FROM orders LEFT JOIN l ON k = o_orderkey GROUP BY 1),
s AS (SELECT query_id, ts, CASE WHEN ts IS NOT NULL AND query_id % 5 <> 0 AND query_id % 7 <> 0 THEN list_min(list_transform(ts, lambda x: split_part(x, ' ', 1))) END AS picked, CASE WHEN ts IS NULL THEN 0 WHEN query_id % 5 = 0 THEN 1 ELSE 2 END AS used FROM q),
v AS (SELECT *, CASE WHEN ts IS NOT NULL AND picked IS NULL THEN list_transform([0, 1, 2], lambda n: CASE WHEN query_id % 13 = 0 THEN '' ELSE split_part(ts[n % len(ts) + 1], ' ', 2) END) END AS tries FROM s),
w AS (SELECT *, CASE WHEN query_id % 13 <> 0 THEN CASE WHEN tries[2] = tries[3] AND tries[1] <> tries[2] THEN tries[2] ELSE tries[1] END END AS voted FROM v),
a AS (SELECT query_id, ts, CASE WHEN ts IS NULL THEN NULL WHEN picked IS NOT NULL THEN picked WHEN voted IS NOT NULL THEN voted WHEN query_id % 11 = 0 THEN NULL WHEN query_id % 3 = 0 THEN 'B' || query_id ELSE 'A' || query_id END AS answer,
  CASE WHEN ts IS NULL THEN 'none' WHEN picked IS NOT NULL THEN 'selected' WHEN voted IS NOT NULL THEN 'voted' WHEN query_id % 11 = 0 THEN 'none' WHEN query_id % 3 = 0 THEN 'retry' ELSE 'first' END AS path,
  CAST(used + CASE WHEN tries IS NOT NULL THEN 3 ELSE 0 END + CASE WHEN ts IS NULL OR picked IS NOT NULL OR voted IS NOT NULL THEN 0 WHEN query_id % 11 = 0 OR query_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS calls FROM w)
"""


def _stand_in(task: str, key: object, question: str, texts: list[str], n: int) -> object:
    """A deterministic model: fails by key, else answers with words of the evidence."""
    k = int(key)
    if task == "spans":
        return [] if k % 5 == 0 else [t.split(" ")[0] for t in texts] + ["invented"]
    if task == "select":
        return "" if k % 7 == 0 else min(texts)
    if task == "sample":
        return "" if k % 13 == 0 else texts[n % len(texts)].split(" ")[1]
    return "" if k % 11 == 0 or (n == 0 and k % 3 == 0) else f"{'AB'[n]}{k}"


def _questions(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_quantity > 20").join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    texts = li.groupBy(F.col("l_orderkey").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "p_name"))), lambda x: x["p_name"]).alias("texts"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("What of "), "o_orderkey", F.lit("?")).alias("question"), "o_orderstatus", "o_custkey").join(texts, "query_id", "left")


@query(f"WITH {_TEXTS_SQL} SELECT query_id, coalesce(answer, '') AS answer, path, calls FROM a")
def generated_answers(spark, sf):
    """Spans listed and selected, else a vote of three tries, else a free answer with one retry."""
    out = A.generate_answers(_questions(spark, sf), _stand_in, select=True, samples=3, verify=True)
    return out.withColumn("answer", F.coalesce("answer", F.lit("")))


@query(f"""
WITH {_TEXTS_SQL},
r AS (SELECT a.*, o_orderstatus = 'F' AS polar, CASE o_custkey % 6 WHEN 0 THEN 'timeout' WHEN 1 THEN 'empty' ELSE 'ok' END AS status, CASE o_custkey % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'False' END AS said FROM a JOIN orders ON o_orderkey = query_id)
SELECT query_id, CASE WHEN status = 'timeout' OR ts IS NULL THEN 'old' WHEN polar AND said IS NOT NULL THEN said ELSE coalesce(answer, '') END AS answer, CASE WHEN status = 'timeout' OR ts IS NULL THEN status ELSE 'ok' END AS status,
 CASE WHEN status = 'timeout' OR ts IS NULL THEN 0 ELSE calls END AS generation_calls, status <> 'timeout' AND ts IS NOT NULL AND polar AND said IS NOT NULL AS reconciled, status = 'empty' AND ts IS NOT NULL AS evidence_only FROM r
""")
def final_answers(spark, sf):
    """Results with their answers, polar ones corrected by what was extracted."""
    q = _questions(spark, sf)
    made = A.generate_answers(q, _stand_in, select=True, samples=3, verify=True)
    c = F.col("o_custkey")
    values = F.when(c % 4 == 0, F.array(F.lit("perhaps"), F.lit("Yes, so"))).when(c % 4 == 1, F.array(F.lit("no"), F.lit("yes"))).otherwise(F.array(F.lit("north")))
    results = q.select("query_id", F.when(F.col("o_orderstatus") == "F", "strategyqa").otherwise("musique").alias("dataset"), F.when(c % 6 == 0, "timeout").when(c % 6 == 1, "empty").otherwise("ok").alias("status"), F.col("texts").alias("evidence"), values.alias("values"), F.lit("old").alias("answer"))
    return A.finalise(results, made).withColumn("answer", F.coalesce("answer", F.lit("")))


@query(r"""
WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '?x ' || p_name WHEN 1 THEN p_type ELSE p_brand END AS slot, p_name AS n, p_partkey % 8 AS m FROM part),
 c AS (SELECT *, trim(replace(slot, '?', '')) AS plain FROM s)
SELECT p_partkey, length(plain) >= 8 OR regexp_matches(plain, '[0-9]') AS asked, CASE WHEN NOT (length(plain) >= 8 OR regexp_matches(plain, '[0-9]')) OR m IN (0, 1, 7) OR (m = 2 AND lower(n) = lower(plain)) OR (m = 4 AND plain = '') THEN slot WHEN m = 6 THEN 'thinking aloud' ELSE n || ' facts' END AS rewritten FROM c
""")
def guarded_rewrites(spark, sf):
    """Rewritten slot queries: short names are not asked for, empty, equal and thoughtful replies are guarded against."""
    k, n = F.col("p_partkey"), F.col("p_name")
    slot = F.when(k % 3 == 0, F.concat(F.lit("?x "), n)).when(k % 3 == 1, F.col("p_type")).otherwise(F.col("p_brand"))
    good = F.concat(n, F.lit(" facts"))
    reply = (
        F.when(k % 8 == 0, F.lit(None)).when(k % 8 == 1, "  ").when(k % 8 == 3, F.concat(F.lit(' "'), good, F.lit('" '))).when(k % 8 == 4, F.concat(F.lit("Here's what I found:\n\n'"), good, F.lit("'\nHere you are")))
        .when(k % 8 == 5, F.concat(F.lit("Some thinking first\n"), good, F.lit("\n"))).when(k % 8 == 6, "thinking aloud").when(k % 8 == 7, F.upper(F.trim(F.replace(slot, F.lit("?"), F.lit(""))))).otherwise(good)
    )
    return table(spark, sf, "part").select("p_partkey", A.worth_rewriting(slot).alias("asked"), A.guarded_rewrite(slot, reply).alias("rewritten"))


# ---- probes ---------------------------------------------------------------------------------


@query(_LISTS_SQL + """
, alt AS (SELECT query_id, 'question' AS variant, pos, rank FROM lb UNION ALL SELECT query_id, 'lexical', pos, 21 - rank FROM lb WHERE query_id % 2 = 0),
 h AS (SELECT DISTINCT query_id, query_id % 3 <> 0 AS has_rows FROM la),
 both_ AS (SELECT la.query_id, variant, pos, rank FROM la JOIN (SELECT DISTINCT query_id, variant FROM alt) AS v ON v.query_id = la.query_id WHERE rank <= 10 UNION ALL SELECT query_id, variant, pos, rank FROM alt WHERE rank <= 10),
 fs AS (SELECT query_id, variant, pos, sum(1.0 / (60 + rank)) AS s, min(rank) AS best FROM both_ GROUP BY ALL),
 fu AS (SELECT query_id, variant, pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id, variant ORDER BY round(s, 12) DESC, best, pos) AS r FROM fs) WHERE r <= 5),
 st AS (SELECT query_id, 'slot' AS strategy, pos, 0 AS x FROM la WHERE rank <= 5 UNION ALL SELECT query_id, variant, pos, 0 FROM alt WHERE rank <= 5 UNION ALL SELECT query_id, 'slot_plus_' || variant, pos, 1 FROM fu
  UNION ALL SELECT fu.query_id, 'adaptive_empty_slot_plus_' || variant, pos, 1 FROM fu JOIN h ON h.query_id = fu.query_id WHERE NOT has_rows
  UNION ALL SELECT la.query_id, 'adaptive_empty_slot_plus_' || variant, pos, 0 FROM la JOIN h ON h.query_id = la.query_id AND has_rows JOIN (SELECT DISTINCT query_id, variant FROM alt) AS v ON v.query_id = la.query_id WHERE rank <= 5),
 ca AS (SELECT query_id // 4 AS question_id, strategy, sum(x) AS extra_calls FROM (SELECT DISTINCT query_id, strategy, x FROM st) GROUP BY ALL),
 go AS (SELECT DISTINCT query_id // 4 AS question_id, pos FROM lb WHERE rank <= 2 AND query_id // 4 % 5 <> 0),
 fo AS (SELECT DISTINCT query_id // 4 AS question_id, strategy, pos FROM st)
SELECT ca.question_id, ca.strategy, CAST(extra_calls AS BIGINT) AS extra_calls, count(*) AS gold_count, count(fo.pos) AS hit_count, round(count(fo.pos) / count(*), 6) AS recall, count(fo.pos) = count(*) AS full_support, count(fo.pos) > 0 AS any_support
FROM ca JOIN go ON go.question_id = ca.question_id LEFT JOIN fo ON fo.question_id = ca.question_id AND fo.strategy = ca.strategy AND fo.pos = go.pos GROUP BY ALL
""")
def variant_probes(spark, sf):
    """Recall of each question's gold passages by the slot query, other forms of it, and both."""
    a, b = (written(x, "probe-lists") for x in _lists(spark, sf))  # both are read many times
    rows = b.select("query_id", F.lit("question").alias("variant"), "pos", "rank").unionByName(b.filter("query_id % 2 = 0").select("query_id", F.lit("lexical").alias("variant"), "pos", (21 - F.col("rank")).alias("rank")))
    has = a.select("query_id", (F.col("query_id") % 3 != 0).alias("has_rows")).distinct()
    question = F.floor(F.col("query_id") / 4).alias("question_id")
    gold = b.filter("rank <= 2").select(question, "pos").filter("question_id % 5 <> 0")
    out = probes.probe_recall(probes.probe_strategies(a.select("query_id", "pos", "rank"), rows, has, 5, 10), a.select("query_id", question).distinct(), gold)
    return out.withColumn("recall", F.round("recall", 6)).withColumn("extra_calls", F.col("extra_calls").cast("long"))


@query(_SCORES_SQL + f"""
, pr AS (SELECT c.dataset, c.method, c.question_id, coalesce(c.score, 0) - coalesce(b.score, 0) AS d FROM m AS c JOIN m AS b ON b.dataset = c.dataset AND b.question_id = c.question_id AND b.method = 'view' WHERE c.method IN ('click', 'purchase')),
 rs AS (SELECT *, {_COUNT} AS c FROM ({_draws_sql("SELECT * FROM pr", "question_id", 400)})),
 dm AS (SELECT dataset, method, draw, sum(c * d) / sum(c) AS mean FROM rs WHERE c > 0 GROUP BY ALL),
 iv AS (SELECT dataset, method, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.975) AS hi, least(1.0, 2 * least(avg(CAST(mean <= 0 AS INTEGER)), avg(CAST(mean >= 0 AS INTEGER)))) AS p FROM dm GROUP BY ALL),
 tt AS (SELECT dataset, method, count(*) AS n, avg(d) AS mean, count(*) FILTER (d > 1e-8) AS wins, count(*) FILTER (abs(d) <= 1e-8) AS ties, count(*) FILTER (d < -1e-8) AS losses FROM pr GROUP BY ALL),
 o AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS total FROM tt JOIN iv USING (dataset, method))
SELECT dataset, method, n, round(mean, 7) AS mean_difference, wins, ties, losses, round(lo, 7) AS ci_low, round(hi, 7) AS ci_high, round(p, 7) AS p_value, round(max(least(1.0, p * (total - k + 1))) OVER (ORDER BY k), 7) AS p_holm FROM o
""")
def baseline_comparison(spark, sf):
    """Two methods against a fixed baseline, with intervals and corrected p values."""
    out = probes.compare_with_baseline(_scores(spark, sf), "view", ["click", "purchase"], 400)
    return out.select(*[V.rounded(F.col(c), 7).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_METRICS_SQL = """
WITH r AS (SELECT o_orderstatus AS method, o_orderpriority AS dataset, o_custkey AS question_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 10 / 10.0 END AS em, o_totalprice / 1000 AS cost, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, o_custkey ORDER BY o_orderkey) AS i FROM orders),
 u AS (SELECT * FROM r WHERE i = 1),
 x AS (SELECT dataset, method, question_id, 'em' AS metric, em AS v FROM u WHERE em IS NOT NULL UNION ALL SELECT dataset, method, question_id, 'cost', cost FROM u)
SELECT c.dataset, c.method, c.metric, count(*) AS n, round(avg(c.v), 6) AS candidate_mean, round(avg(b.v), 6) AS reference_mean, round(avg(c.v) - avg(b.v), 6) AS delta FROM x AS c JOIN x AS b ON b.dataset = c.dataset AND b.question_id = c.question_id AND b.metric = c.metric AND b.method = 'O' WHERE c.method IN ('F', 'P') GROUP BY ALL
"""


@query(_METRICS_SQL)
def metric_comparison(spark, sf):
    """Means of every metric side by side with the baseline's."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("method"), F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("question_id")).agg(F.min(F.struct("o_orderkey", "o_totalprice")).alias("x"))
    runs = o.select("method", "dataset", "question_id", F.when(F.col("x.o_orderkey") % 3 != 0, F.col("x.o_orderkey") % 10 / 10.0).alias("em"), (F.col("x.o_totalprice") / 1000).alias("cost"))
    out = probes.compare_metrics(runs, "O", ["F", "P"], ["em", "cost"])
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("SELECT l_returnflag AS dataset, count(*) AS triggered, CAST(sum(l_linenumber - 3) AS BIGINT) AS total, count(*) FILTER (l_tax < 0.04 AND l_discount >= 0.04) AS exact_gains, count(*) FILTER (l_tax >= 0.04 AND l_discount < 0.04) AS exact_losses, count(*) FILTER ((l_tax < 0.04) = (l_discount < 0.04)) AS exact_ties FROM lineitem WHERE l_linenumber > 3 GROUP BY 1")
def trigger_audits(spark, sf):
    """Questions in which a guard intervened: whether answers were won or lost."""
    one = lambda c: F.when(F.col(c) < 0.04, 1.0).otherwise(0.0)
    pairs = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("dataset"), (F.col("l_linenumber") - 3).alias("rejections"), one("l_tax").alias("candidate_em"), one("l_discount").alias("baseline_em"))
    return probes.trigger_audit(pairs, "rejections").withColumn("total", F.col("total").cast("long"))


# ---- questions ------------------------------------------------------------------------------

_ASK_SQL = """
WITH a AS (SELECT p_partkey AS k, p_brand AS dataset, CASE p_partkey % 10 WHEN 0 THEN 'How many ' || p_name || 's are red?' WHEN 1 THEN 'How many bolts, and rings, of ' || p_name || '?' WHEN 2 THEN 'In what year was ' || p_name || ' made?' WHEN 3 THEN 'When did ' || p_name || ' stop?'
  WHEN 4 THEN 'Is ' || p_name || ' blue?' WHEN 5 THEN 'Is ' || p_name || ' larger than a ring or not?' WHEN 6 THEN 'Who made the oldest ' || p_name || '?' WHEN 7 THEN 'Name all makers of ' || p_name WHEN 8 THEN 'Which ' || p_name || ' was released?' ELSE 'Who owns ' || p_name || '?' END AS question,
  CASE p_partkey % 6 WHEN 0 THEN ['7', '1,000'] WHEN 1 THEN ['March 3'] WHEN 2 THEN ['Yes'] WHEN 3 THEN ['x', 'y'] WHEN 4 THEN [p_brand] ELSE ['1999'] END AS answers FROM part),
 s AS (SELECT *, CASE k % 10 WHEN 0 THEN 'ONE NUMBER NUMBER' WHEN 1 THEN 'MANY_MULTISET NUMERIC_LIST NUMBER' WHEN 2 THEN 'ONE NUMBER NUMBER' WHEN 3 THEN 'ONE DATE DATE' WHEN 4 THEN 'ONE BOOLEAN BOOLEAN' WHEN 7 THEN 'MANY_SET MULTI_SPAN MULTI' ELSE 'ONE SCALAR_ENTITY ENTITY' END AS spec,
  k % 10 IN (0, 1, 6, 8) AS needs, CASE k % 6 WHEN 0 THEN CASE WHEN k % 10 IN (2, 3) THEN 'DATE' ELSE 'NUMBER' END WHEN 1 THEN 'DATE' WHEN 2 THEN 'BOOLEAN' WHEN 3 THEN 'MULTI' WHEN 4 THEN 'ENTITY' ELSE CASE WHEN k % 10 IN (2, 3) THEN 'DATE' ELSE 'NUMBER' END END AS gold FROM a)
"""


def _asked(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_name")
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    forms = [text("How many ", n, "s are red?"), text("How many bolts, and rings, of ", n, "?"), text("In what year was ", n, " made?"), text("When did ", n, " stop?"), text("Is ", n, " blue?"), text("Is ", n, " larger than a ring or not?"), text("Who made the oldest ", n, "?"), text("Name all makers of ", n), text("Which ", n, " was released?"), text("Who owns ", n, "?")]
    golds = [F.array(F.lit("7"), F.lit("1,000")), F.array(F.lit("March 3")), F.array(F.lit("Yes")), F.array(F.lit("x"), F.lit("y")), F.array("p_brand"), F.array(F.lit("1999"))]
    pick = lambda xs: F.get(F.array(*xs), (k % len(xs)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("dataset"), pick(forms).alias("question"), pick(golds).alias("answers"))


@query(_ASK_SQL + "SELECT k AS p_partkey, split_part(spec, ' ', 1) AS cardinality, split_part(spec, ' ', 2) AS value_type, split_part(spec, ' ', 3) AS category, needs, gold FROM s")
def answer_specs(spark, sf):
    """What each question asks for, and what its gold answers are."""
    q = F.col("question")
    return _asked(spark, sf).select("p_partkey", probes.answer_spec(q).alias("s"), probes.needs_typed_operator(q).alias("needs"), probes.gold_category(F.col("answers"), q).alias("gold")).select("p_partkey", "s.*", "needs", "gold")


@query(_ASK_SQL + "SELECT dataset, count(*) AS n, count(*) FILTER (split_part(spec, ' ', 3) = gold) AS schema_ok, count(*) FILTER (needs) AS needs_op, count(*) FILTER (needs AND k % 2 = 0) AS family_ok FROM s GROUP BY dataset")
def answer_spec_audit(spark, sf):
    """Agreement of the two by dataset."""
    return probes.spec_audit(_asked(spark, sf), F.when(F.col("p_partkey") % 2 == 0, "count").otherwise("scan"))
