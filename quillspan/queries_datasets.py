"""Registered query of the dataset adapters, over JSON text made from the parts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .queries import query, table
from .sources.adapters import adapt_records


@query("""
WITH p AS (SELECT p_partkey AS k, p_name AS n, p_brand AS b, p_type AS t, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'Which ' || p_name || '?' END AS q FROM part)
SELECT 'hotpotqa' AS dataset, k AS place, CASE WHEN k % 2 = 0 THEN 'h' || k ELSE 'q-' || k END AS id, q AS question, b AS answers, b || '#0|' || n || '#0' AS passages, 'One ' || t AS first_text, b || '#0' AS gold, t AS stratum, true AS available, 'dataset,level,primary_metric,split,type' AS keys, '' AS facts, CASE WHEN q = '' THEN 'no question' ELSE '' END AS error FROM p WHERE k % 5 = 0
UNION ALL SELECT '2wikimultihop', k, 'w' || k, q, b || '|' || t, b || '#0', n || ' ' || t, b || '#0|' || n || '#0', 'unknown', true, 'dataset,primary_metric,split,type', '', CASE WHEN q = '' THEN 'no question' ELSE '' END FROM p WHERE k % 5 = 1
UNION ALL SELECT 'musique', k, (2 + k % 4) || 'hop1__' || k, q, n, '0', t, '', CASE WHEN k % 4 < 3 THEN (2 + k % 4) || 'hop' ELSE 'unknown' END, true, 'answerable,dataset,primary_metric,split', '', CASE WHEN q = '' THEN 'no question' ELSE '' END FROM p WHERE k % 5 = 2
UNION ALL SELECT 'strategyqa', k, 's' || k, q, CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END, '', '', '', CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END, false, 'dataset,primary_metric,split,term', n || ' is ' || b || '.|' || t || ' here.', CASE WHEN q = '' THEN 'no question' ELSE '' END FROM p WHERE k % 5 = 3
UNION ALL SELECT 'drop', k, 'drop_dev_' || k, CASE k % 3 WHEN 0 THEN 'How many years of ' || t || '?' WHEN 1 THEN 'How many ' || t || '?' ELSE 'Who is ' || t || '?' END, CASE WHEN k % 2 = 0 THEN '7' ELSE '' END, 'drop_' || k || '#0', n || E'.\\n' || b || '.', '', CASE k % 3 WHEN 0 THEN 'arithmetic' WHEN 1 THEN 'counting' ELSE 'other' END, true, 'dataset,primary_metric,split', '', '' FROM p WHERE k % 5 = 4
""")
def adapted_records(spark, sf):
    """Raw records of five datasets in their own shapes, as questions with passages, gold ids, strata and metadata."""
    p = table(spark, sf, "part")
    k, n, b, t = F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type")
    q = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("Which "), n, F.lit("?"))).alias("question")
    text = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    asked = F.when(k % 3 == 0, text("How many years of ", t, "?")).when(k % 3 == 1, text("How many ", t, "?")).otherwise(text("Who is ", t, "?"))
    pair = lambda title, *s: text('["', title, '",["', *[y for x in s for y in (x, '","')][:-1], '"]]')
    shapes = {
        "hotpotqa": F.to_json(F.struct(F.when(k % 2 == 0, text("h", k)).alias("id"), q, b.alias("answer"), t.alias("type"), (k % 3).alias("level"), F.struct(F.array(b, n).alias("title"), F.array(F.array(F.lit("One"), t), F.array(n)).alias("sentences")).alias("context"), F.struct(F.array(b, b).alias("title"), F.array(F.lit(0), F.lit(1)).alias("sent_id")).alias("supporting_facts"))),
        "2wikimultihop": text('{"_id":"w', k, '","question":"', q, '","answer":["', b, '","', t, '"],"type":"","context":[', pair(b, n, t), ',["odd"]],"supporting_facts":[["', b, '",0],["', n, '",1]]}'),
        "musique": F.to_json(F.struct(text(2 + k % 4, "hop1__", k).alias("id"), q, n.alias("answer"), F.lit(True).alias("answerable"), F.array(F.struct(F.lit(0).alias("idx"), b.alias("title"), t.alias("paragraph_text")), F.struct(F.lit(1).alias("idx"), n.alias("title"), F.lit("").alias("paragraph_text"))).alias("paragraphs"))),
        "strategyqa": F.to_json(F.struct(text("s", k).alias("qid"), q, (k % 2 == 0).alias("answer"), text(n, " is ", b, ". ", t, " here.").alias("facts"), n.alias("term"))),
        "drop": F.to_json(F.struct(text("Paragraph: ", n, ".\n", b, ".\n\nQuestion: ", asked, " ").alias("instruction"), F.when(k % 2 == 0, " 7 ").otherwise(" ").alias("response"))),
    }
    parts = []
    for i, (name, value) in enumerate(shapes.items()):
        r = adapt_records(p.filter(k % 5 == i).select(k.alias("place"), value.alias("value")), name, "dev")
        first = F.coalesce(F.get("passages", F.lit(0))["text"], F.lit(""))
        parts.append(r.select(
            F.col("metadata")["dataset"].alias("dataset"), "place", "id", F.coalesce("question", F.lit("")).alias("question"), F.array_join("answers", "|").alias("answers"), F.array_join("passages.id", "|").alias("passages"), first.alias("first_text"), F.array_join("gold_evidence", "|").alias("gold"),
            "stratum", F.col("available_evidence").alias("available"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("keys"), F.coalesce(F.array_join("gold_facts", "|"), F.lit("")).alias("facts"), F.coalesce("error", F.lit("")).alias("error"),
        ))
    return reduce(lambda x, y: x.unionByName(y), parts)
