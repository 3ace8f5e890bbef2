"""Registered queries over nested traces: loss stages, development examples, checks of extracted rows.

Traces are derived from orders (questions) and their lines (materialisations): a line's part, supplier and a number that no table knows
are its candidates, some are selected, give rows and evidence. The SQL works on flat rows, the engine on nested ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import traces
from .queries import query, table

# ---- traces ---------------------------------------------------------------------------------

_LINES_SQL = """
l AS (SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS k, count(*) OVER (PARTITION BY l_orderkey) AS lines,
  'P' || l_partkey || '#0' AS p, 'Q' || l_suppkey || '#0' AS q, 'R' || (l_partkey * 7 % 500) || '#0' AS r, l_quantity > 25 AS wide, l_returnflag <> 'R' AS sel_p, l_discount >= 0.05 AS sel_q, l_linestatus = 'F' AS row_, l_tax AS tax, l_linenumber = 1 AS bound,
  CASE WHEN l_tax <= 0.07 THEN p_name ELSE '' END AS name, p_name FROM lineitem JOIN part ON p_partkey = l_partkey),
f AS (SELECT o, p AS first_p, q AS first_q, p_name AS gold_answer FROM l WHERE k = 1),
i AS (SELECT o_orderkey AS o, gold_answer, CASE o_custkey % 5 WHEN 0 THEN gold_answer WHEN 1 THEN gold_answer || ' extra' WHEN 2 THEN split_part(gold_answer, ' ', 1) || ' zzz' WHEN 3 THEN split_part(gold_answer, ' ', 2) END AS prediction FROM orders JOIN f ON o = o_orderkey),
g AS (SELECT o, first_p AS id FROM f WHERE o % 4 <> 1 UNION ALL SELECT o, first_q FROM f WHERE o % 4 = 2 UNION ALL SELECT o, 'Z9#0' FROM f WHERE o % 12 = 0)
"""


def _items(spark, sf) -> DataFrame:
    """(question_id, gold, answers, gold_answer, prediction, em, available, slot_traces, evidence, rows) of every order with lines."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    read = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    ids = F.array().cast("array<string>")
    cand = lambda *c: F.struct(F.array(*[F.struct(x.alias("source_id")) for x in c]).alias("candidates"))

    def line(l):  # noqa: E741
        """A line's materialisation, made after the shuffle: only the columns that it is made of travel."""
        pid, sid, rid = F.concat(F.lit("P"), l["l_partkey"], F.lit("#0")), F.concat(F.lit("Q"), l["l_suppkey"], F.lit("#0")), F.concat(F.lit("R"), l["l_partkey"] * 7 % 500, F.lit("#0"))
        name = F.when(l["l_tax"] <= 0.07, l["p_name"]).otherwise("")
        searches = F.when(l["l_quantity"] > 25, F.array(cand(pid, sid), cand(rid))).otherwise(F.array(cand(pid, sid)))
        row = F.array(F.struct(pid.alias("source_id"), F.create_map(F.lit("name"), name).alias("bindings")))
        mat = F.struct(
            searches.alias("searches"), F.concat(F.when(l["l_returnflag"] != "R", F.array(pid)).otherwise(ids), F.when(l["l_discount"] >= 0.05, F.array(sid)).otherwise(ids)).alias("selected_source_ids"), F.when(l["l_linestatus"] == "F", row).alias("extracted_rows"),
            F.when(l["l_linenumber"] == 1, F.create_map(F.lit("name"), F.lit("k"))).alias("binding_context"), F.when(l["l_quantity"] > 25, 2).otherwise(1).alias("retrieval_calls"),
        )
        bare = F.create_map().cast("map<string,string>")
        evidence = F.when(l["l_tax"] >= 0.03, F.array(F.struct(pid.alias("source_id"), bare.alias("bindings")), F.struct(sid.alias("source_id"), bare.alias("bindings"))))
        kept = F.when((l["l_linestatus"] == "F") & (l["l_tax"] < 0.06), row)
        return F.struct(F.concat(F.lit("S"), l["l_linenumber"]).alias("slot_id"), mat.alias("m"), evidence.alias("evidence"), kept.alias("rows"), l["p_name"].alias("p_name"), pid.alias("p"), sid.alias("q"))

    each = li.groupBy(F.col("l_orderkey").alias("question_id")).agg(F.sort_array(F.collect_list(F.struct(*read, "p_name"))).alias("x")).withColumn("x", F.transform("x", line))
    each = each.join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("question_id"), "o_custkey"), "question_id")
    first, o, gold_answer = F.col("x")[0], F.col("question_id"), F.col("x")[0]["p_name"]
    said = F.when(F.col("o_custkey") % 5 == 0, gold_answer).when(F.col("o_custkey") % 5 == 1, F.concat(gold_answer, F.lit(" extra"))).when(F.col("o_custkey") % 5 == 2, F.concat(F.split_part(gold_answer, F.lit(" "), F.lit(1)), F.lit(" zzz"))).when(F.col("o_custkey") % 5 == 3, F.split_part(gold_answer, F.lit(" "), F.lit(2)))
    gold = F.concat(F.when(o % 4 != 1, F.array(first["p"])).otherwise(ids), F.when(o % 4 == 2, F.array(first["q"])).otherwise(ids), F.when(o % 12 == 0, F.array(F.lit("Z9#0"))).otherwise(ids))
    flat = lambda f: F.flatten(F.filter(F.transform("x", lambda l: l[f]), lambda a: a.isNotNull()))
    steps = F.transform("x", lambda l: F.struct(l["slot_id"].alias("slot_id"), F.array(F.lit("name")).alias("variables"), F.array(l["m"]).alias("materializations")))
    return each.select("question_id", gold.alias("gold"), F.array(gold_answer).alias("answers"), gold_answer.alias("gold_answer"), said.alias("prediction"), F.lit(None).cast("double").alias("em"), ids.alias("available"), steps.alias("slot_traces"), flat("evidence").alias("evidence"), flat("rows").alias("rows"))


@query(f"""
WITH {_LINES_SQL},
c AS (SELECT o, p AS id FROM l UNION SELECT o, q FROM l UNION SELECT o, r FROM l WHERE wide),
e AS (SELECT o, p AS id FROM l WHERE tax >= 0.03 UNION SELECT o, q FROM l WHERE tax >= 0.03),
s AS (SELECT o, p AS id FROM l WHERE sel_p UNION SELECT o, q FROM l WHERE sel_q UNION SELECT * FROM e),
w AS (SELECT o, p AS id FROM l WHERE row_ AND tax < 0.06 UNION SELECT * FROM e),
b AS (SELECT DISTINCT o, name FROM l WHERE row_ AND name <> ''),
lost AS (SELECT g.o, bool_or(c.id IS NULL) AS s0, bool_or(s.id IS NULL) AS s1, bool_or(w.id IS NULL) AS s2 FROM g LEFT JOIN c ON c.o = g.o AND c.id = g.id LEFT JOIN s ON s.o = g.o AND s.id = g.id LEFT JOIN w ON w.o = g.o AND w.id = g.id GROUP BY g.o),
n AS (SELECT l.o, any_value(lines) AS lines, count(*) FILTER (row_ AND tax < 0.06) AS rows FROM l GROUP BY l.o),
v AS (SELECT i.o, count(b.name) AS named, coalesce(bool_or(list_has_all(string_split(b.name, ' '), string_split(gold_answer, ' '))), false) AS covered FROM i LEFT JOIN b ON b.o = i.o GROUP BY i.o),
j AS (SELECT i.*, coalesce(s0, false) AS s0, coalesce(s1, false) AS s1, coalesce(s2, false) AS s2, lines, rows, named, covered, list_has_all(string_split(coalesce(prediction, ''), ' '), string_split(gold_answer, ' ')) AS told FROM i JOIN n USING (o) JOIN v USING (o) LEFT JOIN lost USING (o)),
k AS (SELECT o, CASE WHEN prediction = gold_answer THEN 'EM_HIT high' WHEN s0 THEN 'S0_GOLD_SOURCE_NOT_RETRIEVED high' WHEN s1 THEN 'S1_GOLD_SOURCE_NOT_SELECTED high' WHEN s2 THEN 'S2_GOLD_SOURCE_NOT_BUNDLED medium'
 WHEN rows = 0 THEN 'S3_BUNDLE_EMPTY_OR_PARTIAL high' WHEN NOT covered THEN 'S5_GOLD_BINDING_MISSING high' WHEN named > 1 AND covered AND NOT told THEN 'S6_ENTITY_SELECTION_ERROR high'
 WHEN told OR prediction = split_part(gold_answer, ' ', 2) THEN 'S8_GENERATION_EM_WRONG high' WHEN lines <= 1 THEN 'S6_ENTITY_SELECTION_ERROR low' ELSE 'S9_UNRESOLVED low' END AS x FROM j)
SELECT o AS question_id, split_part(x, ' ', 1) AS stage, split_part(x, ' ', 2) AS confidence FROM k
""")
def loss_stages(spark, sf):
    """Where each question's trace lost its gold evidence or answer."""
    return traces.loss_stage(_items(spark, sf)).select("question_id", "stage", "confidence")


@query(f"""
WITH {_LINES_SQL},
t AS (SELECT 'P' || p_partkey || '#0' AS id, p_name AS text FROM part WHERE p_size > 10 UNION ALL SELECT 'Q' || s_suppkey || '#0', s_name FROM supplier),
a AS (SELECT l.*, l_.n AS kp, q_.n AS kq, f.gold_answer, f.first_p, f.first_q FROM l LEFT JOIN (SELECT id, 1 AS n FROM t) AS l_ ON l_.id = l.p LEFT JOIN (SELECT id, 1 AS n FROM t) AS q_ ON q_.id = l.q JOIN f USING (o)),
x AS (SELECT *, kp IS NOT NULL AS has_p, kq IS NOT NULL AS has_q, sel_p AND kp IS NOT NULL AS on_p, sel_q AND kq IS NOT NULL AS on_q, o % 4 <> 1 AS strong,
  o % 4 <> 1 AND p = first_p AS gold_p, (o % 4 = 2 AND q = first_q) AS gold_q, p_name = gold_answer AS said FROM a),
y AS (SELECT *, (on_p AND gold_p) OR (on_q AND gold_q) AS hit, (has_p AND gold_p) OR (has_q AND gold_q) AS within, row_ AND has_p AND (name <> '' OR bound) AS complete FROM x WHERE NOT ((sel_p OR sel_q) AND NOT (on_p OR on_q))),
z AS (SELECT *, sum(CASE WHEN wide THEN 2 ELSE 1 END) OVER w AS calls, max(CAST(on_p AND gold_p AS INTEGER)) OVER w + max(CAST(on_q AND gold_q AS INTEGER)) OVER w AS covered FROM y WINDOW w AS (PARTITION BY o ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT o AS question_id, CAST(k - 1 AS INTEGER) AS trace_no, CASE WHEN strong THEN 'strong_gold_evidence' ELSE 'weak_answer_surface' END AS supervision,
 CAST(CASE WHEN strong THEN hit AND row_ AND has_p AND gold_p AND complete ELSE on_p AND said AND row_ AND has_p AND name <> '' END AS INTEGER) AS label,
 strong AND hit AS gold_selected, strong AND within AS candidate_gold_available, (has_p AND NOT on_p) OR (has_q AND NOT on_q) AS expansion_available, strong AND within AND NOT hit AS expand_topk_recoverable,
 CAST(on_p AS INTEGER) + CAST(on_q AS INTEGER) AS selected_count, CAST(has_p AS INTEGER) + CAST(has_q AS INTEGER) AS candidate_count, CAST(complete AS INTEGER) AS complete_rows,
 CAST(NOT has_p AS INTEGER) + CAST(NOT has_q AS INTEGER) + CAST(wide AS INTEGER) + CAST(row_ AND NOT has_p AS INTEGER) AS missing, CAST(calls AS BIGINT) AS calls_used, CAST(lines - k AS INTEGER) AS remaining_depth, covered AS covered_gold FROM z
""")
def development_examples(spark, sf):
    """Labelled materialisations of every question, with what a wider window would have found."""
    parts = table(spark, sf, "part").filter("p_size > 10").select(F.concat(F.lit("P"), "p_partkey", F.lit("#0")).alias("source_id"), F.col("p_name").alias("text"))
    suppliers = table(spark, sf, "supplier").select(F.concat(F.lit("Q"), "s_suppkey", F.lit("#0")).alias("source_id"), F.col("s_name").alias("text"))
    return traces.development_examples(_items(spark, sf), parts.unionByName(suppliers)).drop("slot_id", "materialization_no")


_CELLS_SQL = """
c AS (SELECT l_orderkey AS context_id, l_linenumber AS pos, 'P' || l_partkey AS source_id, p_name AS item, p_size > 4 AS known_source,
  CASE WHEN l_quantity > 47 THEN 'about ' || CAST(l_quantity AS INTEGER) ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END AS amount, l_quantity > 47 AS bad_amount, CAST(l_quantity AS INTEGER) AS q,
  CASE WHEN l_tax = 0.08 AND l_linenumber % 2 = 0 THEN '' ELSE strftime(l_shipdate, '%Y/%m/%d') END AS day, l_shipdate,
  CASE WHEN o_custkey % 40 = 0 AND l_linenumber = 3 THEN 'perhaps' WHEN o_custkey % 40 = 1 AND l_linenumber = 2 THEN 'unknown' WHEN o_custkey % 3 = 0 AND l_linestatus = 'F' THEN 'No' ELSE ' YES' END AS verdict,
  CASE WHEN o_custkey % 7 = 0 THEN 'Red ' || split_part(p_name, ' ', 2) WHEN o_custkey % 7 = 1 THEN upper(p_name) END AS known_item,
  CASE WHEN l_discount = 0.1 THEN 'Mr ' || p_name WHEN o_custkey % 5 = 2 THEN 'brand 7' ELSE 'Mrs ' || p_name END AS mother, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey)
"""


@query(f"""
WITH {_CELLS_SQL},
r AS (SELECT *, lower(trim(verdict)) AS v, CASE WHEN lower(trim(verdict)) NOT IN ('yes', 'no', 'unknown') THEN 'boolean_invalid' WHEN bad_amount THEN 'typed_invalid' WHEN known_item IS NOT NULL AND lower(known_item) <> item THEN 'propagated_mismatch'
  WHEN NOT known_source THEN 'unknown_source' WHEN o_custkey % 7 = 1 AND pos = 5 THEN 'propagated_ungrounded' WHEN mother = 'brand 7' AND o_custkey % 11 = 0 THEN 'copies_protected' WHEN mother LIKE 'Mr %' THEN 'role_conflict' WHEN day = '' THEN 'incomplete' END AS reason FROM c),
g AS (SELECT context_id, count(*) AS rows, {", ".join(f"count(*) FILTER (reason = '{x}') AS {x}" for x in traces.REASONS)}, count(reason) AS rejected, count(DISTINCT v) FILTER (v IN ('yes', 'no')) AS n, count(*) FILTER (v = 'unknown') AS u FROM r GROUP BY context_id),
o AS (SELECT *, CASE WHEN boolean_invalid > 0 THEN 'repair' WHEN n <> 1 OR u > 0 THEN 'abstain_disagreement' WHEN typed_invalid = rows THEN 'abstain_typed' WHEN role_conflict = rows THEN 'abstain_role' WHEN rejected = rows THEN 'repair' ELSE 'accepted' END AS outcome FROM g)
SELECT context_id, outcome, rows, CASE WHEN outcome = 'accepted' THEN rows - rejected ELSE 0 END AS accepted, {", ".join(traces.REASONS)} FROM o
""")
def extraction_verdicts(spark, sf):
    """Rows extracted for each order, checked against types, propagated values, sources and roles."""
    return _extraction(spark, sf)[1]


@query(f"""
WITH {_CELLS_SQL},
r AS (SELECT *, lower(trim(verdict)) AS v, coalesce(lower(trim(verdict)) IN ('yes', 'no', 'unknown') AND NOT bad_amount AND (known_item IS NULL OR lower(known_item) = item) AND known_source AND NOT (o_custkey % 7 = 1 AND pos = 5) AND NOT (mother = 'brand 7' AND o_custkey % 11 = 0) AND mother NOT LIKE 'Mr %' AND day <> '', false) AS good FROM c),
g AS (SELECT context_id FROM r GROUP BY context_id HAVING bool_and(v IN ('yes', 'no', 'unknown')) AND count(DISTINCT v) = 1 AND count(*) FILTER (v = 'unknown') = 0)
SELECT context_id, pos, source_id, item, CAST(q AS VARCHAR) AS amount, strftime(l_shipdate, '%Y-%m-%d') AS day, v AS verdict, mother FROM r JOIN g USING (context_id) WHERE good
""")
def extraction_rows(spark, sf):
    """The rows that stay, in canonical form."""
    return _extraction(spark, sf)[0]


def _extraction(spark, sf) -> tuple[DataFrame, DataFrame]:
    j = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf, "part"), F.col("p_partkey") == F.col("l_partkey"))
    c, pos, q = F.col("o_custkey"), F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    rows = j.select(
        F.col("l_orderkey").alias("context_id"), pos.alias("pos"),
        # the fifth row of some contexts names a passage that lacks the propagated value
        F.concat(F.when((c % 7 == 1) & (pos == 5), "BP").otherwise("P"), "l_partkey").alias("source_id"), F.col("p_name").alias("item"),
        F.when(F.col("l_quantity") > 47, F.concat(F.lit("about "), q)).otherwise(q).alias("amount"),
        F.when((F.col("l_tax") == 0.08) & (pos % 2 == 0), "").otherwise(F.date_format("l_shipdate", "yyyy/MM/dd")).alias("day"),
        F.when((c % 40 == 0) & (pos == 3), "perhaps").when((c % 40 == 1) & (pos == 2), "unknown").when((c % 3 == 0) & (F.col("l_linestatus") == "F"), "No").otherwise(" YES").alias("verdict"),
        F.when(c % 7 == 0, F.concat(F.lit("Red "), F.split_part("p_name", F.lit(" "), F.lit(2)))).when(c % 7 == 1, F.upper("p_name")).alias("known_item"),
        F.when(F.col("l_discount") == 0.1, F.concat(F.lit("Mr "), "p_name")).when(c % 5 == 2, "brand 7").otherwise(F.concat(F.lit("Mrs "), "p_name")).alias("mother"),
        F.when(c % 11 == 0, F.array(F.lit("Brand 7"))).otherwise(F.array().cast("array<string>")).alias("protected"),
    )
    part = table(spark, sf, "part").filter("p_size > 4")
    passages = part.select(F.concat(F.lit("P"), "p_partkey").alias("source_id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text")).unionByName(part.select(F.concat(F.lit("BP"), "p_partkey").alias("source_id"), F.col("p_brand").alias("text")))
    return traces.validate_extraction(rows, {"item": "string", "amount": "number", "day": "date", "verdict": "boolean", "mother": "string"}, passages)
