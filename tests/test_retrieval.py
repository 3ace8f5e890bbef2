"""Ranking against small brute-force versions."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quillspan.operators import graph, retrieval


def brute_bm25(docs, query):
    toks = [re.findall(r"\w+", d.lower()) for d in docs]
    n, mean = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(t for d in toks for t in set(d))
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    floor = 0.25 * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    out = []
    for d in toks:
        f = Counter(d)
        out.append(sum(idf.get(t, 0) * f[t] * 2.5 / (f[t] + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in re.findall(r"\w+", query.lower())))
    return out


def test_bm25_with_repeated_terms_and_padding(spark):
    rng = random.Random(2)
    docs = [" ".join(rng.choice(["alpha", "beta", "the", "café", "delta"] + [f"w{i}" for i in range(40)]) for _ in range(rng.randrange(1, 14))) for _ in range(20)]
    queries = ["alpha alpha beta", "missing", "café delta"]
    index = retrieval.build_index(spark.createDataFrame(list(enumerate(docs)), "pos long, text string"))
    got = retrieval.bm25_top_k(index, spark.createDataFrame(list(enumerate(queries)), "query_id long, query string"), 6)
    for q, text in enumerate(queries):
        want = brute_bm25(docs, text)
        order = sorted(range(len(docs)), key=lambda i: (-round(want[i], 9), i))
        mine = got.filter(F.col("query_id") == q).orderBy("rank").collect()
        assert [r.pos for r in mine] == order[:6]
        assert all(abs(r.score - want[r.pos]) < 1e-9 for r in mine)


def test_fusion_golden(spark):
    lists = [(0, 0, "abc"), (0, 1, "bda")]
    rows = [(q, l, ord(c), i + 1) for q, l, s in lists for i, c in enumerate(s)]
    got = retrieval.rank_fusion(spark.createDataFrame(rows, "query_id long, list_id long, pos long, rank long"), 3)
    assert [chr(r.pos) for r in got.orderBy("rank").collect()] == ["b", "a", "d"]


def test_cosine_blocks_equal_one_block(spark):
    rng = random.Random(1)
    v = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(30)] + [(30, [0.0] * 4)], "pos long, vector array<double>")
    q = v.filter("pos % 7 = 2 OR pos = 30").select(F.col("pos").alias("query_id"), "vector")
    a = retrieval.cosine_top_k(v, q, 3, block=2).orderBy("query_id", "rank").collect()
    assert a == retrieval.cosine_top_k(v, q, 3).orderBy("query_id", "rank").collect()
    assert [r.pos for r in a if r.query_id == 30] == [0, 1, 2] and all(r.pos == r.query_id for r in a if r.rank == 1 and r.query_id != 30)


def test_graph_rank_prefers_the_linked_passage(spark):
    rows = [(0, "amber engine", 0, "amber engine hall"), (0, "amber engine", 1, "hall of mirrors hall"), (0, "amber engine", 2, "unrelated words entirely")]
    got = graph.graph_rank(spark.createDataFrame(rows, "query_id long, query string, pos long, text string")).orderBy("rank").collect()
    assert [r.pos for r in got] == [0, 1, 2] and abs(sum(r.score for r in got) - 1) < 1e-9


def test_terms_are_counted_in_slices_of_bounded_bytes():
    import pyarrow as pa

    texts = ["a" * 300] * 7 + [None, "", "b" * 5000, "c"]
    batch = pa.RecordBatch.from_pydict({"pos": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    got = list(retrieval._text_slices(iter([batch]), 1000))
    assert [p for b in got for p in b["pos"].to_pylist()] == list(range(len(texts)))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b["text"].to_pylist()) <= 1000 for b in got) and len(got) >= 4
