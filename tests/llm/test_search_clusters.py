"""TPUT search, binary-code near-duplicates and annulus clustering against plain Python and NumPy."""

import math
import random

import numpy as np
import pytest

from quillspan.llm import annulus, rabitq, tput


# ---- op11 -----------------------------------------------------------------------------------


def brute_search(docs, items, k):
    found = [(i, tput.terms_of(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(tput.terms_of(t))
    out = set()
    for item, terms in asked.items():
        scored = []
        for d, t in found:
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 20 * (100 - 50 + 50 * len(t) * n_docs // n_terms))) for w in terms if w in t)
            if s > 0:
                scored.append((-s, tput.NO_ID if d is None else d, d))
        out |= {(item, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scored, key=lambda x: x[:2])[:k], 1)}
    return out


def searched(spark, docs, items, k=5, segment=7, block=2):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in tput.search(tput.build_lists(d, segment), i, k, block).select("item_id", "rank", "doc_id", "score").collect()}


def test_search_equals_brute_force_with_ties_and_hot_terms(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(["common"] * rng.randint(0, 3) + [words[min(59, int(rng.expovariate(0.08)))] for _ in range(rng.randint(1, 40))])) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(9)]  # ties
    items = [(i, " ".join(rng.sample(words, rng.randint(1, 25)) + ["common"])) for i in range(9)]
    for k in (1, 5, 400):
        assert searched(spark, docs, items, k) == brute_search(docs, items, k)


def test_search_of_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "Straße ÄPFEL äpfel x"), (None, "x y x"), (4, "x y x"), (4, "y " * 20_000 + "needle"), (5, "!!! ---")]
    items = [(1, "Äpfel X"), (2, None), (3, "nothing known"), (None, "y"), (4, "needle"), (4, "x")]
    assert searched(spark, docs, items) == brute_search(docs, [i for i in items if i[1]], 5)
    assert searched(spark, [], items) == set()
    assert searched(spark, docs, []) == set()


def test_terms():
    assert tput.terms_of("A-b_C\x00d9 Ümläut É0") == ["a", "b", "c", "d9", "Ümläut É0"]


def test_thresholds_fetch_prefixes_only():
    import pyarrow as pa

    asking = [[{"item": 0, "m": 2, "t1": 4_000_000, "t2": 0}]] * 2
    lists = pa.table({"docs": [np.arange(50, dtype=np.int32).tobytes(), np.array([7], dtype=np.int32).tobytes()], "counts": [np.ones(50, dtype=np.int32).tobytes(), np.array([3], dtype=np.int32).tobytes()], "weight": [1, 900], "asking": asking})
    own = pa.table({"docs": [np.arange(50, dtype=np.int64).tobytes()], "counts": [np.full(50, 10, dtype=np.int64).tobytes()]})
    seg = tput.Segment(lists, own, 50, 500)
    part, most = seg.fetched([0, 1], 2, 4_000_000)
    assert np.flatnonzero(part).tolist() == [7]  # no entry of the weak list reaches half of the bound
    assert (most >= seg.exact([0, 1], np.arange(50))).all()


# ---- op12 -----------------------------------------------------------------------------------


def brute_links(rows, threshold=0.9):
    rows = [(i, None if v is None else list(v)) for i, v in rows]
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and (v != 0).any()]
    links = {n: set() for n in range(len(good))}
    for a in range(len(good)):
        for b in range(a):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                links[a].add(b)
                links[b].add(a)
    root = list(range(len(good)))
    changed = True
    while changed:
        changed = False
        for a, bs in links.items():
            low = min([root[a], *(root[b] for b in bs)])
            changed |= low != root[a]
            root[a] = low
    first = {}
    for n, (i, _) in enumerate(good):
        first[root[n]] = min(first.get(root[n], i), i)
    return {(i, len(links[n]), first[root[n]]) for n, (i, _) in enumerate(good)}


def family(rng, size, dims, noise):
    base = rng.normal(size=dims)
    base /= np.linalg.norm(base)
    return [base + noise * rng.normal(size=dims) / math.sqrt(dims) for _ in range(size)]


def found_links(spark, rows, **options):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return df, [tuple(r) for r in rabitq.near_duplicates(df.repartition(3), **options).select("vec_id", "n_links", "component_id", "kept").collect()]


@pytest.mark.parametrize("crowd", [512, 16])
def test_links_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(3)
    vectors = [v for noise in (0.05, 0.2, 0.3) for _ in range(4) for v in family(rng, 12, 64, noise)] + list(rng.normal(size=(200, 64)))
    vectors += family(rng, 90, 64, 0.02) + [vectors[5]] * 40  # a crowd of near copies and one of exact copies
    rows = list(enumerate(vectors))
    _, got = found_links(spark, rows, crowd=crowd)
    want = brute_links(rows)
    assert len(got) == len(rows)
    assert sum(n for _, n, _ in want) > 8000
    assert {r[:3] for r in got} == want
    assert all(k == (i == c) for i, _, c, k in got)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine of 0.9 to 0.92, the hardest ones: nine in ten of all links at the least, none too many."""
    rng = np.random.default_rng(11)
    rows, pairs = [], 400
    for n in range(pairs):
        a, b = rng.normal(size=(2, 48))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cos = 0.9 + 0.02 * rng.random() + 1e-9
        rows += [(2 * n, a * rng.uniform(0.1, 9)), (2 * n + 1, cos * a + math.sqrt(1 - cos * cos) * b)]
    _, got = found_links(spark, rows)
    want = brute_links(rows)
    linked = sum(n for _, n, _ in want)
    assert linked >= 2 * pairs
    assert sum(n for _, n, _, _ in got) >= 0.99 * linked
    by_id = {i: n for i, n, _ in want}
    assert all(n <= by_id[i] for i, n, _, _ in got)


def test_vectors_that_cannot_link(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1e-9]), (7, [2.0, 0.0]), (8, [1.0]), (None, [1.0, 0.0]), (9, [-0.0, 1e-300]), (10, [0.0, 5e300])]
    df, got = found_links(spark, rows)
    assert sorted(got, key=str) == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True), (7, 1, 7, True), (8, 0, 8, True), (None, 0, None, False), (9, 1, 9, True), (10, 1, 9, False)], key=str)
    assert rabitq.near_duplicates(df.limit(0)).collect() == []


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 400, 64))
    b = 0.7 * a + 0.7 * b
    a, b = a / np.linalg.norm(a, axis=1)[:, None], b / np.linalg.norm(b, axis=1)[:, None]
    code, factor = rabitq.codes(a)
    est, err = rabitq.estimates(code, factor, b)
    off = est - a @ b.T
    assert abs(off.mean()) < 0.002
    assert 0.6 < (off / err[:, None]).std() < 1.4
    assert (np.abs(off) > 4 * err[:, None]).mean() < 1e-3
    assert np.allclose(np.linalg.norm(rabitq.rotate(a, 128, 0), axis=1), 1)


# ---- op13 -----------------------------------------------------------------------------------


def lloyd(rows, k=8, rounds=10, dims=64):
    import hashlib

    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    cents = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for n in range(len(cents)):
            mine = [v for (_, v), (_, c) in zip(kept, got, strict=True) if c == n]
            if mine:
                cents[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    got = assign()
    per = [sum(d for d, c in got if c == n) for n in range(len(cents))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted([(i, c, d, per[c], sum(per), sha[c]) for (i, _), (d, c) in zip(kept, got, strict=True)], key=str)


def clustered(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, cluster int").repartition(3)
    return sorted([tuple(r) for r in annulus.cluster(df).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()], key=str)


def test_clusters_equal_lloyd(spark):
    rng = np.random.default_rng(5)
    vectors = [(rng.normal(size=64) * rng.choice([0.05, 0.5, 2.0])).tolist() for _ in range(120)]
    vectors += [vectors[0]] * 30 + [[0.0] * 64] * 5
    rows = list(enumerate(vectors)) + [(3, vectors[9]), (None, vectors[4]), (500, None), (501, [1.0] * 63), (502, [1.0] * 63 + [None]), (503, [float("nan")] * 64)]
    assert clustered(spark, rows) == lloyd(rows)


def test_fewer_vectors_than_centroids(spark):
    rows = [(1, [0.5] * 64), (2, [0.25] * 64), (3, [0.25] * 64)]
    assert clustered(spark, rows) == lloyd(rows)
    assert clustered(spark, []) == []


def test_annulus_prunes_and_keeps_ties_on_its_edge():
    cents = np.zeros((6, 64), dtype=np.int64)
    cents[:, 0] = [500, -100, 100, 2000, 4000, 8000]
    v = np.zeros((3, 64), dtype=np.int64)
    v[:, 0] = [0, 300, 7000]
    c, d, compared = annulus.Annulus(cents).nearest(v)
    assert c.tolist() == [1, 0, 5]  # equal distances: the smaller number
    assert d.tolist() == [10_000, 40_000, 1_000_000]
    assert compared < 18
    far = np.array([[1 << 27] * 64, [-(1 << 27)] * 64], dtype=np.int64)
    assert annulus.Annulus(far).nearest(-far)[1].tolist() == [0, 0]
    assert annulus.Annulus(far[:1]).nearest(far[1:])[1].tolist() == [64 * (1 << 56)]
