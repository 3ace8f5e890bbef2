"""Centroid clustering of integer vectors by annulus search.

By the triangle inequality a centroid within distance ``u`` of a vector has a norm within ``u`` of the vector's
norm. So centroids are sorted by norm once a round; for each vector the centroid next to it in norm gives the
upper bound ``u`` (an exact distance), two binary searches give the centroids whose norms lie in the annulus, and
only these are compared, exactly and in integers. Both ends of the annulus count, so ties on its edge are seen.

A round is one scan: tasks assign their vectors and add them up by cluster, Spark adds the tasks' sums. The driver
holds ``k`` centroids and nothing that grows with the vectors; a lost task is computed again from the table of kept
vectors, which is written once to the shared scratch folder.

Defined cases: vectors that are null, of another length than ``dims``, or with null or non-finite components are
left out; integers are held within +-2^27 (components within +-131,072), so that squared distances fit in 64 bits; an
inertia beyond 64 bits is null; rows that repeat an id or a vector are all kept; a null id hashes as the empty
string and stays null; equal hashes start in order of the vector; fewer than ``k`` vectors make fewer centroids; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize

HELD = 1 << 27


def kept_vectors(embeddings: DataFrame, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<int>): the vectors of ``dims`` finite components as integers floor(scale * x)."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    held = lambda c: F.greatest(F.least(F.floor(c * float(scale)), F.lit(HELD)), F.lit(-HELD)).cast("int")
    return embeddings.filter((F.size("embedding") == dims) & whole).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


class Annulus:
    """Centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        norms = np.sqrt((centroids.astype(np.float64) ** 2).sum(axis=1))
        self.number = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.number], centroids[self.number]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid (ties: smaller number), and how many comparisons it took."""
        r = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        after = np.searchsorted(self.norms, r).clip(0, len(self.norms) - 1)
        before = np.maximum(after - 1, 0)
        start = np.where(r - self.norms[before] < self.norms[after] - r, before, after)
        best = ((v - self.sorted[start]) ** 2).sum(axis=1)
        cluster = self.number[start].copy()
        u = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (1 + r + u)
        lo, hi = np.searchsorted(self.norms, r - u - slack, side="left"), np.searchsorted(self.norms, r + u + slack, side="right")
        compared = len(v)
        for p, number in enumerate(self.number):
            row = np.flatnonzero((lo <= p) & (p < hi) & (start != p))
            compared += len(row)
            d = ((v[row] - self.sorted[p]) ** 2).sum(axis=1)
            won = (d < best[row]) | ((d == best[row]) & (number < cluster[row]))
            best[row[won]], cluster[row[won]] = d[won], number
        return cluster, best, compared


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def cluster_sums(vectors: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int | None]]:
    """Count, componentwise sums and inertia of each cluster after one assignment: ``k`` rows."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("annulus")
        search, n, sums, inertia = Annulus(centroids), np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64), [0] * k
        for b in batches:
            v = _matrix(b, dims)
            cluster, d, _ = search.nearest(v)
            for c in np.unique(cluster):
                mine = cluster == c
                n[c] += mine.sum()
                sums[c] += v[mine].sum(axis=0)
                inertia[c] += sum(d[mine].tolist())
        has = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"c": pa.array(has.astype(np.int32)), "n": pa.array(n[has]), "inertia": pa.array([str(inertia[c]) for c in has], pa.string()), "s": pa.array(list(sums[has]), pa.list_(pa.int64()))})

    part = vectors.select("v").mapInArrow(run, "c int, n long, inertia string, s array<long>")
    total = part.groupBy("c").agg(F.sum("n").alias("n"), F.sum(F.col("inertia").cast("decimal(38,0)")).alias("inertia"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims)])
    count, sums, inertia = np.zeros(k, dtype=np.int64), np.zeros((k, dims), dtype=np.int64), [0] * k
    for r in total.collect():  # one row a centroid
        count[r.c], sums[r.c], inertia[r.c] = r.n, [r[f"s{i}"] for i in range(dims)], int(r.inertia)
    return count, sums, inertia


def first_centroids(vectors: DataFrame, k: int, salt: str = "3:") -> list[list[int]]:
    """The ``k`` vectors with the smallest sha256 of salt and id."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.v) for r in vectors.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def cluster(embeddings: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    out = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    vectors = materialize(kept_vectors(embeddings, dims, scale), "annulus-vectors")
    chosen = first_centroids(vectors, k)
    if not chosen:
        return embeddings.sparkSession.createDataFrame([], out)
    centroids = np.array(chosen, dtype=np.int64)
    for _ in range(rounds):
        n, sums, _ = cluster_sums(vectors, centroids)
        centroids = np.where((n > 0)[:, None], sums // np.maximum(n, 1)[:, None], centroids)
    _, _, inertia = cluster_sums(vectors, centroids)
    fits = lambda x: x if x < 1 << 63 else None
    total, per = fits(sum(inertia)), [fits(x) for x in inertia]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("annulus")
        search = Annulus(centroids)
        for b in batches:
            c, d, _ = search.nearest(_matrix(b, dims))
            at = pa.array(c.astype(np.int32))
            yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "cluster": at, "distance": pa.array(d), "cluster_inertia": pa.array(per, pa.int64()).take(at), "inertia": pa.array([total] * len(c), pa.int64()), "centroid_sha256": pa.array(digest).take(at)})

    return vectors.mapInArrow(run, out)
