"""Near-duplicate embeddings by randomly rotated binary codes with stored correction factors.

1. Every vector is made a unit vector, rotated at random (three rounds of random signs and a Hadamard transform of the
   zero-padded vector) and kept as the signs of its coordinates: its code. The code's inner product with the rotated
   vector itself is stored beside it. Dividing a code's product with another rotated vector by this
   factor estimates the cosine without bias, with a standard error known from the factor.
2. Signs of further rotations make bands. With ``bits`` signs a band, vectors at the threshold share one with
   probability p^bits, p = 1 - arccos(threshold) / pi; the number of bands follows so that a pair exactly at the
   threshold is met with probability ``recall``. ``bits`` grows with the logarithm of the rows, so buckets stay small.
3. In each bucket the codes estimate all cosines. Where the upper confidence bound (``errors`` standard errors) is under
   the threshold a pair is refuted; every other pair is computed exactly, in double precision, from the stored vectors.
   A pair is counted in the first band that both share, so nothing is counted twice and no pairs are written:
   a bucket gives each vector's number of links and one link to its group's smallest member.
4. Exact copies count as one vector with a weight. A bucket of more than ``crowd`` vectors is first thinned: vectors
   within half the threshold's angle of one of its pivots are all linked with each other (triangle inequality), which is
   counted by a sum. Then home blocks (the largest such core) meet blocks of guests, and guest blocks each other, one task
   group each, so that a group's rows are bounded by twice ``crowd``, whatever the bucket.
5. Links' components are found by star contraction in the shared scratch folder.

Links are exact (none below the threshold, counts right for the pairs met); pairs may be missed only if they share
no band (1 - ``recall`` at the threshold, less above) or lie outside the confidence bound. Tests measure the recall.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths don't link; a row without an id links with nothing and has a null component; rows that repeat an id are
vectors of their own (each counts the other, if alike); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bagminhash import components
from .common import claim, drop_path, materialize, mix64

CODED = "vec_id long, row long, key binary, dims int, vec binary, code binary, factor double, bands array<long>"


def _width(dims: int) -> int:
    return 1 << max(6, (dims - 1).bit_length())


def rotate(unit: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Rows rotated to ``width`` (a power of two) coordinates; lengths are kept."""
    x = np.zeros((len(unit), width))
    x[:, : unit.shape[1]] = unit
    for r in range(3):
        signs = (mix64(np.arange(width, dtype=np.uint64) + np.uint64((seed * 3 + r) << 32)) >> np.uint64(63)).astype(np.float64) * 2 - 1
        x *= signs
        h = 1
        while h < width:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(len(x), width)
            h *= 2
        x /= math.sqrt(width)
    return x


def signs_of(code: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(code, axis=1, count=width).astype(np.float32) * 2 - 1


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed codes of twice the padded width, and the correction factors."""
    width = 2 * _width(unit.shape[1])
    turned = rotate(unit, width, 0)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / math.sqrt(width)


def estimates(code: np.ndarray, factor: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosines of coded vectors (rows) and given unit vectors (columns), and each row's standard error."""
    width = 2 * _width(unit.shape[1])
    product = signs_of(code, width) @ rotate(unit, width, 0).astype(np.float32).T
    error = np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * (width - 1)))
    return product / (math.sqrt(width) * factor)[:, None], error


def band_plan(rows: int, threshold: float, recall: float, target: int = 128) -> tuple[int, int]:
    """Signs a band and number of bands for so many rows."""
    p = 1 - math.acos(threshold) / math.pi
    bits = min(48, max(8, math.ceil(math.log2(max(2, rows) / target))))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - p**bits))


def band_keys(unit: np.ndarray, bits: int, bands: int) -> np.ndarray:
    width = _width(unit.shape[1])
    need = bits * bands
    turned = np.concatenate([rotate(unit, width, 1 + r) > 0 for r in range(-(-need // width))], axis=1)[:, :need]
    keys = turned.reshape(len(unit), bands, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
    return keys | (np.int64(unit.shape[1] & 0x3FFF) << 48)


def _coder(bits: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rabitq")
        for b in batches:
            vectors = b["embedding"].to_pylist()
            out: list[tuple | None] = [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                if v and b["vec_id"][i].is_valid and None not in v:
                    by_size.setdefault(len(v), []).append(i)
            for dims, at in by_size.items():
                x = np.array([vectors[i] for i in at], dtype=np.float64) + 0.0  # no negative zeros
                with np.errstate(all="ignore"):
                    big = np.abs(x).max(axis=1)
                    fit = np.isfinite(big) & (big > 0)
                x, at = x[fit], [i for i, f in zip(at, fit, strict=True) if f]
                if not at:
                    continue
                unit = x / big[fit][:, None]
                unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
                code, factor = codes(unit)
                keys = band_keys(unit, bits, bands)
                for j, i in enumerate(at):
                    raw = x[j].tobytes()
                    out[i] = (hashlib.blake2b(raw, digest_size=16).digest(), dims, unit[j].tobytes(), code[j].tobytes(), float(factor[j]), keys[j])
            col = lambda n, t: pa.array([None if o is None else o[n] for o in out], t)  # noqa: E731, B023
            yield pa.RecordBatch.from_pydict({"vec_id": b["vec_id"], "row": b["row"], "key": col(0, pa.binary()), "dims": col(1, pa.int32()), "vec": col(2, pa.binary()), "code": col(3, pa.binary()), "factor": col(4, pa.float64()), "bands": col(5, pa.list_(pa.int64()))})

    return run


def _near_pivots(half: float):
    """Vectors within the angle ``half`` of a pivot, with the smallest such pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rabitq")
        for b in batches:
            nodes, core = [], []
            for node, vec, pivots in zip(b["node"].to_pylist(), b["vec"].to_pylist(), b["pivots"].to_pylist(), strict=True):
                cos = np.frombuffer(b"".join(p["vec"] for p in pivots)).reshape(len(pivots), -1) @ np.frombuffer(vec)
                if len(near := np.flatnonzero(cos >= math.cos(half - 1e-6))):
                    nodes.append(node)
                    core.append(min(pivots[i]["node"] for i in near))
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "core": pa.array(core, pa.int64())})

    return run


def _tile(threshold: float, errors: float):
    """Links of one group: side 0 against side 1, or all of side 0 among each other if there is no side 1."""

    def run(t: pa.Table) -> pa.Table:
        claim("rabitq")
        node, weight, band = t["node"].to_numpy(), t["weight"].to_numpy(), t["band"][0].as_py()
        core, side = t["core"].to_numpy(), t["side"].to_numpy()
        flat = lambda c, dtype: np.frombuffer(b"".join(t[c].to_pylist()), dtype=dtype).reshape(len(node), -1)
        unit, code, factor = flat("vec", np.float64), flat("code", np.uint8), t["factor"].to_numpy()
        bands = np.array(t["bands"].to_pylist(), dtype=np.int64)
        cross = bool((side == 1).any())
        rows, cols = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if cross else np.arange(len(node))
        count, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
        links: list[np.ndarray] = []
        for s in range(0, len(rows), 512):
            r = rows[s : s + 512]
            est, err = estimates(code[r], factor[r], unit[cols])
            likely = est + errors * err[:, None] >= threshold
            likely &= (core[r][:, None] != core[cols][None, :]) | (core[r] < 0)[:, None]
            if not cross:
                likely &= r[:, None] < cols[None, :]
            i, j = np.nonzero(likely)
            for c in range(0, len(i), 65536):
                a, b = r[i[c : c + 65536]], cols[j[c : c + 65536]]
                close = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
                a, b = a[close], b[close]
                first = ~(bands[a, :band] == bands[b, :band]).any(axis=1)
                a, b = a[first], b[first]
                np.add.at(count, a, weight[b])
                np.add.at(count, b, weight[a])
                links.append(np.stack((a, b)))
        a, b = np.concatenate(links, axis=1) if links else np.empty((2, 0), dtype=np.int64)
        rank = np.argsort(np.argsort(node))
        label = rank.copy()
        while len(a):
            low = np.minimum(label[a], label[b])
            new = label.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            if (new == label).all():
                break
            label = new
        has = np.flatnonzero(count)
        return pa.table({"node": node[has], "links": count[has], "root": np.sort(node)[label[has]]})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.9, recall: float = 0.999, errors: float = 4.0, crowd: int = 512) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    named = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).withColumn("row", F.monotonically_increasing_id())
    bits, bands = band_plan(embeddings.count(), threshold, recall)
    coded = materialize(named.mapInArrow(_coder(bits, bands), CODED), "rabitq-coded")
    known = coded.filter("key IS NOT NULL")
    copies = materialize(known.groupBy("key").agg(F.min("row").alias("node"), F.count("*").alias("weight")).filter("weight > 1"), "rabitq-copies")
    rows = known.join(copies, "key", "left").select("vec_id", "row", "vec", "code", "factor", "bands", F.coalesce("node", "row").alias("node"), F.coalesce("weight", F.lit(1)).alias("weight"))
    heads = rows.filter("row = node").drop("row", "vec_id")
    met = heads.select("node", F.posexplode("bands").alias("band", "bucket"))
    crowded = materialize(met.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.array_distinct(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(s))) for s in range(8)])).alias("picked")).filter(F.col("n") > crowd), "rabitq-crowded")
    cores = _cores(heads, crowded, threshold) if not crowded.isEmpty() else None
    if cores is not None:
        heads = materialize(heads.join(cores, "node", "left").withColumn("core", F.coalesce("core", F.lit(-1))), "rabitq-heads")
    else:
        heads = heads.withColumn("core", F.lit(-1).cast("long"))
    dealt = heads.select("*", F.posexplode("bands").alias("band", "bucket"))
    if cores is None:
        tiles = dealt.withColumns({"x": F.lit(0), "y": F.lit(0), "side": F.lit(0)})
    else:
        tiles = _tiles(dealt, crowded.select("band", "bucket"), crowd)
    cut = ["node", "weight", "core", "side", "vec", "code", "factor", "bands"]
    found = tiles.select("band", "bucket", "x", "y", *cut).groupBy("band", "bucket", "x", "y").applyInArrow(_tile(threshold, errors), "node long, links long, root long")
    found = materialize(found, "rabitq-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    ids = rows.groupBy("node").agg(F.min("vec_id").alias("low"))
    each = rows.select("vec_id", "node", "weight").join(links, "node", "left").withColumn("links", F.coalesce("links", F.lit(0)) + F.col("weight") - 1)
    if cores is not None:
        edges = edges.unionByName(cores.select(F.col("node").alias("a"), F.col("core").alias("b")))
        mass = heads.filter("core >= 0").groupBy("core").agg(F.sum("weight").alias("mass"))
        each = each.join(cores, "node", "left").join(mass, "core", "left").withColumn("links", F.col("links") + F.coalesce(F.col("mass") - F.col("weight"), F.lit(0)))
    roots = components(edges)
    rooted = each.select("vec_id", "node", "links").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).groupBy("root").agg(F.min("low").alias("component_id"))
    out = rooted.join(lowest, "root").select("vec_id", F.col("links").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = coded.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return out.unionByName(alone)


def _cores(heads: DataFrame, crowded: DataFrame, threshold: float) -> DataFrame:
    """(node, core): vectors of crowded buckets within half the threshold's angle of a pivot; one core each."""
    picked = crowded.select("band", "bucket", F.explode("picked").alias("node")).join(heads.select("node", "vec"), "node")
    pivots = picked.groupBy("band", "bucket").agg(F.collect_list(F.struct("node", "vec")).alias("pivots"))  # at most 8
    # only members of crowded buckets carry their vector to the pivots
    members = heads.select("node", "vec", F.posexplode("bands").alias("band", "bucket")).join(crowded.select("band", "bucket"), ["band", "bucket"], "left_semi").join(pivots, ["band", "bucket"])
    near = members.select("node", "vec", "pivots").mapInArrow(_near_pivots(math.acos(threshold) / 2), "node long, core long")
    return materialize(near.groupBy("node").agg(F.min("core").alias("core")), "rabitq-cores")


def _tiles(dealt: DataFrame, crowded: DataFrame, crowd: int) -> DataFrame:
    """Rows of every bucket with the tile (x, y) and the side in it; x is -1 - (home block) where a home block meets guests."""
    size = dealt.join(crowded, ["band", "bucket"]).groupBy("band", "bucket", "core").agg(F.count("*").alias("n"))
    home = size.groupBy("band", "bucket").agg(F.max(F.when(F.col("core") >= 0, F.struct("n", "core"))).alias("h"), F.sum("n").alias("n"))
    blocks = home.select("band", "bucket", F.coalesce("h.core", F.lit(-2)).alias("home"), F.ceil(F.coalesce("h.n", F.lit(0)) / crowd).cast("int").alias("homes"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.coalesce("h.n", F.lit(0))) / crowd)).cast("int").alias("guests"))
    blocks = materialize(blocks, "rabitq-blocks")
    both = dealt.join(blocks, ["band", "bucket"], "left")
    place = lambda n: F.pmod(F.xxhash64("node", F.lit("tile")), F.col(n)).cast("int")
    quiet = both.filter("home IS NULL").withColumns({"x": F.lit(0), "y": F.lit(0), "side": F.lit(0)})
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at_home = both.filter("core = home").select("*", F.explode(upto("guests")).alias("y")).withColumns({"x": -1 - place("homes"), "side": F.lit(0)})
    guest = both.filter("core <> home").withColumn("g", place("guests"))
    visits = guest.filter("homes > 0").select("*", F.explode(upto("homes")).alias("h")).withColumns({"x": -1 - F.col("h"), "y": F.col("g"), "side": F.lit(1)}).drop("g", "h")
    among = guest.select("*", F.explode(upto("guests")).alias("o")).withColumns({"x": F.least("g", "o"), "y": F.greatest("g", "o"), "side": F.when(F.col("g") <= F.col("o"), 0).otherwise(1)}).drop("g", "o")
    return quiet.unionByName(at_home).unionByName(visits).unionByName(among)
