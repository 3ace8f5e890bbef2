"""BagMinHash near-duplicate detection on multisets of five-word shingles.

1. One pass over the texts gives each document a digest (its node), a BagMinHash signature and its band keys.
   Weights (shingle counts) are discretised at the integers and covered by dyadic weight intervals
   [0,1), [1,2), [2,4), ...: every (shingle, interval) is a Poisson process in time whose points carry a
   signature component and a place in the interval; a point counts if its place lies below the weight.
   A component's value is its first point, so two documents agree in it with a probability that equals
   their weighted Jaccard likeness. Points are drawn in time order, for a batch of documents at once,
   until no later point can change a signature.
2. Exact copies are one node before anything is paired.
3. Texts that share a band key meet in a bucket; buckets stream through sorted partitions. A bucket's
   medoid (the member nearest to its component-wise mode) is compared with all members, then the medoid
   of those not near it, and so on: members are linked to medoids, never to one another in all pairs.
   Buckets over ``split_over`` members are dealt to parts, whose first medoids meet in a second bucket.
4. These links are verified by exact multiset overlap, and connected components of them are
   found by alternating large-star and small-star steps, written to the shared folder each round.
5. A bucket that these components leave in one class is settled. In the others every member outside the
   largest class meets all members of other classes, the likeliest first; members that have a likely partner
   bring their shingles along and are verified there and then, until the bucket's classes are joined or all
   their likely pairs are refuted. So a likeness to a medoid that is only estimated closes nobody, no pair of a
   bucket is left out, and what is written is links that join classes, not pairs.

Only pairs that share no band, or whose estimated likeness is under the floor (3.5 standard errors below the
threshold), are not looked at.

Defined cases: null texts are empty; equal texts (empty ones too) share a class; a text without words has
no near copies; rows that share an id but not their text are documents of their own; a row without doc_id is its
own class with a null id; an empty table gives no rows; the class id is the smallest doc_id of the class; other
columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import claim, drop_path, materialize, mix64, shingle_hashes, shuffle_width, text_slices

BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_FAR = np.uint64(0xC2B2AE3D27D4EB4F)


def bag(text: str | None, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (sorted) and their counts."""
    return np.unique(shingle_hashes(text, width), return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact weighted Jaccard likeness of two bags; 0 where both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - shared
    return shared / total if total else 0.0


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], m: int = SIZE) -> np.ndarray:
    """uint32 signature rows; all zero for an empty bag."""
    docs = len(bags)
    sizes = np.array([len(b[0]) for b in bags])
    doc = np.repeat(np.arange(docs), sizes)
    element = np.concatenate([b[0] for b in bags]) if docs else np.empty(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]) if docs else np.empty(0, np.int64)
    owner, seed, low, span, cap = [doc], [mix64(element)], [np.zeros(len(doc), np.int64)], [np.ones(len(doc), np.int64)], [weight]
    level = 0
    while True:
        heavy = weight > 1 << level
        if not heavy.any():
            break
        owner.append(doc[heavy])
        seed.append(mix64(element[heavy] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
        low.append(np.full(int(heavy.sum()), 1 << level, np.int64))
        span.append(low[-1])
        cap.append(weight[heavy])
        level += 1
    owner, seed, low, span, cap = map(np.concatenate, (owner, seed, low, span, cap))
    first = np.full(docs * m, np.inf)
    time = np.zeros(len(owner))
    rate = span * float(m)
    step = 0
    with np.errstate(divide="ignore"):
        while len(owner):
            step = step + int(_FAR) & (1 << 64) - 1
            r = mix64(seed + np.uint64(step))
            time = time - np.log((r >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / rate
            r = mix64(r ^ _GOLD)
            part = ((r & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)
            place = low + (((r >> np.uint64(32)) * span.astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            ok = place < cap
            np.minimum.at(first, (owner * m + part.astype(np.int64))[ok], time[ok])
            live = time < first.reshape(docs, m).max(axis=1)[owner]
            if not live.all():
                owner, seed, low, span, cap, time, rate = (x[live] for x in (owner, seed, low, span, cap, time, rate))
    out = (mix64(first.view(np.uint64)) >> np.uint64(32)).astype(np.uint32).reshape(docs, m)
    out[sizes == 0] = 0
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 key of each band of each signature."""
    part = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * _FAR + np.zeros((len(sig), 1), dtype=np.uint64)
    for r in range(ROWS):
        acc = mix64(acc ^ part[:, :, r])
    return acc.view(np.int64)


def node_of(text: Column) -> Column:
    """16 bytes of the text's SHA-256; a null text counts as empty."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("bagminhash")
    for batch in text_slices(batches, most=1_000_000):
        bags = [bag(t) for t in batch["text"].to_pylist()]
        sig = signatures(bags)
        keys = band_keys(sig)
        full = np.array([len(b[0]) > 0 for b in bags])
        ends = np.concatenate(([0], np.cumsum(np.where(full, BANDS, 0)))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                batch["node"],
                pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[full].ravel())),
                pa.array([row.tobytes() for row in (sig & 255).astype(np.uint8)], pa.binary()),
                pa.array([len(b[0]) for b in bags], pa.int64()),
            ],
            names=["doc_id", "node", "bands", "sig", "size"],
        )


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated likeness from one byte of each component; chance agreements are taken out."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def bucket_links(ids: list[bytes], sig: np.ndarray, floor: float, near: float) -> tuple[list[tuple[bytes, bytes]], list[int]]:
    """Links of a bucket's members to its medoids, and the indexes of the medoids."""
    links, medoids = [], []
    open_ = np.ones(len(ids), dtype=bool)
    column = np.arange(sig.shape[1])[None, :] * 256
    while open_.any():
        rest = np.flatnonzero(open_)
        mode = np.bincount((sig[rest] + column).ravel(), minlength=256 * sig.shape[1]).reshape(-1, 256).argmax(axis=1)
        pivot = int(rest[np.argmax((sig[rest] == mode).sum(axis=1))])
        est = likeness(sig, sig[pivot])
        open_[pivot] = False
        like = est >= floor
        like[pivot] = False
        links += [(ids[pivot], ids[j]) for j in np.flatnonzero(like & open_).tolist()]
        open_ &= est < near
        medoids.append(pivot)
    return links, medoids


#: Medoids of a part that meet those of the other parts of their bucket.
HEADS = 8


def _bucket_stream(floor: float, near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        at, ids, sigs, out = None, [], [], []

        def close() -> None:
            if ids and (len(ids) > 1 or at[1] >= 0):
                links, medoids = bucket_links(ids, np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(ids), -1), floor, near)
                out.extend((min(p), max(p), None, None) for p in links)
                if at[1] >= 0:
                    out.extend((ids[m], None, at[0], sigs[m]) for m in medoids[:HEADS])

        def links() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("a", "b", "key", "sig"), cols, (pa.binary(), pa.binary(), pa.int64(), pa.binary()))})

        for batch in batches:
            for key, part, node, sig in zip(*(batch[c].to_pylist() for c in ("key", "part", "node", "sig"))):
                if (key, part) != at:
                    close()
                    at, ids, sigs = (key, part), [], []
                    if len(out) > 20_000:
                        yield links()
                if not ids or ids[-1] != node:
                    ids.append(node)
                    sigs.append(sig)
        close()
        if out:
            yield links()

    return run


def bucket_rows(signed: DataFrame) -> DataFrame:
    """(key, count, node, sig, size) of the members of all buckets of two or more; ``signed`` has (node, bands, sig, size)."""
    keyed = signed.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").count().filter("count > 1")
    return keyed.join(shared, "key").join(signed.select("node", "sig", "size"), "node").select("key", "count", "node", "sig", "size")


def candidate_links(met: DataFrame, floor: float, near: float, split_over: int) -> DataFrame:
    """Distinct pairs a < b of a member and a medoid of the same bucket; ``met`` is from ``bucket_rows``."""
    width = shuffle_width(met.sparkSession)
    part = F.when(F.col("count") > split_over, F.pmod(F.xxhash64("node"), F.ceil(2 * F.col("count") / split_over))).otherwise(-1)
    rows = met.select("key", part.cast("long").alias("part"), "node", "sig")
    schema = "a binary, b binary, key long, sig binary"
    stream = _bucket_stream(floor, near)
    first = materialize(rows.repartition(width, "key", "part").sortWithinPartitions("key", "part", "node").mapInArrow(stream, schema), "bag-links")
    heads = first.filter("b IS NULL").select("key", F.lit(-1).cast("long").alias("part"), F.col("a").alias("node"), "sig")
    second = heads.repartition(width, "key").sortWithinPartitions("key", "part", "node").mapInArrow(stream, schema)
    return first.unionByName(second).filter("b IS NOT NULL AND a <> b").select("a", "b").distinct()


def dump_bag(b: tuple[np.ndarray, np.ndarray]) -> bytes:
    return b[0].astype("<u8").tobytes() + b[1].astype("<u4").tobytes()


def load_bag(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, "<u8", n), np.frombuffer(raw, "<u4", n, 8 * n)


#: Nodes up to which those that need their shingles are sent to every executor (16 bytes each).
BROADCAST_NODES = 500_000


def bags_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, bag) of the given nodes; ``docs`` has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        for batch in text_slices(batches, most=2_000_000):
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array([dump_bag(bag(t)) for t in batch["text"].to_pylist()], pa.binary())], names=["node", "bag"])

    wanted = materialize(nodes.distinct(), "bag-wanted")
    hint = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted.hint("merge")
    return materialize(docs.join(hint, "node", "left_semi").mapInArrow(run, "node binary, bag binary"), "bag-bags")


def verified_links(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """Of the pairs (a, b), those whose bags overlap by ``threshold`` or more."""
    one = bags.groupBy("node").agg(F.first("bag").alias("bag"))  # copies of a text are one node
    left = pairs.join(one.withColumnsRenamed({"node": "a", "bag": "bag_a"}), "a")
    both = left.join(one.withColumnsRenamed({"node": "b", "bag": "bag_b"}), "b").select("a", "b", "bag_a", "bag_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        for batch in batches:
            good = pa.array([overlap(load_bag(x.as_py()), load_bag(y.as_py())) >= threshold for x, y in zip(batch["bag_a"], batch["bag_b"])], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    return both.mapInArrow(run, "a binary, b binary")


# ---- buckets that still hold several classes ---------------------------------------------------


def likely_pairs(sig: np.ndarray, root: list[bytes], minor: np.ndarray, guest: np.ndarray, floor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, members j of other classes that may be near it, their likeness) for each ``minor`` i.

    A ``guest`` is a minor that visits: it meets those who are at home here.
    """
    _, code = np.unique(np.array(root, dtype=object), return_inverse=True)
    home = np.flatnonzero(~guest)
    for i in np.flatnonzero(minor).tolist():
        others = home[code[home] != code[i]]
        est = likeness(sig[others], sig[i])
        near = est >= floor
        if near.any():
            yield i, others[near], est[near]


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple[int, int], list[list]]]:
    """Rows of one (key, part) at a time, each node once at home and once as a guest, from batches in that order."""
    at, rows = None, []
    for batch in batches:
        for key, part, *row in zip(*(batch[c].to_pylist() for c in ("key", "part", *columns))):
            if (key, part) != at:
                if rows:
                    yield at, rows
                at, rows = (key, part), []
            if not rows or (rows[-1][0], rows[-1][4]) != (row[0], row[4]):
                rows.append(row)
    if rows:
        yield at, rows


_MEMBER = ["node", "sig", "root", "minor", "guest"]
_MEMBER_SCHEMA = "key long, part long, node binary, sig binary, root binary, minor boolean, guest boolean"


def _arrays(rows: list[list]) -> tuple:
    node, sig, root, minor, guest, *more = zip(*rows)
    return node, np.frombuffer(b"".join(sig), dtype=np.uint8).reshape(len(rows), -1), list(root), np.array(minor), np.array(guest), *more


def _involved(floor: float):
    """Members of a bucket that have a likely partner in another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_())
        for (key, part), rows in _groups(batches, _MEMBER):
            _, sig, root, minor, guest = _arrays(rows)
            hit = np.zeros(len(rows), dtype=bool)
            for i, others, _ in likely_pairs(sig, root, minor, guest, floor):
                hit[i] = True
                hit[others] = True
            if hit.any():
                kept = [(key, part, *rows[i]) for i in np.flatnonzero(hit).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), kinds)], names=["key", "part", *_MEMBER])

    return run


def joining_links(node: tuple, sig: np.ndarray, root: list[bytes], minor: np.ndarray, guest: np.ndarray, bags: list, floor: float, threshold: float) -> list[tuple[bytes, bytes]]:
    """Verified links that join the classes of one bucket; no link between two classes stays unseen."""
    parent = {r: r for r in root}

    def find(x: bytes) -> bytes:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links, weights = [], [int(b[1].sum()) for b in bags]
    for i, others, est in likely_pairs(sig, root, minor, guest, floor):
        for j in others[np.argsort(-est, kind="stable")].tolist():
            x, y = find(root[i]), find(root[j])
            if x == y or min(weights[i], weights[j]) < threshold * max(weights[i], weights[j]):
                continue
            if overlap(bags[i], bags[j]) >= threshold:
                parent[max(x, y)] = min(x, y)
                links.append((min(node[i], node[j]), max(node[i], node[j])))
    return links


def _joining(floor: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bagminhash")
        for _, rows in _groups(batches, [*_MEMBER, "bag"]):
            node, sig, root, minor, guest, raw = _arrays(rows)
            links = joining_links(node, sig, root, minor, guest, [load_bag(r) for r in raw], floor, threshold)
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


#: Shingles that the members of one part of a bucket may hold together (12 bytes each).
PART_SHINGLES = 3_000_000


def remaining_links(met: DataFrame, roots: DataFrame, bags: DataFrame, floor: float, threshold: float, split_over: int) -> DataFrame:
    """Verified links (a, b) that join classes, the ``roots`` of the links so far, that share a bucket.

    Large buckets are dealt to tiles, a block of all members at home and a block of visiting minors in each; every minor visits all home
    blocks, so each pair meets, and a tile's rows and shingles are bounded whatever the bucket holds.
    """
    width = shuffle_width(met.sparkSession)
    classed = met.join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("key", "node", "sig", "size", F.coalesce("root", "node").alias("root"))
    sizes = classed.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("classes"), F.sum("n").alias("total"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "root", "shingles")).alias("most")).filter("classes > 1")
    blocks = lambda n, shingles: F.greatest(F.lit(1), F.ceil(2 * n / split_over), F.ceil(2 * shingles / PART_SHINGLES)).cast("long")
    crowded = (F.col("total") > split_over) | (F.col("shingles") > PART_SHINGLES)
    mixed = mixed.select("key", F.col("most.root").alias("main"), F.when(crowded, blocks(F.col("total"), F.col("shingles"))).otherwise(0).alias("homes"), blocks(F.col("total") - F.col("most.n"), F.col("shingles") - F.col("most.shingles")).alias("visits"))
    rows = classed.join(mixed, "key").withColumn("minor", F.col("root") != F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.lit(1).cast("long"), F.col(n)))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    seat = lambda parts, minor, guest: F.transform(parts, lambda p: F.struct(p.alias("part"), minor.alias("minor"), guest.alias("guest")))
    no, yes = F.lit(False), F.lit(True)
    at_home = seat(F.transform(upto("visits"), lambda v: place("homes") * F.col("visits") + v), no, no)
    visiting = seat(F.transform(upto("homes"), lambda h: h * F.col("visits") + place("visits")), yes, yes)
    seats = F.when(F.col("homes") == 0, seat(F.array(F.lit(0).cast("long")), F.col("minor"), no)).when(F.col("minor"), F.concat(at_home, visiting)).otherwise(at_home)
    seated = rows.select("key", "node", "sig", "root", F.explode(seats).alias("s")).select("key", "s.part", "node", "sig", "root", "s.minor", "s.guest")
    dealt = seated.repartition(width, "key", "part").sortWithinPartitions("key", "part", "node", "guest")
    involved = materialize(dealt.mapInArrow(_involved(floor), _MEMBER_SCHEMA), "bag-involved")
    one = bags.groupBy("node").agg(F.first("bag").alias("bag"))
    carried = involved.join(one, "node").select("key", "part", *_MEMBER, "bag")
    return carried.repartition(width, "key", "part").sortWithinPartitions("key", "part", "node", "guest").mapInArrow(_joining(floor, threshold), "a binary, b binary").distinct()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node has one root and no root has a root."""
    ends = edges.select(F.col("v").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("u").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node with a link but the roots; root is the component's smallest node."""
    edges = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u <> v").distinct(), "cc")
    for _ in range(rounds):
        if _is_star(edges):
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).filter("v <> u").distinct()
        down = materialize(large, "cc-large")
        low2 = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low2, "u").select(F.col("v"), F.col("m").alias("u")).filter("v <> u").unionByName(low2.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        new = materialize(small, "cc")
        for old in (edges, down):
            drop_path(edges.sparkSession, old.scratch_path)
        edges = new
    raise RuntimeError("components did not settle")


def linked_roots(signed: DataFrame, docs: DataFrame, threshold: float, floor: float, split_over: int) -> DataFrame:
    """(node, root) of the nodes that verified links join; ``signed`` has (node, bands, sig, size), ``docs`` (node, text)."""
    met = materialize(bucket_rows(signed), "bag-met")
    bags = bags_of(met.select("node"), docs)
    pairs = candidate_links(met, floor, threshold, split_over)
    roots = components(verified_links(pairs, bags, threshold))
    more = materialize(remaining_links(met, roots, bags, floor, threshold, split_over), "bag-joining")
    if more.isEmpty():
        return roots
    return components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def likeness_floor(threshold: float) -> float:
    return threshold - 3.5 * (threshold * (1 - threshold) / SIZE) ** 0.5


def classes_of(docs: DataFrame, threshold: float, floor: float | None, split_over: int) -> DataFrame:
    """(doc_id, node, root, class_id, copy_of) of every row with an id; ``docs`` has (doc_id, text)."""
    known = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", node_of(F.col("text")).alias("node"))
    rows = known.mapInArrow(_signed_rows, "doc_id long, node binary, bands array<long>, sig binary, size long")
    signed = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "bag-signed")
    copies = signed.groupBy("node").agg(F.min("doc_id").alias("copy_of"), F.min("row").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = signed.join(copies, "node", "left").withColumns({"copy_of": F.coalesce("copy_of", "doc_id"), "first": F.coalesce("first", "row") == F.col("row")})
    members = materialize(joined.drop("row"), "bag-members")
    first = members.filter("first").select("node", "bands", "sig", "size")
    roots = linked_roots(first, known, threshold, likeness_floor(threshold) if floor is None else floor, split_over)
    rooted = members.select("doc_id", "node", "copy_of").join(roots.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").select("doc_id", "node", "copy_of", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rooted.join(named, "root", "left").select("doc_id", "node", "root", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, floor: float | None = None, split_over: int = 4096) -> DataFrame:
    """(doc_id, class_id, copy_of) of every document.

    ``copy_of`` is the smallest id with exactly the same text. ``floor`` is the estimated likeness from
    which a candidate is verified, by default the threshold less 3.5 standard errors.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = classes_of(slim, threshold, floor, split_over).select("doc_id", "class_id", "copy_of")
    unknown = slim.filter("doc_id IS NULL").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("long").alias("copy_of"))
    return out.unionByName(unknown)


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One document of each class, that of the smallest id (of texts that share it, one), with all its columns; all rows without an id."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    heads = classes_of(slim, threshold, None, 4096).filter("doc_id = class_id").groupBy("root").agg(F.min("node").alias("__keep_node"), F.first("doc_id").alias("__keep_id"))
    named = docs.withColumns({"__id": F.col("doc_id").cast("long"), "__node": node_of(F.col("text"))})
    chosen = named.join(heads, (F.col("__id") == F.col("__keep_id")) & (F.col("__node") == F.col("__keep_node")), "left_semi").dropDuplicates(["__id", "__node"])
    return chosen.select(docs.columns).unionByName(docs.filter("doc_id IS NULL"))
