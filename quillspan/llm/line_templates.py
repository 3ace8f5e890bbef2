"""Line deduplication by a log-template tree.

A line's path in the tree has a fixed depth: its token count, then its leading tokens, in which fields
that hold a digit, an ``@`` or a URL are wildcards already. A leaf whose lines stand in enough documents
generalises the rest: a token that stands at its place in few of the leaf's documents (fewer than
``min_docs``, or under ``common_share`` of them) is a variable field. All counts are sums over the whole corpus, so the templates do not depend on the order of
lines, and no leaf has to fit a task. A line keeps at least ``constant`` of its tokens as
constants, or it is a template by itself.

A template is boilerplate, and its lines are dropped everywhere, if it stands in enough documents that are independent of
each other: ``min_docs`` of them for lines of up to ten tokens, fewer for longer lines, two from ``passage`` tokens on.
Copies of a document, with their edits, count as one document. To tell them, each document has four anchors: min-hashes of
the three-word runs of those of its lines that stand in no more documents than its median line. So boilerplate is no anchor, and edited
lines of copies still agree in most runs. The documents of a template are contracted on one anchor after the other; what is
left is the number of independent ones. Where a line stands does not count, so whole blocks go like single lines.

Defined cases: a null text stays null; blank lines stay; lines that recur
inside one document count once; a document may end up empty but is never dropped; equal texts, with or without ids, give equal texts;
``n_chars`` is set to the new length where the column exists; other columns stay as they are, but columns ``n_lines`` and
``n_dropped`` of the input give way to the operator's own where these are asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType

from .common import claim, fresh, materialize, mix64, text_slices, word_hashes

WILD = "<*>"
_VARIABLE = re.compile(r"\d|@|://")


def _hash(s: str) -> int:
    h = xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


#: Least share of constant tokens in a template.
CONSTANT = 0.6


def masked(line: str) -> list[str]:
    """The line's tokens, with fields that surely vary as wildcards, unless too few constants would remain."""
    tokens = line.split()
    if not _VARIABLE.search(line):
        return tokens
    wild = [WILD if _VARIABLE.search(t) else t for t in tokens]
    return tokens if wild.count(WILD) > (1 - CONSTANT) * len(wild) else wild


SIZE_BITS = 63
#: Leaves sent to tasks at most, 4 MB; more are joined.
MOST_SENT = 500_000
ANCHORS = 4
_SEEDS = mix64(np.arange(1, ANCHORS + 1, dtype=np.uint64)) | np.uint64(1)
_MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def parse(text: str, depth: int) -> Iterator[tuple[int, int, str]]:
    """(leaf, line key, masked line) of every line; a leaf's low six bits hold the number of tokens, 63 at most."""
    for tokens in map(masked, text.split("\n")):
        if tokens:
            line = " ".join(tokens)
            yield _hash(f"{len(tokens)} {' '.join(tokens[:depth])}") & ~SIZE_BITS | min(len(tokens), SIZE_BITS), _hash(line), line


def needed(leaf: Column, min_docs: int, passage: int) -> Column:
    """Independent documents from which a line of the leaf's size is boilerplate: ``min_docs`` up to 10 tokens, falling to 2 at ``passage``."""
    size = leaf.bitwiseAND(F.lit(SIZE_BITS))
    falling = F.ceil(min_docs - (size - 10) * (min_docs - 2) / F.lit(float(max(1, passage - 10))))
    return F.greatest(F.lit(min(2, min_docs)), F.least(F.lit(min_docs), falling))


def line_minima(texts: list[str], sizes: list[int]) -> np.ndarray:
    """For each line of so many tokens (of all texts, in order), the least hash of the three-word runs that start in it, under four hashes."""
    words = np.concatenate((word_hashes("\n".join(texts)), np.zeros(2, dtype=np.uint64)))
    runs = mix64((words[:-2] * _MULTIPLIER + words[1:-1]) * _MULTIPLIER + words[2:])
    starts = np.concatenate(([0], np.cumsum(sizes[:-1]))).astype(np.int64)
    return np.stack([np.minimum.reduceat(runs * seed, starts) for seed in _SEEDS], axis=1).view(np.int64)


def anchors(minima: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """A document's anchors from its lines' minima and in how many documents each line stands."""
    return minima[docs <= np.sort(docs)[(len(docs) - 1) // 2]].view(np.uint64).min(axis=0).view(np.int64)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("lines")
    for batch in batches:
        rows = np.empty((len(batch), ANCHORS), dtype=np.int64)
        for i, (keys, minima, known, counts) in enumerate(zip(*(batch[c].to_pylist() for c in ("keys", "minima", "known", "counts")), strict=True)):
            at = dict(zip(known, counts, strict=True))
            rows[i] = anchors(np.frombuffer(minima, dtype=np.int64).reshape(-1, ANCHORS), np.array([at.get(k, 1) for k in keys]))
        yield pa.RecordBatch.from_arrays([batch["digest"], *(pa.array(rows[:, i]) for i in range(ANCHORS))], names=["digest", *(f"a{i}" for i in range(ANCHORS))])


def independent(stands: DataFrame) -> DataFrame:
    """(template, docs, independent) of (template, a0 ... a3), a row for each document: contracted on one anchor after the other."""
    names = [f"a{i}" for i in range(ANCHORS)]
    left = stands.groupBy("template", *names).agg(F.count("*").alias("n"))
    for i in range(ANCHORS - 1):
        rest = F.struct(*names[i + 1 :])
        left = left.groupBy("template", names[i]).agg(F.max_by(rest, F.struct("n", *names[i + 1 :])).alias("r"), F.sum("n").alias("n")).select("template", "r.*", "n")
    return left.groupBy("template", names[-1]).agg(F.sum("n").alias("n")).groupBy("template").agg(F.sum("n").alias("docs"), F.count("*").alias("independent"))


def _generalised(slim: DataFrame, leaves: DataFrame, distinct: DataFrame, depth: int, min_docs: int, constant: float, common_share: float) -> DataFrame:
    """(leaf, key, template) of the lines of ``leaves`` that keep enough constants when rare tokens become fields."""
    # few leaves (8 bytes each) go to the tasks, which then spell their lines only; more than that are joined
    few = [r.leaf for r in leaves.limit(MOST_SENT + 1).collect()]
    known = frozenset(few) if len(few) <= MOST_SENT else None

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for batch in text_slices(batches, most=2_000_000):
            out: dict[int, tuple] = {}
            for text in batch["text"].to_pylist():
                out |= {k: (leaf, k, line) for leaf, k, line in parse(text, depth) if known is None or leaf in known}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out.values()), (pa.int64(), pa.int64(), pa.string()))], names=["leaf", "key", "line"])

    spelled = slim.select("text").mapInArrow(spell, "leaf long, key long, line string")
    if known is None:
        spelled = spelled.join(leaves, "leaf", "left_semi")
    spelled = materialize(spelled.groupBy("leaf", "key").agg(F.first("line").alias("line")).join(distinct, ["leaf", "key"]), "line-spelled")
    fields = spelled.select("leaf", "key", "n", F.posexplode(F.split("line", " ")).alias("place", "token"))
    # a share of the leaf, or a field's frequent values would become constants as the corpus grows
    sizes = spelled.groupBy("leaf").agg(F.sum("n").alias("size"))
    common = fields.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs).join(sizes, "leaf")
    common = common.filter(F.col("n") >= common_share * F.col("size")).select("leaf", "place", "token", F.lit(True).alias("common"))
    common = materialize(common, "line-fields")
    shown = F.when(F.col("common") & (F.col("token") != WILD), F.col("token")).otherwise(WILD)
    spelled_out = fields.join(common, ["leaf", "place", "token"], "left").select("leaf", "key", "place", F.coalesce(shown, F.lit(WILD)).alias("shown"))
    general = spelled_out.groupBy("leaf", "key").agg(F.array_sort(F.collect_list(F.struct("place", "shown"))).alias("f"), F.avg((F.col("shown") != WILD).cast("double")).alias("share"))
    return general.filter(F.col("share") >= constant).select("leaf", "key", F.xxhash64("leaf", F.array_join("f.shown", " ")).alias("template"))


def boilerplate(docs: DataFrame, depth: int = 3, min_docs: int = 10, passage: int = 50, constant: float = CONSTANT, common_share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(line keys of each distinct text, keys of the lines whose template recurs): (digest, keys), (key, template, docs).

    ``digest`` is Spark's xxhash64 of the text.
    """
    slim = docs.filter("text IS NOT NULL").select(F.xxhash64("text").alias("digest"), "text")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for batch in text_slices(batches, most=1_000_000):
            leaves, keys, firsts, sizes = [], [], [], []
            texts = batch["text"].to_pylist()
            for text in texts:
                rows = {}
                for leaf, k, line in parse(text, depth):
                    rows.setdefault(k, (leaf, len(sizes)))
                    sizes.append(line.count(" ") + 1)
                keys.append(list(rows))
                leaves.append([leaf for leaf, _ in rows.values()])
                firsts.append([i for _, i in rows.values()])
            minima = line_minima(texts, sizes) if sizes else np.empty((0, ANCHORS), dtype=np.int64)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["digest"], pa.array(leaves, kind), pa.array(keys, kind), pa.array([minima[f].tobytes() if f else b"" for f in firsts], pa.binary())], names=["digest", "leaves", "keys", "minima"])

    each = slim.mapInArrow(index, "digest long, leaves array<long>, keys array<long>, minima binary")
    lines = materialize(each.groupBy("digest").agg(*[F.first(c).alias(c) for c in ("leaves", "keys", "minima")]), "line-index")
    need = needed(F.col("leaf"), min_docs, passage)
    pairs = lines.select("digest", F.explode(F.arrays_zip("leaves", "keys")).alias("x")).select("digest", F.col("x.leaves").alias("leaf"), F.col("x.keys").alias("key"))
    leaves = pairs.groupBy("leaf").agg(F.count("*").alias("docs"), F.min("key").alias("low"), F.max("key").alias("high")).filter(F.col("docs") >= need)
    leaves = materialize(leaves.select("leaf", ((F.col("docs") >= min_docs) & (F.col("low") < F.col("high"))).alias("several")), "line-leaves")
    # a document's line once, however many copies the document has
    found = materialize(pairs.join(leaves.select("leaf"), "leaf", "left_semi"), "line-found")
    distinct = materialize(found.groupBy("leaf", "key").agg(F.count("*").alias("n")), "line-distinct")
    general = _generalised(slim, leaves.filter("several").select("leaf"), distinct, depth, min_docs, constant, common_share)
    own = materialize(distinct.join(general, ["leaf", "key"], "left").withColumn("template", F.coalesce("template", "key")), "line-templates")
    stands = materialize(found.join(own, ["leaf", "key"]).select("template", "digest", "key", "n"), "line-stands")
    held = stands.groupBy("digest").agg(F.collect_list("key").alias("known"), F.collect_list("n").alias("counts"))
    anchored = lines.select("digest", "keys", "minima").join(held, "digest").mapInArrow(_anchored, "digest long, " + ", ".join(f"a{i} long" for i in range(ANCHORS)))
    placed = stands.select("template", "digest").distinct().join(materialize(anchored, "line-anchors"), "digest").drop("digest")
    wanted = own.groupBy("template").agg(F.min("leaf").alias("leaf")).withColumn("need", need)
    recurs = independent(placed).join(wanted, "template").filter(F.col("independent") >= F.col("need")).select("template", "docs")
    dropped = materialize(own.join(recurs, "template").select("key", "template", "docs"), "line-dropped")
    return lines.select("digest", "keys"), dropped


def drop_boilerplate(docs: DataFrame, counts: bool = True, **options: float) -> DataFrame:
    """The documents without the lines of recurring templates, with (n_lines, n_dropped) appended if ``counts``."""
    lines, dropped = boilerplate(docs, **options)
    hits = lines.select("digest", F.explode("keys").alias("key")).join(dropped.select("key").distinct(), "key").groupBy("digest").agg(F.collect_set("key").alias("hit"))
    if counts:
        docs = docs.select([c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")])
    names = docs.columns
    hit, hit_text = fresh("hit", names), fresh("hit_text", names)
    hits = materialize(hits.withColumnsRenamed({"digest": hit_text, "hit": hit}), "line-hits")
    # a sort-merge join at every size: the hits grow with the corpus
    joined = docs.join(hits.hint("merge"), F.when(F.col("text").isNotNull(), F.xxhash64("text")) == F.col(hit_text), "left").select(*names, hit)
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("lines")
        for batch in text_slices(batches, most=2_000_000):
            texts, total, gone = [], [], []
            for text, found in zip(batch["text"].to_pylist(), batch[hit].to_pylist()):
                parts = [] if text is None else text.split("\n")
                kept = parts
                if found:
                    bad = set(found)
                    kept = [p for p in parts if not (m := masked(p)) or _hash(" ".join(m)) not in bad]
                texts.append(None if text is None else "\n".join(kept))
                total.append(len(parts))
                gone.append(len(parts) - len(kept))
            cols = []
            for name in names:
                if name == "text":
                    cols.append(pa.array(texts, pa.string()))
                elif name == "n_chars":
                    cols.append(pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch[name].type))
                else:
                    cols.append(batch[name])
            more = {"n_lines": total, "n_dropped": gone} if counts else {}
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(v, pa.int64()) for v in more.values())], names=[*names, *more])

    extra = [StructField("n_lines", LongType()), StructField("n_dropped", LongType())] if counts else []
    return joined.mapInArrow(strip, StructType([*docs.schema.fields, *extra]))
