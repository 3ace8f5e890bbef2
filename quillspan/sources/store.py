"""Persisted indexes and vector caches as Parquet tables with a manifest that is checked before reuse.

An index is a folder of immutable snapshots and numbered pointers to them. A writer writes a whole snapshot and then
creates the next pointer; of two writers one creates it, the other fails. A reader that opened a snapshot keeps it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.retrieval import Index, block_index, index_of, single_blocks

FORMAT = 3
RANGES = 16
LOWEST = 1000


class IndexMismatch(ValueError):
    """A stored index does not fit what is asked for; ``reason`` says why, ``ranges`` which parts would have to be built."""

    def __init__(self, reason: str, ranges: list[int] | None = None):
        super().__init__(reason)
        self.reason, self.ranges = reason, ranges


@dataclass(frozen=True)
class Identity:
    """What an index is of; all of it must agree before passages are compared."""

    engine: str = "bm25"
    dataset: str = ""
    split: str = ""
    fields: tuple[str, ...] = ("text",)
    tokenizer: str = "words-v1"


_MANIFEST = "format int, engine string, dataset string, split string, fields string, tokenizer string, passages long, ids string, lowest string, built array<int>, ranges array<struct<range:int,checksum:string,path:string>>"


def _range(pos: Column) -> Column:
    return F.pmod(F.xxhash64(pos), F.lit(RANGES)).cast("int")


def range_checksums(passages: DataFrame, fields: tuple[str, ...] = ("text",)) -> list[Row]:
    """(range, n, ids, checksum) of each of the fixed hash ranges: order-free digests of ids and of ids with texts."""
    digest = lambda h: F.concat_ws("-", F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h))
    return passages.groupBy(_range(F.col("pos")).alias("range")).agg(F.count("*").alias("n"), digest(F.xxhash64("pos")).alias("ids"), digest(F.xxhash64("pos", *fields)).alias("checksum")).orderBy("range").collect()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _pointers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed snapshots; a pointer that is still empty is not committed yet."""
    p, fs = _fs(spark, f"{path}/pointers")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(p) if f.getLen() > 0) if fs.exists(p) else []


def _read_pointer(spark: SparkSession, path: str, n: int) -> str:
    return spark.read.text(f"{path}/pointers/{n:012d}").first().value


def current_snapshot(spark: SparkSession, path: str) -> str | None:
    """Folder of the last committed snapshot."""
    n = _pointers(spark, path)
    return _read_pointer(spark, path, n[-1]) if n else None


def _commit(spark: SparkSession, path: str, after: int, snapshot: str) -> None:
    """Make a whole snapshot the current one, if no other writer has committed since ``after``: the next pointer is created, never replaced."""
    p, fs = _fs(spark, f"{path}/pointers/{after + 1:012d}")
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise IndexMismatch("concurrent_commit") from e
    out.write(bytearray(snapshot.encode()))
    out.close()


def save_index(passages: DataFrame, path: str, build: Callable[[DataFrame], Index], identity: Identity = Identity(), sums: list[Row] | None = None, changed: list[int] | None = None) -> str:
    """Write a snapshot and commit it; returns its folder.

    Only ``changed`` hash ranges (all by default) are indexed, the others keep the files of the snapshot before. Postings are written in blocks by range
    in order of the term, so a query's terms prune row groups. Until the pointer stands, readers see the old snapshot.
    """
    spark = passages.sparkSession
    known = _pointers(spark, path)
    before = spark.read.schema(_MANIFEST).json(f"{_read_pointer(spark, path, known[-1])}/manifest").first() if known and changed is not None else None
    sums = sums or range_checksums(passages, identity.fields)
    wanted = {r.range for r in sums}
    todo = sorted(wanted & set(changed)) if before else sorted(wanted)
    snapshot = f"{path}/snapshots/{uuid.uuid4().hex}"
    if todo:
        # texts are dealt out before their terms are counted: they are smaller than their postings, and all of a passage's postings lie in one file, so searches add up its score where they read it
        dealt = passages.withColumn("range", _range(F.col("pos"))).filter(F.col("range").isin(todo)).repartition("range", F.pmod(F.xxhash64("pos", F.lit(1)), F.lit(8))).sortWithinPartitions("range", "pos")
        made = build(dealt)
        blocks = made.blocks if made.blocks is not None else single_blocks(made.postings, _range(F.col("pos")))
        blocks.sortWithinPartitions("range", "field", "term").write.partitionBy("range").parquet(f"{snapshot}/postings")
    old = {r["range"]: r.path for r in before.ranges} if before else {}
    written = {f.getPath().getName() for f in _listed(spark, f"{snapshot}/postings")}
    where = lambda r: (f"{snapshot}/postings/range={r}" if f"range={r}" in written else "") if r in todo else old[r]
    ranges = [(r.range, r.checksum, where(r.range)) for r in sums]
    found = block_index(passages, _blocks(spark, [p for _, _, p in ranges if p], passages))
    index = index_of(passages, found.postings, identity.fields, found.blocks)
    index.terms.write.parquet(f"{snapshot}/terms")
    index.totals.write.parquet(f"{snapshot}/totals")
    lowest = json.dumps([r.pos for r in passages.select("pos").orderBy("pos").limit(LOWEST).collect()], default=str)
    row = (FORMAT, identity.engine, identity.dataset, identity.split, ",".join(identity.fields), identity.tokenizer, sum(r.n for r in sums), " ".join(r.ids for r in sums), lowest, todo, ranges)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.json(f"{snapshot}/manifest")
    _commit(spark, path, known[-1] if known else 0, snapshot)
    return snapshot


def _listed(spark: SparkSession, path: str) -> list:
    p, fs = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _blocks(spark: SparkSession, paths: list[str], passages: DataFrame) -> DataFrame:
    shape = f"slice string, field string, term string, df bigint, words bigint, held array<struct<pos:{passages.schema['pos'].dataType.simpleString()},tf:bigint,size:int>>"
    return spark.read.schema(shape).parquet(*paths) if paths else spark.createDataFrame([], shape)


def load_index(spark: SparkSession, path: str, passages: DataFrame, identity: Identity = Identity(), sums: list[Row] | None = None) -> Index:
    """The current snapshot, after comparing format, engine, dataset, split, fields, tokenizer, passage count, passage ids and texts by range."""
    snapshot = current_snapshot(spark, path)
    if snapshot is None:
        raise IndexMismatch("absent")
    m = spark.read.schema(_MANIFEST).json(f"{snapshot}/manifest").first()
    asked = (FORMAT, identity.engine, identity.dataset, identity.split, ",".join(identity.fields), identity.tokenizer)
    for have, want, reason in zip((m.format, m.engine, m.dataset, m.split, m.fields, m.tokenizer), asked, ("format", "engine", "dataset", "split", "fields", "tokenizer"), strict=True):
        if have != want:
            raise IndexMismatch(reason)
    sums = sums or range_checksums(passages, identity.fields)
    old = {r["range"]: r.checksum for r in m.ranges}
    changed = [r.range for r in sums if old.get(r.range) != r.checksum]
    for ok, reason in ((m.passages == sum(r.n for r in sums), "passage_count"), (m.ids == " ".join(r.ids for r in sums), "passage_ids"), (not changed and len(old) == len(sums), "checksum")):
        if not ok:
            raise IndexMismatch(reason, changed)
    found = block_index(passages, _blocks(spark, [r.path for r in m.ranges if r.path], passages))
    return Index(passages, found.postings, spark.read.parquet(f"{snapshot}/terms"), spark.read.parquet(f"{snapshot}/totals"), json.loads(m.lowest), found.blocks)


def open_or_build(spark: SparkSession, path: str, passages: DataFrame, build: Callable[[DataFrame], Index], identity: Identity = Identity(), tries: int = 3) -> tuple[Index, str]:
    """(index, why): reuse a fitting index, else index what changed, commit, and read it back; who is overtaken looks again."""
    sums = range_checksums(passages, identity.fields)
    first = ""
    for n in range(tries):
        try:
            return load_index(spark, path, passages, identity, sums), first or "reused"
        except IndexMismatch as e:
            why, changed = e.reason, e.ranges
        first = first or why
        try:
            save_index(passages, path, build, identity, sums, changed)
        except IndexMismatch as e:
            if e.reason != "concurrent_commit" or n == tries - 1:
                raise
    return load_index(spark, path, passages, identity, sums), first


def corpus_manifest(spark: SparkSession, path: str) -> dict:
    """What the current snapshot says of itself: identity, counts, checksums, the ranges built last, and its bytes."""
    snapshot = current_snapshot(spark, path)
    m = spark.read.schema(_MANIFEST).json(f"{snapshot}/manifest").first().asDict(recursive=True)
    size = sum(_fs(spark, p)[1].getContentSummary(_fs(spark, p)[0]).getLength() for p in {r["path"] for r in m["ranges"] if r["path"]} | {f"{snapshot}/terms", f"{snapshot}/totals"})
    return {k: v for k, v in m.items() if k != "lowest"} | {"snapshot": snapshot, "index_bytes": size, "gold_evidence_not_used": True}


class BuildTooExpensive(RuntimeError):
    pass


def build_minutes(missing: int, batch: int, per_minute: int, dense: bool = True) -> float:
    """Minutes of embedding calls that a build needs; none without dense vectors."""
    return ceil(missing / batch) / per_minute if dense else 0.0


def missing_vectors(passages: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, text) of the distinct texts that the cache lacks; the key is the text's SHA-256."""
    return passages.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def fill_cache(passages: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 32, most_minutes: float | None = None, per_minute: int = 60) -> DataFrame:
    """The cache with vectors for all texts; refuses before any call if the estimate is over ``most_minutes``."""
    todo = missing_vectors(passages, cache)
    if most_minutes is not None and build_minutes(todo.count(), batch, per_minute) > most_minutes:
        raise BuildTooExpensive(f"over {most_minutes} minutes")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for s in range(0, len(f), batch):
                part = f.iloc[s : s + batch]
                yield pd.DataFrame({"key": part["key"], "vector": embed(part["text"].tolist())})

    return cache.unionByName(todo.mapInPandas(run, "key string, vector array<double>"))


def with_vectors(passages: DataFrame, cache: DataFrame) -> DataFrame:
    return passages.withColumn("key", F.sha2("text", 256)).join(cache, "key", "left").drop("key")
