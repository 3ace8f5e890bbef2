"""Shared plumbing of the training-data operators: scratch tables, document order, shingles."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOWEST_ID = -(2**63)
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only a plain ``local[...]`` session (tests) may run without one; it then gets a
    temporary folder of its own, because its driver and executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quillspan-"))


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Tables that are written in here leave no shuffle files: otherwise these stay on disk until the driver collects the plans."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


_HELD: dict[str, Callable[[], None]] = {}


def claim(name: str, clear: Callable[[], None] | None = None) -> None:
    """Say what a Python worker works on now; what other operators left in its memory is dropped.

    Spark reuses workers from stage to stage, so a stage's caches would otherwise add up with the next one's.
    """
    others = [n for n in _HELD if n != name]
    for n in others:
        _HELD.pop(n)()
    if others:
        release()
    _HELD.setdefault(name, clear or (lambda: None))


def release() -> None:
    """Hand freed memory back: idle workers stay, and what they keep counts while the next stage runs in the JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)  # where the C library can
    except (OSError, AttributeError):
        pass


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def in_order_buckets(df: DataFrame, key: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """Add ``bucket``: consecutive, roughly equal ranges of the integer ``key`` (nulls first).

    The boundaries are one small number per bucket, as in Spark's own range partitioner, and
    depend on the data only, so a recomputed partition holds the same rows.
    """
    probs = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(key, probs, 1 / (4 * buckets)) if probs else []
    edges = np.array(sorted({int(x) for x in found}), dtype=np.int64)

    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, k.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    return df.withColumn("bucket", place(F.coalesce(F.col(key).cast("long"), F.lit(LOWEST_ID)))), edges.tolist()


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of about ``most`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            before = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, end - at)
            at = end


def fresh(name: str, taken: list[str]) -> str:
    """``name``, or with underscores before it, so that no column (names ignore case) has it."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(key.cast("string").cast("binary")) % n


# ---- shingles -------------------------------------------------------------------------------

_B = np.uint64(0x9E3779B97F4A7C15)
_STEP = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    acc = 1
    for i in range(n):
        out[i] = acc
        acc = acc * base & 0xFFFFFFFFFFFFFFFF
    return out


_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_UP = _powers(_BASE, _STEP)
_DOWN = _powers(_INVERSE, _STEP)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); vectorised, wraps around."""
    x = x.astype(np.uint64, copy=True)
    x += _B
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[i for i in range(0x3001) if chr(i).isspace()]] = True


def word_hashes(text: str) -> np.ndarray:
    """64-bit hash of each whitespace-separated lower-cased word, without a Python loop over words.

    A word's hash is a polynomial over its code points, taken from a prefix sum and shifted
    back by the inverse power; both live in the ring of 64-bit integers.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(code):
        return np.empty(0, dtype=np.uint64)
    gap = _SPACE[code]
    solid = np.concatenate(([False], ~gap, [False]))
    turn = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = turn[0::2], turn[1::2]
    if not len(start):
        return np.empty(0, dtype=np.uint64)
    n = len(code)
    at = np.arange(n) % _STEP
    add = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((code.astype(np.uint64) + np.uint64(1)) * _UP[at])))
    # a word may straddle a multiple of _STEP: there the power restarts, which is undone by a correction
    out = (add[end] - add[start]) * _DOWN[start % _STEP]
    for w in np.flatnonzero(start // _STEP != (end - 1) // _STEP):
        acc = 0
        for j, c in enumerate(code[start[w] : end[w]].tolist()):
            acc = (acc + (c + 1) * pow(_BASE, j, 1 << 64)) & 0xFFFFFFFFFFFFFFFF
        out[w] = acc
    return mix64(out)


def shingle_hashes(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of all runs of ``width`` words, repeats included, in text order.

    A text of 1 to ``width - 1`` words has one shingle, all its words; a null or blank text has none.
    """
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(width, len(w))
    acc = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for j in range(k):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + w[j : j + len(acc)]
    return mix64(acc)
