"""Bottom-k sketches of five-word shingles: mergeable document fingerprints.

A sketch is the ``k`` smallest distinct 48-bit shingle hashes, sorted, six bytes each, in base64.
Sketches of parts merge into the sketch of the whole; they estimate resemblance (Jaccard),
containment and the number of distinct shingles, and are exact while a text has fewer than
``k`` distinct shingles.

Defined cases: a null or blank text has an empty sketch; two empty sketches resemble each other
fully, an empty and a filled one not at all; a text of one to four words has one shingle.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWEST_ID, in_order_buckets, shingle_hashes, shuffle_width

K = 128
_RANGE = float(1 << 48)


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """Sorted uint64 array of at most ``k`` distinct 48-bit hashes."""
    h = shingle_hashes(text) >> np.uint64(16)
    if len(h) > 4 * k:  # the k smallest distinct ones are among the smallest of few repeats; else sort all
        few = np.unique(np.partition(h, 2 * k)[: 2 * k])
        if len(few) >= k:
            return few[:k]
    return np.unique(h)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness of the two shingle sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    same = both[1:] == both[:-1]
    distinct = np.concatenate(([True], ~same))
    shared = np.concatenate((same, [False]))[distinct]
    return float(shared[:k].sum()) / min(k, len(shared))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    return float(len(a)) if len(a) < k else (k - 1) * _RANGE / float(a[-1] + np.uint64(1))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too."""
    if not len(a):
        return 1.0
    return min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k))


def dump(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()).decode()


def load(s: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(s), dtype=np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), dtype=np.uint8)
    out[:, :6] = raw
    return out.view("<u8").reshape(-1).astype(np.uint64)


def with_next(docs: DataFrame) -> DataFrame:
    """Deal (doc_id, text) into ordered ranges in which each row's successor is the next row.

    The first row of each range is repeated at the end of the range before it (``guard`` = 1; after
    the last range: the first row of all), so no global sort or single task is needed and each text
    is shuffled once. Partitions come sorted by (bucket, guard, doc_id, text).
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    placed, _ = in_order_buckets(kept, "doc_id", 8 * width)
    rank = F.coalesce("doc_id", F.lit(LOWEST_ID))
    heads = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.min(rank)).collect())  # one small row per range
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    guards = spark.createDataFrame(before, "head long, guarded int")
    own = F.struct(F.col("bucket"), F.lit(0).alias("guard"))
    extra = F.struct(F.col("guarded").alias("bucket"), F.lit(1).alias("guard"))
    dealt = placed.join(F.broadcast(guards), rank == F.col("head"), "left").select("doc_id", "text", F.explode(F.when(F.col("guarded").isNull(), F.array(own)).otherwise(F.array(own, extra))).alias("at"))
    return dealt.select("doc_id", "text", "at.bucket", "at.guard").repartition(width, "bucket").sortWithinPartitions("bucket", "guard", "doc_id", "text")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, containment_in_edited double"


def fingerprint_edits(docs: DataFrame, k: int = K) -> DataFrame:
    """Fingerprint every text and its edited text (its last half replaced by the next document's start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row that waits for its successor: (bucket, doc_id, text, sketch)
        closed = None
        rows: list[tuple] = []

        def finish(text: str, mine: np.ndarray, doc_id: int | None, follower: str, theirs: np.ndarray) -> None:
            half = len(text) // 2
            edited = text[: len(text) - half] + follower[:half]
            other = sketch(edited, k)
            rows.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), dump(mine), dump(other), resemblance(mine, other, k), resemblance(mine, theirs, k), distinct_count(mine, k), containment(mine, other, k)))

        schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64()), ("containment_in_edited", pa.float64())])
        for batch in batches:
            for bucket, guard, doc_id, text in zip(*(batch[c].to_pylist() for c in ("bucket", "guard", "doc_id", "text"))):
                if guard and closed == bucket:
                    continue  # rows that share the guard's id: the first is the successor
                mine = sketch(text, k)
                if held and held[0] == bucket:
                    finish(held[2], held[3], held[1], text, mine)
                held = None if guard else (bucket, doc_id, text, mine)
                closed = bucket if guard else closed
                if len(rows) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return with_next(docs).mapInArrow(run, RESULT)
