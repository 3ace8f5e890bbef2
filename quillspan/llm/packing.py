"""Lexical retrieval packing: sharded BM25 indexes choose what follows what in training windows.

1. Documents are encoded once and written; the same pass counts in how many documents each id stands, and
   gives each document a place: the smallest hash of its id trigrams, then a hash of the document itself. So
   documents that share much text lie near each other, and copies of one text still spread over many places.
2. Places are cut into ranges of equal row counts; each range streams through a task in order of place and
   is cut into shards of ``shard_tokens``, so memory follows the shard, whatever the range or the corpus.
3. Each shard builds a BM25 inverted index over token ids, with document frequencies and mean length of the
   whole corpus, and packs greedily: a seed document opens a window, the index returns its unused neighbours
   by score (all of the seed's ids are asked for), and they fill the window; the neighbour that overflows continues
   in the next window and becomes its seed. Windows are full except at the end of a shard, where the rest is cut into
   sequences whose lengths are powers of two, which need no padding.

Retrieval stays inside a shard: a seed's neighbours are the best ones among the documents near its place.

Defined cases: a null text is empty and still has its end id; repeated rows are packed once each;
an empty table gives no rows; a document longer than the window runs over several windows; ties in
score go to the document that came first in the shard's order (place, id, ids).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_order_buckets, materialize, mix64, shuffle_width, text_slices
from .encoders import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_length long"
_REFILL = 64


class Bm25Index:
    """An inverted index over the token ids of one shard (k1 = 1.5, b = 0.75).

    ``frequency`` (by id), ``n_docs`` and ``mean`` describe the corpus; without them the shard is the corpus.
    """

    def __init__(self, docs: list[np.ndarray], frequency: np.ndarray | None = None, n_docs: int = 0, mean: float = 0.0, k1: float = 1.5, b: float = 0.75):
        n = self.n = len(docs)
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        flat = np.concatenate(docs).astype(np.int64) if n else np.empty(0, dtype=np.int64)
        pair, tf = np.unique(flat * n + np.repeat(np.arange(n), sizes), return_counts=True)
        term, self.doc = np.divmod(pair, max(n, 1))
        terms, first, held = np.unique(term, return_index=True, return_counts=True)
        self.bound = np.append(first, len(term))
        df = held if frequency is None else frequency[terms]
        n_docs, mean = (n_docs, mean) if frequency is not None else (n, sizes.mean() if n else 1.0)
        norm = k1 * (1 - b + b * sizes / max(mean, 1.0))
        self.weight = np.repeat(np.log1p((n_docs - df + 0.5) / (df + 0.5)), held) * tf * (k1 + 1) / (tf + norm[self.doc])
        # the other way round: the terms of each document that other documents of the shard have too
        row = np.repeat(np.arange(len(terms)), held)
        shared = np.repeat(held, held) > 1
        order = np.argsort(self.doc[shared], kind="stable")
        self.terms_of = row[shared][order]
        self.first_term = np.concatenate(([0], np.cumsum(np.bincount(self.doc[shared], minlength=n))))

    def query(self, seed: int) -> np.ndarray:
        """BM25 score of every document of the shard for all distinct ids of document ``seed``."""
        at = self.terms_of[self.first_term[seed] : self.first_term[seed + 1]]
        if not len(at):
            return np.zeros(self.n)
        count = self.bound[at + 1] - self.bound[at]
        ends = np.cumsum(count)
        post = np.repeat(self.bound[at] - (ends - count), count) + np.arange(int(ends[-1]))
        return np.bincount(self.doc[post], weights=self.weight[post], minlength=self.n)


def packing_order(sizes: list[int], index: Bm25Index, window: int) -> Iterator[int]:
    """Yield document numbers in the order in which they enter the windows."""
    unused = np.ones(len(sizes), dtype=bool)
    fill, seed, cursor = 0, None, 0
    queue: list[int] = []
    for _ in range(len(sizes)):
        if seed is not None and not queue:  # the best few; the index is asked again once they are used up
            score = np.where(unused, index.query(seed), 0.0)
            least = np.partition(score, -_REFILL)[-_REFILL] if len(score) > _REFILL else 0.0
            top = np.flatnonzero((score >= least) & (score > 0))
            queue = top[np.lexsort((top, -score[top]))][::-1].tolist()
        if queue:
            nxt = queue.pop()
        else:
            while not unused[cursor]:
                cursor += 1
            nxt = cursor
        unused[nxt] = False
        yield nxt
        total = fill + sizes[nxt]
        if seed is None or total >= window:
            seed, queue = nxt, []
        fill = total % window
        if fill == 0:
            seed = None


def sequence_bounds(total: int, window: int) -> list[int]:
    """Lengths of the sequences that hold ``total`` ids: full windows, then powers of two."""
    out = [window] * (total // window)
    rest = total % window
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_shard(first_sequence: int, doc_ids: list, docs: list[np.ndarray], window: int, index: Bm25Index) -> tuple[dict[str, list], int]:
    """Columns of PIECES, and the number of sequences."""
    out: dict[str, list] = {c.split()[0]: [] for c in PIECES.split(", ")}
    sizes = [len(d) for d in docs]
    lengths = sequence_bounds(sum(sizes), window)
    seq, offset = 0, 0
    for d in packing_order(sizes, index, window):
        start, total = 0, sizes[d]
        raw = memoryview(docs[d].astype("<u4").tobytes())
        while start < total:
            size = min(total - start, lengths[seq] - offset)
            row = (doc_ids[d], start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), total, first_sequence + seq, offset, lengths[seq], lengths[seq])
            for c, v in zip(out, row):
                out[c].append(v)
            start, offset = start + size, offset + size
            if offset == lengths[seq]:
                seq, offset = seq + 1, 0
    return out, len(lengths)


def places(docs: list[np.ndarray]) -> np.ndarray:
    """int64 place of each document (none empty): its smallest trigram hash, then a hash of all of it."""
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    flat = np.concatenate(docs).astype(np.uint64)
    start = np.cumsum(sizes) - sizes
    ahead = np.concatenate((flat, np.zeros(2, dtype=np.uint64)))
    left = np.repeat(start + sizes, sizes) - np.arange(len(flat))  # ids from here to the document's end
    second, third = np.where(left > 1, ahead[1:-1], np.uint64(0)), np.where(left > 2, ahead[2:], np.uint64(0))
    tri = mix64((flat << np.uint64(40)) ^ (second << np.uint64(20)) ^ third)
    tri[(left < 3) & (np.repeat(sizes, sizes) > 2)] = np.uint64(2**64 - 1)
    low = np.minimum.reduceat(tri, start)
    return (low >> np.uint64(1)).astype(np.int64)


def encode_documents(docs: DataFrame, tokenizer: Callable[[], str], end_id: int) -> DataFrame:
    """(doc_id, n, place, ids) of each document; rows of negative n hold counts of documents by id."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=np.uint32)
        names = ["doc_id", "n", "place", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        frequency = np.zeros(0, dtype=np.int64)
        for batch in text_slices(batches, most=2_000_000):
            ids = [np.concatenate((x, end)) for x in encoder(tokenizer()).encode(batch["text"].to_pylist())]
            sizes = [len(x) for x in ids]
            flat = np.concatenate(ids).astype(np.int64)
            pair = np.unique(np.repeat(np.arange(len(ids)), sizes) << 32 | flat) & 0xFFFFFFFF
            found = np.bincount(pair, minlength=len(frequency))
            found[: len(frequency)] += frequency
            frequency = found
            own = np.array([zlib.crc32(x, i or 0) for x, i in zip(ids, (d & 0xFFFFFFFF if d is not None else 0 for d in batch["doc_id"].to_pylist()))], dtype=np.int64)
            place = places(ids) >> 20 << 20 | own & 0xFFFFF
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(place), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], names=names)
        if len(frequency):
            counted = np.flatnonzero(frequency)
            raw = np.stack((counted, frequency[counted]), axis=1).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((None, -1, None, raw), kinds)], names=names)

    return materialize(kept.mapInArrow(run, "doc_id long, n long, place long, ids binary"), "pack-ids")


def corpus_statistics(encoded: DataFrame) -> tuple[np.ndarray, int, float]:
    """(documents by id, documents, mean length). One row for each id of the vocabulary comes to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["ids"].to_pylist():
                pairs = np.frombuffer(raw, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["id", "docs"])

    sums = encoded.filter("n < 0").select("ids").mapInArrow(rows, "id long, docs long").groupBy("id").agg(F.sum("docs").alias("docs")).toPandas()
    frequency = np.zeros(int(sums["id"].max()) + 1 if len(sums) else 0, dtype=np.int64)
    frequency[sums["id"].to_numpy(dtype=np.int64)] = sums["docs"].to_numpy(dtype=np.int64)
    total = encoded.filter("n >= 0").agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).first()
    return frequency, total["docs"], float(total["mean"] or 0.0)


def pack(docs: DataFrame, tokenizer: Callable[[], str], window: int = 1024, end_id: int = 0, shard_tokens: int = 500_000) -> DataFrame:
    """Pack (doc_id, text) into sequences; one row per piece.

    ``tokenizer`` names the tokenizer file on the worker that calls it.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    encoded = encode_documents(docs, tokenizer, end_id)
    statistics = spark.sparkContext.broadcast(corpus_statistics(encoded))  # as long as the vocabulary
    dealt, _ = in_order_buckets(encoded.filter("n >= 0").select("doc_id", "place", "ids"), "place", 2 * width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sequence, size = None, 0, 0
        doc_ids: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, size
            rows, used = pack_shard(at << 40 | sequence, doc_ids, ids, window, Bm25Index(ids, *statistics.value))
            sequence, size = sequence + used, 0
            doc_ids.clear()
            ids.clear()
            return pa.RecordBatch.from_pydict({c: pa.array(v, type=pa.int64()) for c, v in rows.items()})

        for batch in batches:
            for bucket, doc_id, raw in zip(batch["bucket"].to_pylist(), batch["doc_id"].to_pylist(), batch["ids"]):
                if ids and (bucket != at or size >= shard_tokens):
                    yield flush()
                if bucket != at:
                    at, sequence = bucket, 0
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(raw.as_buffer(), dtype="<u4"))
                size += len(ids[-1])
        if ids:
            yield flush()

    return dealt.repartition(width, "bucket").sortWithinPartitions("bucket", "place", "doc_id", "ids").mapInArrow(run, PIECES)
