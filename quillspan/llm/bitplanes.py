"""Bit-plane shuffled token-id files.

File layout (little-endian)::

    "QSBP" | u8 version | u8 mode (0 byte planes, 1 bit planes) | u16 zero | u32 block | u64 n_ids | u64 n_docs
    blocks: for each block of up to `block` ids, its planes one after the other, each a zstandard frame
    zstd(document table): i64 doc_id, u8 has_id, u64 n_tokens arrays
    zstd(chunk index): per block u64 file offset, u64 first id, u32 n_ids, u32 crc32 of the ids,
                       u8 n_planes, then n_planes u32 plane sizes
    u64 table offset | u64 index offset | "QSBP"

A block's ids are transposed: plane b holds bit (or byte) b of every id, so the planes of high bits
are long runs that zstandard removes. The chunk index makes any id range readable without the rest.

Files travel as binary cells of a Parquet table in the shared folder, so that any file system which
Spark can write holds them, and Spark's commit protocol covers lost executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_order_buckets, materialize, shuffle_width, text_slices
from .encoders import encoder

MAGIC = b"QSBP"
_HEAD = struct.Struct("<4sBBHIQQ")
_TAIL = struct.Struct("<QQ4s")


def _transposed(column: np.ndarray) -> np.ndarray:
    """(n / 8, 8) bytes from n: bit k of byte i of a group of eight becomes bit i of byte k. Its own inverse."""
    x = column.view("<u8")
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        t = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ t ^ (t << np.uint64(shift))
    return x.view(np.uint8).reshape(-1, 8)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes from the lowest to the highest that is not all zero; a bit plane's unused end bits are zero."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(len(ids), 4)
    top = int(ids.max()).bit_length() if len(ids) else 0
    if not bits:
        return [np.ascontiguousarray(raw[:, b]).tobytes() for b in range((top + 7) // 8)]
    out: list[bytes] = []
    for b in range((top + 7) // 8):
        column = np.zeros(-(-len(ids) // 8) * 8, dtype=np.uint8)
        column[: len(ids)] = raw[:, b]
        planes = _transposed(column)
        out += [planes[:, k].tobytes() for k in range(min(8, top - 8 * b))]
    return out


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    raw = np.zeros((n, 4), dtype=np.uint8)
    if not bits:
        for b, p in enumerate(planes):
            raw[:, b] = np.frombuffer(p, dtype=np.uint8)
        return raw.view("<u4").reshape(n)
    for b in range((len(planes) + 7) // 8):
        columns = np.zeros((-(-n // 8), 8), dtype=np.uint8)
        for j, p in enumerate(planes[8 * b : 8 * b + 8]):
            columns[:, j] = np.frombuffer(p, dtype=np.uint8)
        raw[:, b] = _transposed(columns.reshape(-1)).reshape(-1)[:n]
    return raw.view("<u4").reshape(n)


class PlaneWriter:
    """Collects documents and gives the bytes of one file."""

    def __init__(self, block: int = 16384, bits: bool = True, level: int = 1):
        self.block, self.bits = block, bits
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.body: list[bytes] = []
        self.at = _HEAD.size
        self.index: list[bytes] = []
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_ids = 0
        self.docs: list[tuple[int, int, int]] = []

    @property
    def size(self) -> int:
        return self.at + 4 * self.waiting

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.pending.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.pending)
            cut = len(flat) // self.block * self.block
            for s in range(0, cut, self.block):
                self._emit(flat[s : s + self.block])
            self.pending, self.waiting = [flat[cut:]], len(flat) - cut

    def _emit(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids, self.bits)]
        self.index.append(struct.pack(f"<QQIIB{len(planes)}I", self.at, self.n_ids, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(planes), *map(len, planes)))
        self.body += planes
        self.at += sum(map(len, planes))
        self.n_ids += len(ids)

    def close(self) -> bytes:
        if self.waiting:
            self._emit(np.concatenate(self.pending))
        ids, has, sizes = (np.array(c) for c in zip(*self.docs)) if self.docs else ([], [], [])
        table = self.zstd.compress(np.asarray(ids, "<i8").tobytes() + np.asarray(has, np.uint8).tobytes() + np.asarray(sizes, "<u8").tobytes())
        index = self.zstd.compress(b"".join(self.index))
        head = _HEAD.pack(MAGIC, 1, self.bits, 0, self.block, self.n_ids, len(self.docs))
        return b"".join([head, *self.body, table, index, _TAIL.pack(self.at, self.at + len(table), MAGIC)])


class PlaneReader:
    """Random access to one file's bytes; every block that is read is verified."""

    def __init__(self, data: bytes):
        magic, version, self.bits, _, self.block, self.n_ids, n = _HEAD.unpack_from(data)
        table, index, end = _TAIL.unpack_from(data, len(data) - _TAIL.size)
        if magic != MAGIC or end != MAGIC or version != 1:
            raise ValueError("not a bit-plane file")
        self.data, self.zstd = memoryview(data), zstandard.ZstdDecompressor()
        raw = self.zstd.decompress(data[table:index])
        ids, has = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [i if h else None for i, h in zip(ids.tolist(), has.tolist())]
        self.doc_sizes = np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)
        packed, p, self.chunks = self.zstd.decompress(data[index : len(data) - _TAIL.size]), 0, []
        while p < len(packed):
            at, first, size, crc, planes = struct.unpack_from("<QQIIB", packed, p)
            self.chunks.append((at, first, size, crc, struct.unpack_from(f"<{planes}I", packed, p + 25)))
            p += 25 + 4 * planes

    def chunk(self, k: int) -> np.ndarray:
        at, _, n, crc, sizes = self.chunks[k]
        planes = []
        for s in sizes:
            planes.append(self.zstd.decompress(self.data[at : at + s]))
            at += s
        ids = from_planes(planes, n, bool(self.bits))
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"block {k} is damaged")
        return ids

    def read(self, start: int, n: int) -> np.ndarray:
        """Ids [start, start + n), from the blocks that hold them only."""
        if n <= 0:
            return np.empty(0, dtype=np.uint32)
        first, last = start // self.block, (start + n - 1) // self.block
        flat = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return flat[start - first * self.block :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id in this file, ids) of every document, in file order, block by block."""
        at, have, base, k = 0, np.empty(0, dtype=np.uint32), 0, 0
        for doc_id, n in zip(self.doc_ids, self.doc_sizes.tolist()):
            parts = [have[at - base :]]
            got = len(parts[0])
            while got < n:
                parts.append(self.chunk(k))
                got += len(parts[-1])
                k += 1
            have, base = np.concatenate(parts) if len(parts) > 1 else parts[0], at
            yield doc_id, at, have[:n]
            at += n


def write_files(docs: DataFrame, tokenizer: Callable[[], str], end_id: int = 1, block: int = 16384, bits: bool = True, max_file: int = 32 << 20) -> DataFrame:
    """Encode (doc_id, text) and write files of about ``max_file`` bytes at most, in ascending doc_id order.

    Returns (bucket, part, n_ids, data): the files of a range of ids are its parts. A file ends with the document that
    fills it, so a longer document still lies in one file. A null text is empty and has just its end id; null ids come
    first; rows that share an id follow each other, ordered by text; an empty table gives no file.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    placed, _ = in_order_buckets(kept, "doc_id", 8 * width)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=np.uint32)
        at, part, writer = None, 0, None

        def done() -> pa.RecordBatch:
            data = writer.close()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "n_ids": pa.array([writer.n_ids], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in text_slices(batches):
            ids = encoder(tokenizer()).encode(batch["text"].to_pylist())
            for bucket, doc_id, x in zip(batch["bucket"].to_pylist(), batch["doc_id"].to_pylist(), ids):
                if bucket != at or writer.size >= max_file:
                    if writer:
                        yield done()
                    at, part, writer = bucket, part + 1 if bucket == at else 0, PlaneWriter(block, bits)
                writer.add(doc_id, np.concatenate((x, end)))
        if writer:
            yield done()

    files = placed.repartition(width, "bucket").sortWithinPartitions("bucket", "doc_id", "text").mapInArrow(write, "bucket int, part int, n_ids long, data binary")
    return materialize(files, "bitplanes", "none")


def read_documents(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    Files are read where they are; what comes before each file is a sum over buckets and parts, joined to the documents' narrow rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, part, data in zip(batch["bucket"].to_pylist(), batch["part"].to_pylist(), batch["data"]):
                rows = [(bucket, part, d, s, len(x), zlib.crc32(x)) for d, s, x in PlaneReader(data.as_py()).documents()]
                names = ("bucket", "part", "doc_id", "within", "n_tokens", "ids_crc32")
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n in names[:2] else pa.int64()) for n, c in zip(names, zip(*rows))], names=list(names))

    sizes = files.select("bucket", "part", "n_ids")
    buckets = sizes.groupBy("bucket").agg(F.sum("n_ids").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a bucket, of which there are a fixed number
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(sizes.withColumn("inside", inside).join(buckets.withColumn("earlier", earlier), "bucket").select("bucket", "part", (F.col("earlier") + F.col("inside")).alias("base")), "bitplane-bases")
    read_rows = files.select("bucket", "part", "data").mapInArrow(read, "bucket int, part int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return read_rows.join(bases, ["bucket", "part"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
