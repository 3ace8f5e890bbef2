"""WARC archives with revisit resolution.

Payload digests are computed in Spark; only (page_id, digest) rows are shuffled to find, for every
digest, the record that stays a response. Then pages are written as WARC/1.1 records, one gzip
member each, into archives of bounded size, and read back: revisit records are resolved by a join
of the header rows on the payload digest.

Archives travel as binary cells of a Parquet table in the shared folder (any file system that Spark
writes; commits survive lost executors); each cell is a complete .warc.gz file.

Defined cases: a null payload is empty; payloads under ``min_bytes`` are always responses; rows that
repeat the smallest page_id with the same payload are responses too; a page without id is written as
a response and never is the target of a revisit, nor revisits; an empty table gives no archives.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    clean = (url or "").replace("\r", "").replace("\n", "").strip() or "about:blank"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _members(archive: bytes, chunk: int = 1 << 14) -> Iterator[tuple[int, int, list[bytes]]]:
    """(offset, length, decompressed parts) of every gzip member; what is read beyond a member's end is at most a chunk."""
    view, at = memoryview(archive), 0
    while at < len(archive):
        member, pos, parts = zlib.decompressobj(31), at, []
        while not member.eof and pos < len(archive):
            parts.append(member.decompress(view[pos : pos + chunk]))
            pos = min(pos + chunk, len(archive))
        if not member.eof:
            raise ValueError("an archive ends inside a record")
        size = pos - len(member.unused_data) - at
        yield at, size, parts
        at += size


def iter_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of every record; each gzip member is one record."""
    for _, _, parts in _members(archive):
        raw = b"".join(parts)
        head, _, tail = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        yield fields, tail[: int(fields["content-length"])]


def split_members(archive: bytes) -> Iterator[tuple[int, int]]:
    """(offset, length) of every gzip member: the record index of an archive."""
    for at, size, _ in _members(archive):
        yield at, size


def resolve_revisits(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the pages whose payload an earlier page has."""
    heads = pages.filter(F.col("page_id").isNotNull() & (F.col("payload_bytes") >= min_bytes)).select("page_id", "payload_digest")
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).filter("last > refers_to").drop("last")
    first = materialize(first, "warc-first")  # so the join below has plain inputs, whose hot digests AQE splits
    return heads.join(first, "payload_digest").filter("page_id <> refers_to").distinct()


def write_archives(pages: DataFrame, min_bytes: int = 100, max_archive: int = 16 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write (page_id, url, html) as deduplicated archives; returns (records, data)."""
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    full = full.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    revisits = materialize(resolve_revisits(full, min_bytes), "warc-revisits")
    joined = full.join(revisits, ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"records": pa.array([len(parts)], pa.int64()), "data": pa.array([b"".join(parts)], pa.binary())})

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to"))):
                parts.append(warc_record(*row, date))
                size += len(parts[-1])
                if size >= max_archive:
                    yield done()
                    parts, size = [], 0
        if parts:
            yield done()

    return materialize(joined.mapInArrow(write, "records long, data binary"), "warc", "none")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, record_type, payload_bytes, payload_digest, record_id, refers_to_id) of every record.

    Payload digests of responses and block digests of all records are verified.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["data"]:
                rows = []
                for f, block in iter_records(data.as_py()):
                    digest = f["warc-payload-digest"].removeprefix("sha256:")
                    if hashlib.sha256(block).hexdigest() != f["warc-block-digest"].removeprefix("sha256:"):
                        raise ValueError(f"damaged block in {f['warc-record-id']}")
                    size = None
                    if f["warc-type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        if hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"wrong payload digest in {f['warc-record-id']}")
                        size = len(payload)
                    rows.append((int(f["x-page-id"]) if "x-page-id" in f else None, f["warc-type"], size, digest, f["warc-record-id"], f.get("warc-refers-to")))
                names = ("page_id", "record_type", "payload_bytes", "payload_digest", "record_id", "refers_to_id")
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, t, c in zip(names, kinds, zip(*rows))})

    return archives.select("data").mapInArrow(read, "page_id long, record_type string, payload_bytes long, payload_digest string, record_id string, refers_to_id string")


def read_resolved(archives: DataFrame) -> DataFrame:
    """One row per record; revisits get the size and page of the response that their digest names."""
    heads = materialize(read_archives(archives), "warc-heads")
    revisits = heads.filter("record_type = 'revisit'")
    originals = heads.filter("record_type = 'response' AND page_id IS NOT NULL").select(F.col("record_id").alias("refers_to_id"), "payload_digest", F.col("payload_bytes").alias("size"), F.col("page_id").alias("refers_to")).distinct()
    wanted = materialize(originals.join(revisits.select("refers_to_id").distinct(), "refers_to_id", "left_semi"), "warc-originals")
    found = revisits.join(wanted, ["payload_digest", "refers_to_id"], "left").select("page_id", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return heads.filter("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(found)
