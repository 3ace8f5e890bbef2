"""Token-count rollups that are maintained by deltas, with idempotent batch commits.

A batch holds changes (change, doc_id, source, lang, tokenizer, tokens, seq) with change one of
``insert``, ``delete`` and ``revise``. A commit looks up the last counts of the documents that it
touches, turns the changes into signed rows (the old count out, the new count in), sums these by
source, language and tokenizer version, and writes a ledger part and a delta part. The batch counts
once its numbered commit file exists. That file is created, never replaced: of two writers that took the same number one creates
it, the other looks the counts up again and takes the next. Committing a batch's id again does nothing, and a part whose commit broke off
is never read. Totals are sums over the committed deltas; they never look at documents again.

After ``compact_every`` parts a commit folds the ledger into one part of last counts and the deltas into one part of sums, so what a later commit
reads stays within the state and a few batches.

Defined cases: inserting a known document revises it, revising an unknown one inserts it, deleting
an unknown one does nothing; of several changes of a document in a batch the last ``seq`` counts
(ties: the largest change by value); changes without doc_id only add (delete: subtract) their tokens; null
source, language or tokenizer are groups of their own; null tokens count as 0; groups whose documents and
tokens are both 0 are left out of the totals.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, drop_path, materialize, scratch_path, text_slices
from .encoders import encoder

KEYS = ["source", "lang", "tokenizer"]
_LEDGER = "doc_id long, tokenizer string, source string, lang string, tokens long, batch long"
_DELTA = "source string, lang string, tokenizer string, docs long, tokens long"


class Rollup:
    """A rollup in a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str, compact_every: int = 16):
        self.spark, self.root, self.compact_every = spark, root.rstrip("/"), compact_every

    def _commit_file(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits{name and '/' + name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """The commits in order: one short line each; a file that is still empty is not committed yet."""
        path, fs = self._commit_file()
        names = sorted(f.getPath().getName() for f in fs.listStatus(path) if f.getLen() > 0) if fs.exists(path) else []
        lines = self.spark.read.text([f"{self.root}/commits/{n}" for n in names]).collect() if names else []
        return sorted((json.loads(r.value) for r in lines), key=lambda c: c["number"])

    def _publish(self, number: int, batch_id: str | None, part: str, compacts: bool) -> bool:
        """Create the commit file of that number; False if another writer has it."""
        path, fs = self._commit_file(number_name(number))
        try:
            out = fs.create(path, False)
        except Exception as e:
            if "exists" in str(e).lower():
                return False
            raise
        out.write(bytearray(json.dumps({"number": number, "batch_id": batch_id, "part": part, "compacts": compacts}).encode()))
        out.close()
        return True

    def _read(self, kind: str, schema: str, commits: list[dict]) -> DataFrame:
        """The parts of the last compaction and of what came after it."""
        start = max((i for i, c in enumerate(commits) if c["compacts"]), default=0)
        parts = [c["part"] for c in commits[start:]]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{p}" for p in parts])

    def ledger(self, of: DataFrame | None = None, commits: list[dict] | None = None) -> DataFrame:
        """The last count of every (document, tokenizer), or of those ``of`` some rows; null tokens: deleted."""
        rows = self._read("ledger", _LEDGER, self.commits() if commits is None else commits)
        if of is not None:
            rows = rows.join(of.select("doc_id").distinct(), "doc_id", "left_semi")
        last = F.max(F.struct("batch", "source", "lang", "tokens"))
        return rows.groupBy("doc_id", "tokenizer").agg(last.alias("s")).select("doc_id", "tokenizer", "s.source", "s.lang", "s.tokens", "s.batch")

    def commit(self, batch_id: str, changes: DataFrame, tries: int = 20) -> bool:
        """Apply a batch; False (and no effect) if ``batch_id`` is committed already."""
        rows = changes.select("change", F.col("doc_id").cast("long").alias("doc_id"), *KEYS, F.coalesce(F.col("tokens").cast("long"), F.lit(0)).alias("tokens"), "seq")
        last = F.max(F.struct("seq", "change", "source", "lang", "tokens"))
        new: DataFrame | None = None
        for _ in range(tries):
            done = self.commits()
            if any(c["batch_id"] == batch_id for c in done):
                return False
            if new is None:
                new = rows.filter("doc_id IS NOT NULL").groupBy("doc_id", "tokenizer").agg(last.alias("n")).select("doc_id", "tokenizer", "n.source", "n.lang", F.when(F.col("n.change") != "delete", F.col("n.tokens")).alias("tokens"))
                new = materialize(new, "rollup-new")
            number = done[-1]["number"] + 1 if done else 0
            part = f"{number_name(number)}-{uuid.uuid4().hex}"
            old = self.ledger(new, done).select("doc_id", "tokenizer", F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.col("tokens").alias("old_tokens"))
            joined = new.join(old, (new.doc_id == old.doc_id) & new.tokenizer.eqNullSafe(old.tokenizer), "left").select(new["*"], "old_source", "old_lang", "old_tokens")

            def signed(sign: int, source: str, lang: str, tokens: str, joined: DataFrame = joined) -> DataFrame:
                return joined.filter(F.col(tokens).isNotNull()).select(F.col(source).alias("source"), F.col(lang).alias("lang"), "tokenizer", F.lit(sign).cast("long").alias("docs"), (sign * F.col(tokens)).alias("tokens"))

            sign = F.when(F.col("change") == "delete", -1).otherwise(1).cast("long")
            loose = rows.filter("doc_id IS NULL").select(*KEYS, sign.alias("docs"), (sign * F.col("tokens")).alias("tokens"))
            deltas = signed(-1, "old_source", "old_lang", "old_tokens").unionByName(signed(1, "source", "lang", "tokens")).unionByName(loose)
            new.withColumn("batch", F.lit(number).cast("long")).select(*[c.split()[0] for c in _LEDGER.split(", ")]).write.parquet(f"{self.root}/ledger/{part}")
            _sum(deltas).write.parquet(f"{self.root}/deltas/{part}")
            if self._publish(number, batch_id, part, False):
                since = max((i for i, c in enumerate(done) if c["compacts"]), default=0)
                if len(done) + 1 - since > self.compact_every:
                    self.compact()
                return True
            for kind in ("ledger", "deltas"):  # overtaken: these parts are of counts that no longer stand
                drop_path(self.spark, f"{self.root}/{kind}/{part}")
        raise RuntimeError(f"{batch_id} was overtaken {tries} times; if {number_name(number)} in {self.root}/commits is empty, its writer died there: remove it")

    def compact(self) -> bool:
        """Fold all parts into one of last counts (deleted documents go) and one of sums; False if another writer was faster."""
        done = self.commits()
        if not done:
            return False
        number = done[-1]["number"] + 1
        part = f"{number_name(number)}-{uuid.uuid4().hex}"
        self.ledger(commits=done).filter("tokens IS NOT NULL").select(*[c.split()[0] for c in _LEDGER.split(", ")]).write.parquet(f"{self.root}/ledger/{part}")
        _sum(self._read("deltas", _DELTA, done)).write.parquet(f"{self.root}/deltas/{part}")
        return self._publish(number, None, part, True)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches."""
        return _sum(self._read("deltas", _DELTA, self.commits())).filter("docs <> 0 OR tokens <> 0")


def number_name(n: int) -> str:
    return f"{n:09d}"


def _sum(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))).cast("long")


def tokenizer_feed(docs: DataFrame, tokenizer: Callable[[], str], version: str, change: str = "revise") -> DataFrame:
    """Changes that set every document's count to the ids that a public tokenizer gives its whole text (null text: 0).

    ``tokenizer`` names the tokenizer file on the worker that calls it, ``version`` the count's tokenizer column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rollups")
        for b in text_slices(batches):
            sizes = [len(x) for x in encoder(tokenizer()).encode(b["text"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "source": b["source"], "lang": b["lang"], "tokens": pa.array(sizes, pa.int64())})

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counted = text.mapInArrow(run, "doc_id long, source string, lang string, tokens long")
    return counted.select(F.lit(change).alias("change"), "doc_id", "source", "lang", F.lit(version).alias("tokenizer"), "tokens", F.lit(0).alias("seq"))


def corpus_rollup(docs: DataFrame) -> DataFrame:
    """The documents as a feed of four batches, one of them delivered twice.

    ``estimate`` inserts every document with a quarter of its characters as its token count, ``count``
    revises all to the exact counts of two tokenizer versions, ``count`` arrives again, and ``copies``
    deletes every document whose text a smaller id has.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.length(text).alias("chars"), word_count(text).alias("words"), F.octet_length(text).cast("long").alias("bytes"), F.md5(text.cast("binary")).alias("digest"))
    base = materialize(base, "rollup-base")
    versions = F.explode(F.array(F.struct(F.lit("words-v1").alias("tokenizer"), F.col("words").alias("tokens")), F.struct(F.lit("bytes-v1").alias("tokenizer"), F.col("bytes").alias("tokens"))))
    exact = base.select("doc_id", "source", "lang", "digest", "chars", versions.alias("v")).select("doc_id", "source", "lang", "digest", "chars", "v.tokenizer", "v.tokens")
    first = materialize(base.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first"), "rollup-first")

    def feed(rows: DataFrame, change: str, tokens: str) -> DataFrame:
        return rows.select(F.lit(change).alias("change"), "doc_id", *KEYS, F.expr(tokens).cast("long").alias("tokens"), F.lit(0).alias("seq"))

    rollup = Rollup(spark, scratch_path(spark, "rollup"))
    rollup.commit("estimate", feed(exact, "insert", "ceil(chars / 4)"))
    rollup.commit("count", feed(exact.filter("doc_id IS NOT NULL"), "revise", "tokens"))
    rollup.commit("count", feed(exact.filter("doc_id IS NOT NULL"), "revise", "tokens"))
    rollup.commit("copies", feed(exact.join(first, "digest").filter("doc_id > first"), "delete", "0"))
    return rollup.totals()
