"""Question and passage records: JSON readers, normalisers, dataset adapters, run records, sinks."""

from __future__ import annotations

import hashlib
import json
import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from .scratch import written

_WRAPPERS = ("data", "questions", "records", "items")


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines, split at newlines only; a line that is not an object is an error, blank lines are skipped."""
    reader = spark.read.option("lineSep", "\n").option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document that is a list of records, or an object that holds one under a usual name."""
    df = spark.read.option("multiLine", True).json(path)
    for name in _WRAPPERS:
        if name in df.columns and isinstance(df.schema[name].dataType, ArrayType):
            return df.select(F.explode(name).alias("r")).select("r.*")
    return df


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file's non-blank lines; the number is the place in the whole file."""
    lines = spark.read.option("lineSep", "\n").text(path).rdd.zipWithIndex().map(lambda x: (x[1], x[0].value))
    return spark.createDataFrame(lines, "line_no long, value string").filter(F.trim("value") != "")


def first_filled(df: DataFrame, *names: str) -> Column:
    """The first named column that is neither null nor empty."""
    have = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def normalize_passages(df: DataFrame) -> DataFrame:
    """(id, text, doc_id) from the usual names; a list of texts is joined by blanks; missing ids come from the place."""
    texts = []
    for n in ("text", "context", "passage", "document"):
        if n in df.columns:
            c = F.array_join(n, " ") if isinstance(df.schema[n].dataType, ArrayType) else F.col(n).cast("string")
            texts.append(F.nullif(c, F.lit("")))
    place = F.col("place") if "place" in df.columns else F.lit(0)
    doc = F.coalesce(first_filled(df, "doc_id", "document_id", "title"), F.concat(F.lit("doc-"), place.cast("string")))
    return df.select(F.coalesce(first_filled(df, "id"), F.concat(doc, F.lit("#0"))).alias("id"), F.coalesce(*texts).alias("text"), doc.alias("doc_id"))


def normalize_questions(df: DataFrame) -> DataFrame:
    """(id, question, answers, metadata): unknown columns go to a string map; a single answer becomes a list."""
    place = F.col("place") if "place" in df.columns else F.lit(0)
    name = next((n for n in ("answers", "answer") if n in df.columns), None)
    if name is None:
        answers = F.array().cast("array<string>")
    elif isinstance(df.schema[name].dataType, ArrayType):
        answers = F.col(name).cast("array<string>")
    else:
        answers = F.filter(F.array(F.col(name).cast("string")), lambda a: a.isNotNull())
    known = {"id", "question", "query", "input", "answers", "answer", "place", "passages", "documents", "context"}
    rest = [x for c in df.columns if c not in known for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.map_filter(F.create_map(*rest), lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return df.select(F.coalesce(first_filled(df, "id"), F.concat(F.lit("q-"), place.cast("string"))).alias("id"), first_filled(df, "question", "query", "input").alias("question"), answers.alias("answers"), metadata.alias("metadata"))


def safe_metadata(c: Column) -> Column:
    """Metadata without the keys that give gold evidence away."""
    return F.map_filter(c, lambda k, v: ~F.lower(k).isin("gold_evidence", "gold_supporting_facts", "supporting_facts"))


def gold_ids(titles: Column) -> Column:
    """Passage ids of supporting titles, each once."""
    return F.array_distinct(F.transform(titles, lambda t: F.concat(t, F.lit("#0"))))


def hop_stratum(record_id: Column) -> Column:
    """2hop, 3hop or 4hop from a compositional id, else unknown."""
    hit = F.regexp_extract(F.substring_index(record_id, "__", 1), "^([234]hop)", 1)
    return F.when(hit != "", hit).otherwise("unknown")


def split_drop_prompt(c: Column) -> tuple[Column, Column]:
    """(paragraph, question) of a combined prompt."""
    shape = r"(?s)Paragraph:\s*(.*?)\s*Question:\s*(.*?)\s*(?:Answer:.*)?$"
    return F.regexp_extract(c, shape, 1), F.regexp_extract(c, shape, 2)


def shared_corpus(passages: DataFrame, dataset: str) -> DataFrame:
    """Distinct (doc_id, id, text) with the questions that bring them, ids with provenance, and the corpus order.

    ``pos`` is a dense number in (doc_id, id, text) order. It comes from a range partitioning and per-partition
    offsets, so no task sees more than its range.
    """
    merged = passages.groupBy("doc_id", "id", "text").agg(F.array_sort(F.collect_set("question_id")).alias("question_ids"))
    named = merged.withColumn("passage_id", F.concat_ws(":", F.lit(dataset), "doc_id", "id"))
    return dense_positions(named, ["doc_id", "id", "text"])


def dense_positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Append ``pos`` = 0, 1, ... in the given order, without a single-partition window.

    Rows are dealt to ranges once and written to the shared scratch folder; the driver adds up one count for each range.
    """
    ranged = written(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("__range", F.spark_partition_id()), "ranges")
    counts = {r["__range"]: r["count"] for r in ranged.groupBy("__range").count().collect()}
    before, offsets = 0, []
    for r in sorted(counts):
        offsets += [F.lit(r), F.lit(before).cast("long")]
        before += counts[r]
    start = F.element_at(F.create_map(*offsets), F.col("__range")) if offsets else F.lit(0).cast("long")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn("pos", start + place).drop("__range")


def read_runs(spark: SparkSession, root: str, stage: str | None = None) -> DataFrame:
    """Run records below a folder, attempts or the items of one stage."""
    base, pattern = (f"{root}/items/{stage}", "*.json") if stage else (f"{root}/attempts", "attempt-*.json")
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).option("multiLine", True).json(base)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def atomic_json(path: str | Path, value: object) -> None:
    """Write a small driver-side JSON file whole or not at all."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_text(json.dumps(value, sort_keys=True, ensure_ascii=False))
    os.replace(part, path)


def extract_archive(archive: str | Path, target: str | Path) -> Path:
    """Unpack a zip file; members that would leave the folder are an error."""
    target = Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for m in z.namelist():
            if not (target / m).resolve().is_relative_to(target):
                raise ValueError(f"unsafe member {m}")
        z.extractall(target)
    return target


def canonical_digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
