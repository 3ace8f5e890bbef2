"""Append-only registry of exposed samples: whole batches, each committed once, merged on reading.

A batch's rows are written to a folder of their own; then a marker with the batch's name is created, never replaced. A
batch that is committed again, by a retry or another writer, changes nothing, and readers see only committed batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "dataset string, sample_id string, run string, split string, method string, result_exposed boolean, per_question_exposed boolean"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str) -> dict[str, str]:
    p, fs = _fs(spark, f"{path}/commits")
    names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getLen() > 0) if fs.exists(p) else []
    if not names:
        return {}
    lines = spark.read.text([f"{path}/commits/{n}" for n in names]).collect()  # one short line a batch
    return dict(r.value.split("\t") for r in lines)


def expose(rows: DataFrame, path: str, batch: str) -> bool:
    """Commit the rows (see ``ROW``) as ``batch``; false if that batch is there already. Rows are reduced to one a sample, run and method first."""
    spark = rows.sparkSession
    name, fs = _fs(spark, f"{path}/commits/{uuid.uuid5(uuid.NAMESPACE_URL, batch).hex}")
    if fs.exists(name) and fs.getFileStatus(name).getLen() > 0:
        return False
    keys = ["dataset", "sample_id", "run", "split", "method"]
    folder = f"{path}/data/{uuid.uuid4().hex}"
    rows.groupBy(*keys).agg(F.max("result_exposed").alias("result_exposed"), F.max("per_question_exposed").alias("per_question_exposed")).write.parquet(folder)
    try:
        out = fs.create(name, False)
    except Exception:  # another writer was faster: its rows count, these go
        data, _ = _fs(spark, folder)
        fs.delete(data, True)
        return False
    out.write(bytearray(f"{batch}\t{folder}".encode()))
    out.close()
    return True


def contamination(split: Column, scored: Column) -> Column:
    """What an exposed sample may still be used for."""
    held = split.isin("evaluation", "eval", "dev")
    return F.when(held & scored, "CONTAMINATED").when(held, "EXPOSED_NOT_SCORED").when(split == "train", "TRAIN_EXPOSED").otherwise("UNKNOWN")


def exposures(spark: SparkSession, path: str) -> DataFrame:
    """One row a (dataset, sample): first run by name, its split (a known one before unknown), all methods, flags and status."""
    folders = list(_committed(spark, path).values())
    rows = spark.read.schema(ROW).parquet(*folders) if folders else spark.createDataFrame([], ROW)
    known = F.when(F.col("split") != "unknown", F.struct("run", "split"))
    each = rows.groupBy("dataset", "sample_id").agg(
        F.min("run").alias("first_seen_run"), F.coalesce(F.min(known)["split"], F.lit("unknown")).alias("split"), F.array_sort(F.collect_set("method")).alias("methods_seen"),
        F.coalesce(F.max("result_exposed"), F.lit(False)).alias("result_exposed"), F.coalesce(F.max("per_question_exposed"), F.lit(False)).alias("per_question_exposed"),
    )
    return each.withColumn("status", contamination(F.col("split"), F.col("result_exposed") | F.col("per_question_exposed")))


def untouched(samples: DataFrame, registry: DataFrame) -> DataFrame:
    """The samples (dataset, sample_id, ...) that no run has seen."""
    return samples.join(registry.select("dataset", "sample_id"), ["dataset", "sample_id"], "left_anti")
