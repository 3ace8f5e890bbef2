"""Tables in the shared scratch folder, where loops cut their lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only plain local sessions (tests) may run without one."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="quillspan-"))


def written(df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """``df`` written and read back; the table that it replaces is removed."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    if replaces is not None:
        discard(replaces)
    return out


def discard(df: DataFrame) -> None:
    """Remove a scratch table that nothing reads any more."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a task that sorts or groups.
TASK_ROWS = 500_000


def partitions_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """As many partitions as the session deals to, more where a task would get over ``rows`` rows: its memory must not follow the size of the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))
