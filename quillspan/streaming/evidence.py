"""Evidence states over a stream of observations (an extension: the batch form is operators.policy.advance)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.policy import observed_rank, status_name


def evidence_states(observations: DataFrame) -> DataFrame:
    """Running status of each requirement; statuses only rise, so the state is one number for each requirement.

    Works on streams (output modes update or complete) and on tables alike.
    """
    rank = observed_rank(F.col("covered"), F.col("total"), F.col("any_evidence"))
    return observations.groupBy("requirement_id").agg(F.max(rank).alias("rank"), F.count("*").alias("observations")).select("requirement_id", status_name(F.col("rank")).alias("status"), "observations")


def attempts_by_window(attempts: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Runs and successes of each method by event-time window, with a watermark for late attempts."""
    return attempts.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "method").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "ok").alias("ok")).select(F.col("w.start").alias("window_start"), "method", "runs", "ok")
