"""Audits of finished runs: hash chains over attempts, expected cells, and what stands in the way of publishing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def link(previous: Column, payload: Column) -> Column:
    """The chain value of an event: the digest of the value before it and of its own payload."""
    return linked(previous, F.sha2(F.coalesce(payload, F.lit("")), 256))


def linked(previous: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.coalesce(previous, F.lit("")), digest), 256)


def sealed(events: DataFrame, keys: list[str], order: str, payload: str) -> DataFrame:
    """Events with ``place`` (from 1) and ``chain`` in each key's order, folded inside the key's row.

    A key's events must fit a row and be comparable; ``order`` must be unique within a key. The events travel with their order, so they are shuffled once.
    """
    rest = [c for c in events.columns if c not in keys and c != order]
    each = events.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*rest).alias("e")))).alias("x"))
    step = lambda a, x: F.concat(a, F.array(link(F.try_element_at(a, F.lit(-1)), x["e"][payload])))
    chained = each.select(*keys, F.arrays_zip("x", F.aggregate("x", F.array().cast("array<string>"), step).alias("chain")).alias("z")).select(*keys, F.posexplode("z").alias("at", "z"))
    return chained.select(*keys, F.col("z.x.o").alias(order), *[F.col("z.x.e")[c].alias(c) for c in rest], (F.col("at") + 1).alias("place"), F.col("z.chain").alias("chain"))


def chain_breaks(events: DataFrame, keys: list[str], payload: str, block: int = 1000) -> DataFrame:
    """(keys, place, reason) of events (keys, place, chain) that don't follow from the one before: gap, duplicate or digest.

    Events are checked inside blocks of ``block`` places, so a key of any length is spread; a block's first event is checked against the last
    one of the block before. Only these ends, and what is broken, meet by key, and events that are dealt by key stay where they are.
    """
    slim = events.select(*keys, "place", "chain", F.unhex(F.sha2(F.coalesce(payload, F.lit("")), 256)).alias("__d"), F.floor((F.col("place") - 1) / block).alias("__b"))
    by_block, by_key = Window.partitionBy(*keys, "__b").orderBy("place", "chain"), Window.partitionBy(*keys).orderBy("place", "chain")
    held = F.struct("place", "chain")

    def reason(prev: Column) -> Column:
        place = F.coalesce(prev["place"], F.lit(0))
        return F.when(F.col("place") == place, "duplicate").when(F.col("place") != place + 1, "gap").when(~F.col("chain").eqNullSafe(linked(prev["chain"], F.lower(F.hex("__d")))), "digest")

    inside = slim.withColumns({"__own": F.lag(held).over(by_block), "__last": F.lead("place").over(by_block).isNull()})
    inside = inside.withColumn("__why", F.when(F.col("__own").isNotNull(), reason(F.col("__own"))))
    ends = inside.filter("__own IS NULL OR __last OR __why IS NOT NULL").withColumn("__prev", F.lag(held).over(by_key))
    return ends.select(*keys, "place", F.when(F.col("__own").isNull(), reason(F.col("__prev"))).otherwise(F.col("__why")).alias("reason")).filter("reason IS NOT NULL")


def cell_report(expected: DataFrame, items: DataFrame, broken: DataFrame, keys: list[str]) -> DataFrame:
    """(dataset, method, expected, observed, ok, timeouts, broken_traces, complete, blockers) of expected and observed cells.

    ``items``: keys, dataset, method, status. ``broken``: keys of records whose attempts or traces fail. A cell is complete if
    what was expected was observed; cells that nobody expected are reported with 0 expected.
    """
    bad = broken.select(*keys).distinct().withColumn("__bad", F.lit(True))
    seen = items.join(bad, keys, "left").groupBy("dataset", "method").agg(F.count("*").alias("observed"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "question_timeout").alias("timeouts"), F.count_if(F.coalesce("__bad", F.lit(False))).alias("broken_traces"))
    out = expected.join(seen, ["dataset", "method"], "full_outer")
    out = out.select("dataset", "method", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("expected", "observed", "ok", "timeouts", "broken_traces")]).withColumn("complete", F.col("expected") == F.col("observed"))
    blockers = [("unexpected_cell", (F.col("expected") == 0)), ("cell_count_mismatch", (F.col("expected") > 0) & ~F.col("complete")), ("question_timeouts", F.col("timeouts") > 0), ("record_audit_incomplete", F.col("broken_traces") > 0)]
    return out.withColumn("blockers", F.array_join(F.filter(F.array(*[F.when(t, n) for n, t in blockers]), lambda x: x.isNotNull()), ","))
