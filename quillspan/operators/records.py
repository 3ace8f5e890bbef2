"""Run records as wide rows: metrics by schema version, derived ratios, column reports, arms side by side, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A share: its name, what is counted, and the metrics that its whole is the sum of.
Ratio = tuple[str, str, list[str]]
#: The shares that reports derive from counters.
RATIOS: list[Ratio] = [
    ("cache_hit_rate", "cache_hits", ["cache_hits", "cache_misses"]),
    ("index_cache_hit_rate", "index_cache_hits", ["index_cache_hits", "index_cache_misses"]),
    ("materialization_reuse_rate", "materialization_cache_hits", ["materialization_requests"]),
]


def flat_records(records: DataFrame, metrics: list[str], since: dict[str, int], ratios: list[Ratio] = RATIOS, map_column: str = "metrics", version: str = "schema_version") -> DataFrame:
    """A column for each metric in place of the map, and for each ratio.

    A metric that a record lacks is 0, but null if the record's schema is older than the metric (``since``); a record without a
    version has version 1. A ratio of an empty whole is null.
    """
    v = F.coalesce(F.col(version), F.lit(1))
    cell = lambda m: F.coalesce(F.try_element_at(map_column, F.lit(m)), F.lit(0.0))
    rest = [c for c in records.columns if c not in (map_column, *metrics)]
    shown = [(F.when(v >= since[m], cell(m)) if m in since else cell(m)).alias(m) for m in metrics]
    made = []
    for name, part, whole in ratios:
        total = sum((cell(m) for m in whole), F.lit(0.0))
        made.append(F.when(total > 0, cell(part) / total).alias(name))
    return records.select(*rest, *shown, *made)


def column_report(flat: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Means of the columns in each group, over the records that have them; null where none has."""
    return flat.groupBy(*keys).agg(F.count("*").alias("records"), *[F.avg(c).alias(c) for c in columns])


def arms_side_by_side(rows: DataFrame, keys: list[str], arm: str, arms: list[str], metrics: list[str], strict: bool = True) -> DataFrame:
    """One row for each key with ``metric_arm`` columns; ``strict`` keeps the keys that every arm has.

    Two records of one key and arm are an error: which of them counts would be chance.
    """
    wide = rows.filter(F.col(arm).isin(*arms)).groupBy(*keys).agg(
        *[F.count_if(F.col(arm) == a).alias(f"__n_{a}") for a in arms], *[F.max(F.when(F.col(arm) == a, F.col(m))).alias(f"{m}_{a}") for a in arms for m in metrics]
    )
    counts = [F.col(f"__n_{a}") for a in arms]
    one = F.when(F.greatest(*counts, F.lit(0)) > 1, F.raise_error(F.lit("two records of one key and arm"))).otherwise(F.lit(True))
    kept = wide.filter(one)
    if strict:
        kept = kept.filter(F.least(*counts, F.lit(1)) > 0)
    return kept.select(*keys, *[f"{m}_{a}" for a in arms for m in metrics])


def attempt_gaps(attempts: DataFrame, finals: DataFrame, keys: list[str]) -> DataFrame:
    """Final records (keys, attempt_index) with their attempts (keys, attempt): whether these run from 1 to n and hold the final one.

    Records without attempts are not contiguous.
    """
    seen = attempts.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_distinct("attempt").alias("__d"), F.min("attempt").alias("__low"), F.max("attempt").alias("__high"))
    good: Column = (F.col("__low") == 1) & (F.col("__high") == F.col("attempts")) & (F.col("__d") == F.col("attempts")) & F.col("attempt_index").between(1, F.col("__high"))
    return finals.join(seen, keys, "left").select(*keys, F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce(good, F.lit(False)).alias("contiguous"))


def dataset_audit(records: DataFrame, keys: list[str], stratum: Column, valid: Column, content: Column | None = None) -> DataFrame:
    """Records, invalid ones, a checksum, and a histogram of strata (array of name and count, by name) of each dataset.

    The checksum is the sum of 32 bits of the md5 of every record's ``content`` (0 without): order-free, and sums of parts add up.
    """
    bits = F.lit(0).cast("long") if content is None else F.conv(F.substring(F.md5(F.coalesce(content, F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    by = records.groupBy(*keys, stratum.alias("__s")).agg(F.count("*").alias("__n"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("__bad"), F.sum(bits).alias("__sum"))
    return by.groupBy(*keys).agg(F.sum("__n").alias("records"), F.sum("__bad").alias("invalid_records"), F.sum("__sum").alias("checksum"), F.array_sort(F.collect_list(F.struct(F.col("__s").alias("stratum"), F.col("__n").alias("n")))).alias("strata"))


# ---- records of unknown metrics -------------------------------------------------------------


def metric_cells(lines: DataFrame, since: DataFrame | None = None, roots: dict[str, str] | None = None) -> DataFrame:
    """(record_id, dataset, method, schema_version, name, value): every metric of JSON run records (record_id, value), whatever their names.

    A record is parsed once into a VARIANT. Below each root (path to name prefix) numbers and booleans are cells, objects give
    ``outer.inner`` names, lists their length as ``name_count``; texts and nulls are no metrics. ``since`` (name, version) nulls what a record's schema is too old
    to have measured; a record without a version has version 1.
    """
    roots = roots or {"$.result.metrics": "", "$.scores": "score_", "$.budget": "budget_"}
    v = F.col("__v")
    held = lines.select("record_id", F.try_parse_json("value").alias("__v")).select(
        "record_id", F.try_variant_get(v, "$.dataset", "string").alias("dataset"), F.try_variant_get(v, "$.method", "string").alias("method"), F.coalesce(F.try_variant_get(v, "$.schema_version", "int"), F.lit(1)).alias("schema_version"), "__v"
    )
    struct = "array<struct<name:string,value:double>>"

    def leaf(name: Column, x: Column) -> Column:
        """The cells of one value that is no object."""
        listed, flag, number = F.try_variant_get(x, "$", "array<variant>"), F.schema_of_variant(x) == "BOOLEAN", F.try_variant_get(x, "$", "double")
        text = F.schema_of_variant(x).isin("STRING", "VOID")
        one = lambda n, c: F.array(F.struct(n.alias("name"), c.cast("double").alias("value"))).cast(struct)
        return F.when(listed.isNotNull(), one(F.concat(name, F.lit("_count")), F.size(listed))).when(flag, one(name, F.try_variant_get(x, "$", "boolean").cast("int"))).when(number.isNotNull() & ~text, one(name, number)).otherwise(F.array().cast(struct))

    def cells(prefix: Column, x: Column) -> Column:
        inner = F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
        deep = F.flatten(F.transform(inner, lambda e: leaf(F.concat(prefix, F.lit("."), e["key"]), e["value"])))
        return F.coalesce(deep, leaf(prefix, x))

    parts = [_cells_below(v, path, prefix, cells, struct) for path, prefix in roots.items()]
    out = held.select("record_id", "dataset", "method", "schema_version", F.explode(F.concat(*parts)).alias("c")).select("record_id", "dataset", "method", "schema_version", "c.name", "c.value")
    if since is not None:
        out = out.join(since.select("name", F.col("version").alias("__since")), "name", "left").filter(F.col("schema_version") >= F.coalesce("__since", F.lit(0))).drop("__since")
    return out


def _cells_below(v: Column, path: str, prefix: str, cells, struct: str) -> Column:
    entries = F.map_entries(F.try_variant_get(v, path, "map<string,variant>"))
    return F.coalesce(F.flatten(F.transform(entries, lambda e: cells(F.concat(F.lit(prefix), e["key"]), e["value"]))), F.array().cast(struct))


def metric_report(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, n, mean, low, high) of every metric in each group, by one aggregate, however many metrics there are."""
    return cells.groupBy(*keys, "name").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def metric_columns(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row a record with a column for each of the names; null where it was not measured."""
    return cells.groupBy("record_id", "dataset", "method", "schema_version").pivot("name", names).agg(F.first("value"))
