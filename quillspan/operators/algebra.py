"""The plan algebra over binding rows.

A frame of rows has one string column for each variable (null: the variable is absent) and ``pos``,
its place in the row order. ``pos`` may be of any orderable type: sorting rewrites it as a struct of
the sort key and the old place, so a sort by itself moves no data, and whatever depends on order later
(a limit, the first row, the first of equal rows) asks for the least ``pos``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import compare, date, fold, number, ordered, render

META = ["_slot_id", "_source_id", "_source_span", "_confidence", "_retrieval_score"]


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "pos" and not c.startswith("_")]


# ---- filter, project, distinct --------------------------------------------------------------


def filter_rows(df: DataFrame, field: str, value: str, comparator: str = "eq") -> DataFrame:
    return df.filter(F.col(field).isNotNull() & compare(F.col(field), F.lit(value), comparator))


def project(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[f for f in fields if f in df.columns], "pos")


def distinct_on(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """The first row of each combination of the fields (all if none are named; absent counts as empty)."""
    keys = [F.coalesce(F.col(f), F.lit("")) if f in df.columns else F.lit("") for f in (fields or sorted(variables(df)))]
    rest = [c for c in df.columns if c != "pos"]
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    first = df.groupBy(*named).agg(F.min_by(F.struct(*rest), "pos").alias("r"), F.min("pos").alias("pos"))
    return first.select("r.*", "pos")


def output_rows(df: DataFrame, outputs: list[str]) -> DataFrame:
    """A plan's output columns; absent cells are empty."""
    names = [o.removeprefix("?") for o in outputs]
    return df.select(*[(F.coalesce(F.col(n), F.lit("")) if n in df.columns else F.lit("")).alias(n) for n in names], "pos")


# ---- aggregates and order -------------------------------------------------------------------


def count_rows(df: DataFrame, output: str = "count") -> DataFrame:
    return df.agg(F.count("*").cast("string").alias(output)).withColumn("pos", F.lit(0))


def any_rows(df: DataFrame, output: str = "answer") -> DataFrame:
    return df.agg(_bool(F.count("*") > 0).alias(output)).withColumn("pos", F.lit(0))


def _bool(c: Column) -> Column:
    return F.when(c, "True").otherwise("False")


def sort_place(df: DataFrame, field: str, descending: bool = False) -> Column:
    """Numbers before text, by value, ties in the order so far; ``descending`` turns all but the ties around."""
    c = F.coalesce(F.col(field), F.lit("")) if field in df.columns else F.lit("")
    n = number(c)
    text = F.when(n.isNull(), fold(c))
    if descending:  # inverted hex digits with an end mark sort in the reverse order of the text
        text = F.concat(F.translate(F.hex(F.encode(text, "utf-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
        return F.struct(n.isNotNull().alias("kind"), (-n).alias("n"), text.alias("t"), F.col("pos").alias("p"))
    return F.struct(n.isNull().alias("kind"), n.alias("n"), text.alias("t"), F.col("pos").alias("p"))


def sort_rows(df: DataFrame, field: str, descending: bool = False, limit: int | None = None) -> DataFrame:
    out = df.withColumn("pos", sort_place(df, field, descending))
    return out.orderBy("pos").limit(limit) if limit else out


def extreme_row(df: DataFrame, field: str, largest: bool) -> DataFrame:
    """The one row with the least (greatest) field; rows without it do not count; the first of ties."""
    have = df.filter(F.col(field).isNotNull())
    place = sort_place(df, field, largest)
    rest = [c for c in df.columns if c != "pos"]
    one = have.agg(F.min_by(F.struct(*rest), place).alias("r"), F.min_by("pos", place).alias("pos"))
    return one.filter("r IS NOT NULL").select("r.*", "pos")


def field_extremum(df: DataFrame, fields: list[str], labels: list[str], largest: bool, output: str = "answer") -> DataFrame:
    """The label of the field that is extreme in every row; nothing if a row abstains or rows disagree.

    A row abstains if a field is neither a date nor a number, kinds differ, or the extreme is tied.
    """
    parsed = F.array(*[ordered(F.col(f) if f in df.columns else F.lit(None).cast("string")) for f in fields])
    values = F.transform(parsed, lambda s: s["value"])
    best = F.array_max(values) if largest else F.array_min(values)
    usable = ~F.exists(parsed, lambda s: s.isNull()) & (F.size(F.array_distinct(F.transform(parsed, lambda s: s["kind"]))) == 1)
    single = F.size(F.filter(values, lambda v: v == best)) == 1
    label = F.when(usable & single, F.get(F.array(*map(F.lit, labels)), F.array_position(values, best).cast("int") - 1))
    if len(fields) != len(labels):
        label = F.lit(None).cast("string")
    one = df.select(label.alias("l")).agg(F.count("*").alias("n"), F.count("l").alias("k"), F.min("l").alias("lo"), F.max("l").alias("hi"))
    return one.filter("n > 0 AND n = k AND lo = hi").select(F.col("lo").alias(output), F.lit(0).alias("pos"))


def _first_row(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row with the fields of the first row (all null if there is none) and whether there is one."""
    have = [(F.col(f) if f in df.columns else F.lit(None).cast("string")).alias(f"f{i}") for i, f in enumerate(fields)]
    return df.agg(F.min_by(F.struct(F.lit(1).alias("row"), *have), "pos").alias("r")).select("r.*")


def compare_fields(df: DataFrame, fields: list[str], comparator: str = "eq", output: str = "comparison") -> DataFrame:
    """Compare two fields of the first row; False if there is no row."""
    if len(fields) < 2:
        return df.agg(F.lit("False").alias(output)).withColumn("pos", F.lit(0))
    one = _first_row(df, fields[:2])
    test = compare(F.coalesce("f0", F.lit("")), F.coalesce("f1", F.lit("")), comparator)
    return one.select(_bool(F.col("row").isNotNull() & test).alias(output), F.lit(0).alias("pos"))


def arithmetic(df: DataFrame, fields: list[str], operation: str, output: str = "result") -> DataFrame:
    """add, subtract, multiply or divide fields of the first row, or date_diff_months of two; nothing if a field does not parse."""
    one = _first_row(df, fields)
    if operation == "date_diff_months":
        a, b = (date(F.col(f"f{i}")) for i in (0, 1)) if len(fields) == 2 else (F.lit(None).cast("date"),) * 2
        out = ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("string")
    else:
        x = [number(F.col(f"f{i}")) for i in range(len(fields))]
        out = F.lit(None).cast("string")
        if len(x) >= 2 and operation in {"add", "subtract", "multiply", "divide"}:
            total = x[0]
            for v in x[1:]:
                total = {"add": total + v, "subtract": total - v, "multiply": total * v}.get(operation, F.try_divide(total, v))
            out = render(total)
    return one.select(out.alias(output), F.lit(0).alias("pos")).filter(F.col(output).isNotNull())


def apply_operators(df: DataFrame, operators: list) -> DataFrame:
    """Run a plan's operators in order."""
    for op in operators:
        k = op.kind
        if k == "filter":
            df = filter_rows(df, op.field, op.value, op.comparator or "eq")
        elif k == "project":
            df = project(df, op.fields)
        elif k == "intersect":
            df = distinct_on(df, op.fields)
        elif k == "count":
            df = count_rows(df, op.output or "count")
        elif k == "sort":
            df = sort_rows(df, op.field, op.descending, op.limit)
        elif k in {"argmin", "argmax"}:
            df = extreme_row(df, op.field, k == "argmax")
        elif k in {"field_argmin", "field_argmax"}:
            df = field_extremum(df, op.fields, op.labels, k == "field_argmax", op.output or "answer")
        elif k == "compare":
            df = compare_fields(df, op.fields, op.comparator or "eq", op.output or "comparison")
        elif k == "boolean":
            df = any_rows(df, op.output or "answer")
        else:
            df = arithmetic(df, op.fields, op.operation, op.output or "result")
    return df


# ---- joins ----------------------------------------------------------------------------------


def _joined(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Common columns of a left (alias l) and right (alias r) row that agree on all variables that both have."""
    shared = [v for v in variables(left) if v in variables(right)]
    for v in shared:
        pairs = pairs.filter(F.col(f"l.{v}").isNull() | F.col(f"r.{v}").isNull() | (F.col(f"l.{v}") == F.col(f"r.{v}")))
    cols = [F.coalesce(f"l.{v}", f"r.{v}").alias(v) if v in shared else F.col(f"l.{v}") for v in variables(left)]
    cols += [F.col(f"r.{v}") for v in variables(right) if v not in shared]
    if all(m in left.columns and m in right.columns for m in META):
        zero = F.lit(0.0)
        cols += [
            F.concat_ws("+", "l._slot_id", "r._slot_id").alias("_slot_id"),
            F.concat_ws("|", "l._source_id", "r._source_id").alias("_source_id"),
            F.concat_ws("\n---\n", "l._source_span", "r._source_span").alias("_source_span"),
            F.least("l._confidence", "r._confidence").alias("_confidence"),
            F.least(F.coalesce("l._retrieval_score", zero), F.coalesce("r._retrieval_score", zero)).alias("_retrieval_score"),
        ]
    return pairs.select(*cols, F.struct(F.col("l.pos").alias("l"), F.col("r.pos").alias("r")).alias("pos"))


def join_rows(left: DataFrame, right: DataFrame, left_field: str, right_field: str) -> DataFrame:
    """Inner equi-join; empty and absent keys never match, other shared variables must not conflict."""
    l, r = left.filter(F.col(left_field) != "").alias("l"), right.filter(F.col(right_field) != "").alias("r")
    return _joined(l.join(r, F.col(f"l.{left_field}") == F.col(f"r.{right_field}")), left, right)


def bridge_rows(left: DataFrame, right: DataFrame, most: int = 1000) -> DataFrame:
    """All pairs of two small branches that an extremum operator compares.

    The smaller branch must have at most ``most`` rows: this is checked, and only then is it broadcast.
    """
    if right.limit(most + 1).count() <= most:
        return _joined(left.alias("l").crossJoin(F.broadcast(right).alias("r")), left, right)
    if left.limit(most + 1).count() <= most:
        return _joined(F.broadcast(left).alias("l").crossJoin(right.alias("r")), left, right)
    raise ValueError(f"both branches of a bridge have over {most} rows; add a join")


def late_join(frames: list[DataFrame], joins: list[tuple[int, str, int, str]]) -> DataFrame:
    """Join materialised slots in order, each by the first join that connects it."""
    out, inside = frames[0], {0}
    for i in range(1, len(frames)):
        hit = next((j for j in joins if (j[0] in inside and j[2] == i) or (j[2] in inside and j[0] == i)), None)
        if hit is None:
            raise ValueError(f"slot {i} has no join path")
        lf, rf = (hit[1], hit[3]) if hit[2] == i else (hit[3], hit[1])
        out = join_rows(out, frames[i], lf, rf)
        inside.add(i)
    return out


def binding_contexts(current: DataFrame, shared: list[str], limit: int) -> DataFrame:
    """The first ``limit`` distinct bindings of the shared variables, by first appearance: a semi-join reducer."""
    have = current.filter(" AND ".join(f"`{v}` <> ''" for v in shared))
    return have.groupBy(*shared).agg(F.min("pos").alias("pos")).orderBy("pos").limit(limit)


# ---- set operations on binding rows ---------------------------------------------------------


def _bindings_key(df: DataFrame) -> list[Column]:
    return [F.col("_source_id"), *[F.col(v) for v in sorted(variables(df))]]


def merge_bindings(rows: DataFrame, additions: DataFrame) -> DataFrame:
    """Of rows with the same source and bindings the most confident (then best scored) stays, at the first place."""
    side = [d.withColumn("pos", F.struct(F.lit(i).alias("part"), F.col("pos").alias("p"))) for i, d in enumerate((rows, additions))]
    both = side[0].unionByName(side[1], allowMissingColumns=True)
    rank = F.struct(F.col("_confidence"), F.coalesce("_retrieval_score", F.lit(0.0)).alias("s"))
    w = Window.partitionBy(*_bindings_key(both))
    best = both.withColumns({"__first": F.min("pos").over(w), "__n": F.row_number().over(w.orderBy(rank.desc(), "pos"))})
    return best.filter("__n = 1").withColumn("pos", F.col("__first")).drop("__first", "__n")


def first_bindings(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """The first row of each (source, bindings[, extra columns])."""
    w = Window.partitionBy(*_bindings_key(df), *[F.col(c) for c in extra or []]).orderBy("pos")
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def multiset_overlap(df: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Counts in both, only left and only right of two multisets given as counts per key."""
    l, r = F.coalesce(left, F.lit(0)), F.coalesce(right, F.lit(0))
    return df.select(key, F.least(l, r).alias("both"), F.greatest(l - r, F.lit(0)).alias("only_left"), F.greatest(r - l, F.lit(0)).alias("only_right"))
