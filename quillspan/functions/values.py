"""Typed reading of string cells: numbers, dates, mixed comparison, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
_ORDINAL = r"(?i)\b(\d{1,2})(st|nd|rd|th)\b"


def fold(c: Column) -> Column:
    """Caseless form; the sharp s is the one letter of our texts that lower() leaves alone."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def number(c: Column) -> Column:
    """The cell as a double, or null. Commas are dropped; digit groups may use underscores; inf and nan count."""
    s = F.trim(F.replace(c, F.lit(","), F.lit("")))
    word = F.lower(F.regexp_replace(s, r"^[+-]", ""))
    sign = F.when(s.startswith("-"), -1.0).otherwise(1.0)
    plain = F.when(s.rlike(_NUMBER), F.replace(s, F.lit("_"), F.lit(""))).try_cast("double")
    return F.when(word == "nan", F.lit(float("nan"))).when(word.isin("inf", "infinity"), sign * F.lit(float("inf"))).otherwise(plain)


def date(c: Column) -> Column:
    """The cell as a date, or null: ISO with - or /, day month year, month day year (full or short names), or a four-digit year."""
    s = F.regexp_replace(F.replace(F.regexp_replace(F.trim(c), _ORDINAL, "$1"), F.lit(","), F.lit("")), r"\s+", " ")
    named = F.initcap(F.lower(s))

    def parsed(text: Column, shape: str, *formats: str) -> Column:
        held = F.when(s.rlike(shape), text)
        return F.coalesce(*[F.try_to_timestamp(held, F.lit(f)) for f in formats])

    return F.coalesce(
        parsed(s, r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
        parsed(s, r"^\d{4}/\d{1,2}/\d{1,2}$", "y/M/d"),
        parsed(named, r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM y", "d MMM y"),
        parsed(named, r"^[A-Za-z]+ \d{1,2} \d{4}$", "MMMM d y", "MMM d y"),
        parsed(s, r"^\d{4}$", "y"),
    ).cast("date")


def ordered(c: Column) -> Column:
    """struct(kind, value): a date as days, else a number; null where the cell is neither."""
    d, n = date(c), number(c)
    return F.when(d.isNotNull(), F.struct(F.lit("date").alias("kind"), F.unix_date(d).cast("double").alias("value"))).when(n.isNotNull(), F.struct(F.lit("number").alias("kind"), n.alias("value")))


def float_text(x: Column) -> Column:
    """A double as Python prints it, for magnitudes from 1e-3 up to 1e16."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e16)
    return F.when(whole, F.format_string("%.1f", x)).otherwise(x.cast("string"))


def render(x: Column) -> Column:
    """Whole numbers without a point, others with at most ten decimals and no trailing zeros."""
    size = F.abs(x)
    part = size - F.floor(size)  # exact, so its ten decimals are those of the exact value
    carry = part >= 0.99999999995
    whole = (F.floor(size) + F.when(carry, 1).otherwise(0)).cast("decimal(38,0)").cast("string")
    decimals = F.regexp_replace(F.substring(F.format_string("%.10f", F.when(carry, 0.0).otherwise(part)), 2, 11), r"\.?0+$", "")
    text = F.concat(whole, decimals)
    signed = F.when((x < 0) & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)
    return F.when(F.isnan(x) | (size == float("inf")), F.lit(None)).when(size >= 2.0**53, x.cast("decimal(38,0)").cast("string")).otherwise(signed)


def compare(left: Column, right: Column, comparator: str = "eq") -> Column:
    """Compare two cells: as numbers if both are numbers, else as caseless text; null cells never compare true."""
    a, b = number(left), number(right)
    numeric = a.isNotNull() & b.isNotNull()
    if comparator == "contains":
        hay = F.when(numeric, float_text(a)).otherwise(fold(left))
        return F.coalesce(F.contains(hay, F.when(numeric, float_text(b)).otherwise(fold(right))), F.lit(False))
    test = {"eq": lambda x, y: x == y, "ne": lambda x, y: x != y, "lt": lambda x, y: x < y, "le": lambda x, y: x <= y, "gt": lambda x, y: x > y, "ge": lambda x, y: x >= y}[comparator]
    odd = F.isnan(a) | F.isnan(b)  # as in IEEE arithmetic, nan differs from everything
    return F.coalesce(F.when(numeric, F.when(odd, F.lit(comparator == "ne")).otherwise(test(a, b))).otherwise(test(fold(left), fold(right))), F.lit(False))


def typed(c: Column, kind: str, keep_surface: bool = False) -> Column:
    """Normalise a cell to its declared type, or null: number, date (ISO), boolean (yes/no), string."""
    if kind == "number":
        n = number(c)
        ok = n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
        shape = F.regexp_replace(F.format_string("%.10g", n), r"(\.\d*?)0+(e|$)", "$1$2")
        out = F.when(ok, F.when((n == F.rint(n)) & (F.abs(n) < 1e15), n.cast("long").cast("string")).otherwise(F.regexp_replace(shape, r"\.(e|$)", "$1")))
    elif kind == "date":
        out = F.date_format(date(c), "yyyy-MM-dd")
    elif kind == "boolean":
        word = F.lower(F.trim(c))
        out = F.when(word.isin("true", "yes"), "yes").when(word.isin("false", "no"), "no")
    else:
        out = F.nullif(F.trim(c), F.lit(""))
    return F.when(out.isNotNull(), c) if keep_surface else out


def rounded(x: Column, places: int) -> Column:
    """``x`` rounded half away from zero as SQL rounds doubles: by its product with a power of ten, not by its shortest decimal form."""
    return F.round(x * 10.0**places) / 10.0**places


def exact_sum(x: Column) -> Column:
    """Sum of a group of any size as decimals of twelve places: the same double however the rows are dealt. Groups with a value that they can't hold are added up as doubles."""
    d = x.cast("double")
    held = d.try_cast("decimal(28,12)")
    return F.when(F.count(held) == F.count(d), F.sum(held).cast("double")).otherwise(F.sum(d))


def exact_mean(x: Column) -> Column:
    """Mean by ``exact_sum``; nulls do not count."""
    return F.try_divide(exact_sum(x), F.count(x).cast("double"))
