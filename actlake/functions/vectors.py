"""Column expressions over numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def scale(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def l1_share(value: Column, of: Column) -> Column:
    """|value| as a share of the sum of absolute values; null for an all-zero array."""
    return F.abs(value) / F.nullif(total(F.transform(of, F.abs)), F.lit(0.0))


def head_shares(w: Column, heads: int, width: int) -> Column:
    """L2 norm of each of the heads' blocks of w, divided by their sum."""
    norms = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: norm(F.slice(w, h * width + 1, F.lit(width))))
    return F.transform(norms, lambda n: n / F.nullif(total(norms), F.lit(0.0)))


def zero_suppressed(values: Column, least: float = 1e-6) -> Column:
    """Values whose absolute value is above `least`, rounded to 4 places."""
    return F.transform(F.filter(values, lambda x: F.abs(x) > least), lambda x: F.round(x, 4))


def zero_suppressed_with(ids: Column, values: Column, least: float = 1e-6) -> Column:
    """struct(ids, values): both cut to the places whose absolute value is above `least`, values rounded to 4 places."""
    kept = F.filter(F.zip_with(ids, values, lambda i, v: F.struct(i.alias("i"), v.alias("v"))), lambda x: F.abs(x["v"]) > least)
    return F.struct(F.transform(kept, lambda x: x["i"]).alias("ids"), F.transform(kept, lambda x: F.round(x["v"], 4)).alias("values"))


def max_or_one(values: Column, absolute: bool = False) -> Column:
    """The largest (absolute) value; 1 for an empty or null array."""
    return F.coalesce(F.array_max(F.transform(values, F.abs) if absolute else values).cast("double"), F.lit(1.0))


def argmax(values: Column) -> Column:
    """Place from 0 of the first largest value; null for an empty array."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def finite_or(values: Column, sentinel: float = 0.0) -> Column:
    """NaN, infinite and null entries replaced."""
    return F.transform(values, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(sentinel)).otherwise(v))


def pad(values: Column, n: int, left: bool = True) -> Column:
    """Zeros added up to n entries; a longer array raises."""
    missing = F.array_repeat(F.lit(0.0), F.lit(n) - F.size(values))
    padded = F.concat(missing, values) if left else F.concat(values, missing)
    return F.when(F.size(values) > n, F.raise_error(F.lit("array is longer than its padded size")).cast("array<double>")).otherwise(padded)
