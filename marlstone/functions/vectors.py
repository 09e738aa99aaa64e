"""Expressions over array columns of numbers; higher-order functions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where a norm is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def negative_euclidean(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return -F.sqrt(dot(d, d))


def without_axis(a: Column, axis: Column) -> Column:
    """a less its projection on a unit axis."""
    along = dot(a, axis)
    return F.zip_with(a, axis, lambda x, u: x.cast("double") - along * u)


def is_zero(a: Column) -> Column:
    return ~F.exists(a, lambda x: x != 0)


def is_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == float("inf")))


def paired_pearson(a: Column, b: Column, least: int = 3, floor: float = 1e-12) -> Column:
    """Pearson over the positions where both have a value; null below `least` of them or without variance."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]))
    n = F.size(both)
    sx, sy = total(F.transform(both, lambda p: p["x"])), total(F.transform(both, lambda p: p["y"]))
    sxx = total(F.transform(both, lambda p: p["x"] * p["x"])) - sx * sx / n
    syy = total(F.transform(both, lambda p: p["y"] * p["y"])) - sy * sy / n
    sxy = total(F.transform(both, lambda p: p["x"] * p["y"])) - sx * sy / n
    return F.when((n >= least) & (sxx > floor) & (syy > floor), sxy / F.sqrt(sxx * syy))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def set_cosine(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.sqrt(F.size(a) * F.size(b)), F.lit(0.0))


def padded(a: Column, width: int) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0).cast("float"), F.greatest(F.lit(width) - F.size(a), F.lit(0))))


def argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)).cast("int")
