"""Numeric column expressions of the measurement scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def to_logit(beta: Column, eps: float = 1e-3) -> Column:
    b = clip(beta, eps, 1 - eps)
    return F.log(b) - F.log1p(-b)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def mask_count(n: Column, fraction: float) -> Column:
    """Half-even count of a fraction of n, within 1 .. n - 1."""
    return F.least(F.greatest(F.bround(n * fraction).cast("long"), F.lit(1)), n - 1)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; null where a side is constant or there are fewer than two rows."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def neg_log10(d: Column) -> Column:
    return F.when(d > 0, -F.log10(d))


def spearman_brown(r: Column) -> Column:
    return 2 * r / F.nullif(1 + r, F.lit(0.0))


def ceiling(r1: Column, r2: Column) -> Column:
    """Attenuation ceiling of a correlation between measures of reliabilities r1 and r2."""
    return F.when((r1 >= 0) & (r2 >= 0), F.sqrt(r1 * r2))


def adapter_parameters(d: Column, latent: Column) -> Column:
    return 2 * d + d * latent + latent + 2 * latent


def half_ulp(x: Column) -> Column:
    """Spacing of 16-bit floats around x."""
    return F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(F.nullif(x, F.lit(0.0))))), F.lit(-14)) - 10)
