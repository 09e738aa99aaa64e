"""Multiplicity, bootstrap and permutation over tables of results and of cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def holm(df: DataFrame, p: str, name: str, family: tuple[str, ...] = (), out: str = "p_holm") -> DataFrame:
    """Step-down adjusted p within a family of tests; ties by name; null p stays null and isn't counted."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))  # a family is a handful of tests
    has = df.withColumn("_m", F.count(p).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), name)))
    step = F.when(F.col(p).isNotNull(), (F.col("_m") - F.col("_rn") + 1) * F.col(p))
    run = F.max(step).over(w.orderBy(F.col(p).asc_nulls_last(), name).rowsBetween(Window.unboundedPreceding, 0))
    return has.withColumn(out, F.when(F.col(p).isNotNull(), F.least(run, F.lit(1.0)))).drop("_m", "_rn")


def benjamini_hochberg(df: DataFrame, p: str, name: str, family: tuple[str, ...] = (), out: str = "q") -> DataFrame:
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    has = df.withColumn("_m", F.count(p).over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), name)))
    ratio = F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_rn"))
    run = F.min(ratio).over(w.orderBy(F.col(p).asc_nulls_last(), name).rowsBetween(0, Window.unboundedFollowing))
    return has.withColumn(out, F.when(F.col(p).isNotNull(), F.least(run, F.lit(1.0)))).drop("_m", "_rn")


def two_sided_p(stat: str, null: float = 0.0):
    """min(1, 2 min((1 + below) / (1 + B), (1 + above) / (1 + B))) as an aggregate over replicates."""
    b = F.count(stat)
    below, above = F.count_if(F.col(stat) <= null), F.count_if(F.col(stat) >= null)
    return F.least(F.lit(1.0), 2 * F.least((1 + below) / (1 + b), (1 + above) / (1 + b)))


def block_bootstrap(cells: DataFrame, arm: str, block: str, total: str, count: str, replicates: int, seed: int) -> DataFrame:
    """(arm, replicate, mean): means over blocks drawn with replacement, the same draws for all arms.

    cells has one row of sums for each arm and block: what a replicate needs is its draws times these cells, so an arm's
    blocks (a few dozen) are one small group, however many rows were added up before.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(block)
        rng = np.random.default_rng(seed)
        n = len(pdf)
        weights = rng.multinomial(n, np.full(n, 1 / n), size=replicates)
        sums, counts = weights @ pdf[total].to_numpy(float), weights @ pdf[count].to_numpy(float)
        return pd.DataFrame({arm: pdf[arm].iloc[0], "replicate": np.arange(replicates), "mean": sums / np.where(counts > 0, counts, np.nan)})

    kind = cells.schema[arm].dataType.simpleString()
    return cells.groupBy(arm).applyInPandas(run, f"{arm} {kind}, replicate long, mean double")

