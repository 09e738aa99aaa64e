"""Ridge from a vector to a profile in raw, centred and level form, its train-mean baseline, and scores from sums by block.

A profile is an array of one width (groups, few); rows whose profile is null, short of a value or not finite are incomplete
and take no part. Folds and blocks are few. Rows aren't bounded: every fit and score comes from sums over them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vectors
from marlstone.operators import probes

KINDS = ("raw", "centred", "level")


def complete(df: DataFrame, profile: str) -> DataFrame:
    p = F.col(profile)
    return df.where(p.isNotNull() & (F.size(p) > 0) & vectors.is_finite(p))


def forms(profile: Column) -> dict[str, Column]:
    """The profile itself, its shape (less its own mean) and its mean, as arrays."""
    level = vectors.total(profile) / F.size(profile)
    return {"raw": F.transform(profile, lambda v: v.cast("double")), "centred": F.transform(profile, lambda v: v.cast("double") - level), "level": F.array(level)}


def fitted(df: DataFrame, x: str, profile: str, fold: str, alphas) -> tuple[DataFrame, dict, dict]:
    """(complete rows with columns <kind> and <kind>_oof, coefficients by fold, alphas by fold): all kinds from one set of sums."""
    rows = complete(df, profile).where(F.col(x).isNotNull() & F.col(fold).isNotNull()).withColumns(forms(F.col(profile)))
    joint = rows.withColumn("_y", F.concat(*KINDS))
    b, alpha = probes.blocked_ridge(probes.sums(joint, x, "_y", fold), alphas)
    told = probes.predicted(rows, x, fold, b, "_oof")
    width = F.size("raw")
    cut = {"raw": F.slice("_oof", F.lit(1), width), "centred": F.slice("_oof", width + 1, width), "level": F.slice("_oof", 2 * width + 1, F.lit(1))}
    return told.withColumns({f"{k}_oof": c for k, c in cut.items()}).drop("_oof"), b, alpha


def train_means(df: DataFrame, y: str, fold: str) -> DataFrame:
    """(fold, mean): for each fold the mean array of the other folds' rows; a row a fold. Null where no other fold has rows."""
    cells = df.select(F.col(fold).alias("fold"), F.posexplode(y).alias("k", "v")).groupBy("fold", "k").agg(F.sum("v").alias("s"), F.count("v").alias("n"))
    whole = cells.groupBy("k").agg(F.sum("s").alias("_s"), F.sum("n").alias("_n"))  # a row a position
    rest = cells.join(whole, "k").select("fold", "k", ((F.col("_s") - F.col("s")) / F.nullif(F.col("_n") - F.col("n"), F.lit(0))).alias("m"))
    return rest.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("mean"))


def against_train_mean(df: DataFrame, y: str, fold: str, name: str = "baseline") -> DataFrame:
    """df with the array that the other folds' mean predicts for a row of its fold."""
    means = train_means(df, y, fold).select(F.col("fold").alias(fold), F.col("mean").alias(name))
    return df.join(F.broadcast(means), fold)  # a row a fold


def block_sums(df: DataFrame, y: str, p: str, block: str) -> DataFrame:
    """(block, k, n, sy, sp, syy, spp, syp, sse): the sums of measured y and predicted p of each position, by block."""
    a, b = F.col("c.y").cast("double"), F.col("c.p").cast("double")
    cells = df.select(F.col(block).alias("block"), F.posexplode(F.arrays_zip(F.col(y).alias("y"), F.col(p).alias("p"))).alias("k", "c"))
    add = {"n": F.count("*"), "sy": F.sum(a), "sp": F.sum(b), "syy": F.sum(a * a), "spp": F.sum(b * b), "syp": F.sum(a * b), "sse": F.sum((a - b) ** 2)}
    return cells.groupBy("block", "k").agg(*(e.alias(n) for n, e in add.items()))


def block_correlations(df: DataFrame, y: str, p: str, block: str) -> DataFrame:
    """(block, r_sum, r_n): the rows' own Pearson of y and p, added up where it is defined."""
    r = vectors.paired_pearson(F.col(y), F.col(p), least=2, floor=0.0)
    return df.select(F.col(block).alias("block"), r.alias("r")).groupBy("block").agg(F.sum("r").alias("r_sum"), F.count("r").alias("r_n"))


def scores(df: DataFrame, y: str, p: str, block: str, blocks: list, draws: np.ndarray | None = None) -> dict[str, tuple[float, np.ndarray]]:
    """metric -> (value, its replicates under draws of blocks): r2_global, r2_macro, pearson_pooled, pearson_mean.

    Sums of blocks x positions come to the driver; a draw weighs them, so B replicates cost no further pass.
    """
    place = {b: i for i, b in enumerate(blocks)}
    rows = block_sums(df, y, p, block).collect()
    g = 1 + max((r.k for r in rows), default=0)
    names = ("n", "sy", "sp", "syy", "spp", "syp", "sse")
    held = np.zeros((len(names), len(blocks), g))
    for r in rows:
        held[:, place[r.block], r.k] = [r[n] for n in names]
    own = np.zeros((2, len(blocks)))
    for r in block_correlations(df, y, p, block).collect():
        own[:, place[r.block]] = [r.r_sum or 0.0, r.r_n]
    m = np.vstack([np.ones((1, len(blocks))), np.zeros((0, len(blocks))) if draws is None else draws])
    n, sy, sp, syy, spp, syp, sse = (m @ v for v in held)
    with np.errstate(invalid="ignore", divide="ignore"):
        sst = syy - sy**2 / n
        t = n.sum(1)
        cov = syp.sum(1) - sy.sum(1) * sp.sum(1) / t
        vy, vp = syy.sum(1) - sy.sum(1) ** 2 / t, spp.sum(1) - sp.sum(1) ** 2 / t
        out = {
            "r2_global": 1 - sse.sum(1) / sst.sum(1),
            "r2_macro": np.mean(1 - sse / sst, axis=1),
            "pearson_pooled": np.where((vy > 0) & (vp > 0), cov / np.sqrt(vy * vp), np.nan),
            "pearson_mean": np.where(m @ own[1] > 0, (m @ own[0]) / (m @ own[1]), np.nan),
        }
    return {k: (float(v[0]), v[1:]) for k, v in out.items()}


def global_level(df: DataFrame, profile: str) -> DataFrame:
    """One row (level): the mean of each position over the rows that have it."""
    cells = df.select(F.posexplode(profile).alias("k", "v")).where("v is not null and not isnan(v)").groupBy("k").agg(F.avg("v").alias("m"))
    return cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("level"))  # as wide as a profile


def r2_with_level(df: DataFrame, profile: str, name: str = "r2") -> DataFrame:
    """df with the squared Pearson of each profile and the global level; null under three values or without variance."""
    r = vectors.paired_pearson(F.col(profile), F.col("level"), least=3, floor=0.0)
    return df.crossJoin(F.broadcast(global_level(df, profile))).withColumn(name, r * r).drop("level")
