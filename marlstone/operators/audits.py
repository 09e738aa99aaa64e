"""Audits of one table against another: mappings, recomputed values, snapshots of trees, tails of curves, verdicts, grids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import maths
from marlstone.operators import probes
from marlstone.operators.contracts import require_unique


def mapping_audit(used: DataFrame, published: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, problem): a row for each fault. `unmatched`: the published table lacks a used key; `extra`: nobody uses a
    published key; `<column>_mismatch`: both have it with unlike values (nulls are alike). Keys are unique on both sides
    and not null, else an error.
    """
    for side, df in (("used", used), ("published", published)):
        if not df.where(F.col(key).isNull()).isEmpty():
            raise ValueError(f"{key} of the {side} table is null in some rows")
    a = require_unique(used.select(key, *columns), key).withColumn("_u", F.lit(True))
    b = require_unique(published.select(key, *(F.col(c).alias(f"_p_{c}") for c in columns)), key).withColumn("_p", F.lit(True))
    both = F.col("_u") & F.col("_p")
    faults = [F.when(F.col("_p").isNull(), "unmatched"), F.when(F.col("_u").isNull(), "extra")]
    faults += [F.when(both & ~F.col(c).eqNullSafe(F.col(f"_p_{c}")), f"{c}_mismatch") for c in columns]
    return a.join(b, key, "full").select(key, F.explode(F.array_compact(F.array(*faults))).alias("problem"))


def half_precision(x: Column) -> Column:
    """x rounded to 16 bits with ties to even, as a double; null stays null. Beyond the largest (65,504) nothing is cut."""
    ulp = maths.half_ulp(x)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.rint(x / ulp) * ulp)


def midpoint_distance(x: Column) -> Column:
    """How far x is from the nearest point halfway between two 16-bit values, in units of their spacing (0 to 0.5)."""
    at = x / maths.half_ulp(x)
    return F.when(x == 0, F.lit(0.5)).otherwise(F.abs(at - F.floor(at) - 0.5))


def value_diff(fresh: DataFrame, frozen: DataFrame, keys: list[str], value: str, slack: float = 1e-6) -> DataFrame:
    """One row: cells with both values, cells where only one side has a value, and how far the frozen 16-bit values are.

    A cell that a side lacks counts as null there. Figures of differences are 0 without cells. NaN counts as no value.
    """
    known = lambda c: F.when(~F.isnan(c), c)
    a = fresh.select(*keys, known(F.col(value).cast("double")).alias("_a"))
    b = frozen.select(*keys, known(F.col(value).cast("double")).alias("_b"))
    x, y = F.col("_a"), F.col("_b")
    d, ok = F.abs(x - y), x.isNotNull() & y.isNotNull()
    ulp = F.when(x == 0, F.lit(2.0**-24)).otherwise(maths.half_ulp(x))
    return a.join(b, keys, "full").agg(
        F.count_if(ok).alias("n_cells"),
        F.count_if(x.isNull() != y.isNull()).alias("pattern_mismatch"),
        F.coalesce(F.max(d), F.lit(0.0)).alias("max_abs_diff"),
        F.coalesce(F.max(d / ulp), F.lit(0.0)).alias("max_diff_in_ulp"),
        F.count_if(ok & (d > ulp / 2 + slack)).alias("beyond_half_ulp"),
        F.count_if(ok & (half_precision(x) != y)).alias("rounding_mismatch"),
    )


def tree_diff(before: DataFrame, after: DataFrame, path: str = "path", digest: str = "digest") -> DataFrame:
    """(path, state): added, removed, changed or same, of two snapshots (path, digest) with unique paths."""
    a = require_unique(before.select(path, F.col(digest).alias("_a")), path).withColumn("_in_a", F.lit(True))
    b = require_unique(after.select(path, F.col(digest).alias("_b")), path).withColumn("_in_b", F.lit(True))
    state = F.when(F.col("_in_b").isNull(), "removed").when(F.col("_in_a").isNull(), "added").when(F.col("_a").eqNullSafe(F.col("_b")), "same").otherwise("changed")
    return a.join(b, path, "full").select(path, state.alias("state"))


def tail_gaps(curves: DataFrame, arm: str, run: str, step: str, values: list[str], reference: str, last: int) -> DataFrame:
    """(arm, run, metric, n_steps, gap, relative, sign_stable): each other arm less the reference over the last steps that
    both have. A step of a run and arm stands once. sign_stable: all gaps are above 0, or all below.
    """
    from pyspark.sql import Window

    ref = curves.where(F.col(arm) == reference).select(run, step, *(F.col(v).alias(f"_r_{v}") for v in values))
    common = curves.where(F.col(arm) != reference).join(ref, [run, step])
    # the steps of one curve, a small table by nature; a window of it holds one arm and run
    tail = common.withColumn("_k", F.row_number().over(Window.partitionBy(arm, run).orderBy(F.desc(step)))).where(F.col("_k") <= last)
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), (F.col(v) - F.col(f"_r_{v}")).alias("gap"), F.col(f"_r_{v}").alias("ref")) for v in values)))
    rows = tail.select(arm, run, each.alias("m")).select(arm, run, "m.*")
    return rows.groupBy(arm, run, "metric").agg(
        F.count("*").alias("n_steps"),
        F.avg("gap").alias("gap"),
        (F.avg("gap") / F.nullif(F.avg("ref"), F.lit(0.0))).alias("relative"),
        (F.coalesce(F.max("gap") < 0, F.lit(False)) | F.coalesce(F.min("gap") > 0, F.lit(False))).alias("sign_stable"),
    )


def contrast_category(primary: Column, delta: Column, lo: Column, hi: Column) -> Column:
    """same_sign, flip_unresolved (the interval holds 0) or flip_resolved; null without a delta."""
    flips = F.signum(primary) != F.signum(delta)
    return F.when(primary.isNull() | delta.isNull(), None).when(~flips, "same_sign").when((lo > 0) | (hi < 0), "flip_resolved").otherwise("flip_unresolved")


def verdict(category: Column) -> Column:
    """As an aggregate over a stratum's contrasts: CHANGES with a resolved flip, else WEAKENS with any flip, else CONFIRMS."""
    return F.when(F.max(category == "flip_resolved"), "CHANGES").when(F.max(category == "flip_unresolved"), "WEAKENS").otherwise("CONFIRMS")


def edge_report(chosen, grid, share: float) -> dict:
    """Shares of the chosen penalties at either end of the grid, and whether they reach `share`."""
    a, g = np.asarray(chosen, float).ravel(), np.asarray(grid, float)
    top, bottom = (float((a == end).mean()) if a.size else 0.0 for end in (g.max(), g.min()))
    return {"n": int(a.size), "at_max": top, "at_min": bottom, "hit_max": top >= share, "hit_min": bottom >= share}


def wider_grid(grid, reports: list[dict], done: int, most: int = 2, decades: int = 2) -> tuple[tuple[float, ...], bool]:
    """(grid, whether it grew): by decades at each end that any arm's report hits, `most` times at most."""
    g = sorted(float(v) for v in grid)
    up, down = any(r["hit_max"] for r in reports), any(r["hit_min"] for r in reports)
    if done >= most or not (up or down):
        return tuple(g), False
    lower = [g[0] / 10.0**k for k in range(decades, 0, -1)] if down else []
    upper = [g[-1] * 10.0**k for k in range(1, decades + 1)] if up else []
    return tuple(lower + g + upper), True


def ridge_on_growing_grid(arms: dict[str, dict], grid, share: float = 0.05) -> tuple[tuple[float, ...], int, dict[str, tuple[dict, dict]], dict[str, dict]]:
    """(grid, extensions, fits by arm, reports by arm): blocked ridge of all arms on one grid, refitted while any arm hits an end.

    arms hold the sums of each fold (`probes.sums`), so a refit takes no further pass over the rows.
    """
    done, grid = 0, tuple(sorted(float(v) for v in grid))
    while True:
        fits = {name: probes.blocked_ridge(parts, grid) for name, parts in arms.items()}
        reports = {name: edge_report(np.concatenate([np.atleast_1d(a) for a in alpha.values()]), grid, share) for name, (_b, alpha) in fits.items()}
        grid_, grew = wider_grid(grid, list(reports.values()), done)
        if not grew:
            return grid, done, fits, reports
        grid, done = grid_, done + 1


def effective_ranks(parts: dict[int, probes.Sums], centred: bool) -> dict[str, float]:
    """Participation ratio and exponential of the entropy of the spectrum, from summed products (`probes.sums`)."""
    s = probes.total(parts.values())
    mean = s.xx[-1, :-1] / s.n
    c = s.xx[:-1, :-1] / s.n - (np.outer(mean, mean) if centred else 0.0)
    lam = np.clip(np.linalg.eigvalsh(c), 0, None)
    lam = lam[lam > lam.max(initial=0.0) * 1e-14]
    if not lam.size:
        return {"participation": float("nan"), "entropy_rank": float("nan")}
    p = lam / lam.sum()
    return {"participation": float(1 / (p**2).sum()), "entropy_rank": float(np.exp(-(p * np.log(p)).sum()))}
