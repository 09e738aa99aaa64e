"""Matched controls: greedy in hash order of the cases, exact strata, calipers, standardised distance.

The order of the cases decides who takes a control, and all controls rank the cases alike, so the result of one loop over the
cases is also the only stable matching: each case proposes to its nearest controls and each control keeps the earliest case
that proposed. Proposals may be made in any order. The axis of the tightest caliper is cut into stretches; a task holds a
stretch's cases and the controls within reach, and settles its proposals in hash order. A control that cases of two
stretches want keeps the earlier one, and the other case proposes again in the next round, which cuts half a
stretch further on, until no case has lost a control.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import cut
from marlstone.operators.lookups import hash_rank

#: Rows of a stretch that is wider than four calipers.
STRETCH = 20_000
#: Relative slack when a window is compared with a border; calipers themselves are compared exactly.
SLACK = 1e-9


@dataclass
class Matches:
    """pairs (case, control, rank, distance), unmatched (case, reason), and the rounds it took.

    distance is the root of the summed squared differences over the pool's standard deviations; rank counts from 0.
    reason: `missing` (a null or non-finite covariate or null stratum), `no_stratum`, `out_of_caliper`, `exhausted` (others took all).
    """

    pairs: DataFrame
    unmatched: DataFrame
    rounds: int


def _settle(numeric: dict[str, float | None], sd: dict[str, float], axis: str | None, n: int, replace: bool):
    """Proposals of one stretch: rows of kind 0 (cases; those with `asks` propose at first) and 1 (pool, with the case it keeps)."""
    cols = list(numeric)
    scale = np.array([sd[c] for c in cols])
    calipers = np.array([np.inf if numeric[c] is None else numeric[c] for c in cols])
    reach, along = (np.inf, None) if axis is None else (numeric[axis] * (1 + SLACK), cols.index(axis))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cases, pool = pdf[pdf.kind == 0].sort_values(["h", "id"], kind="stable"), pdf[pdf.kind == 1]
        if axis is not None:
            pool = pool.sort_values(axis, kind="stable")
            at = pool[axis].to_numpy(float)
        x, h, ids = [np.ascontiguousarray(pool[c], float) for c in cols], pool.h.to_numpy(), pool.id.to_numpy()
        # places in the order of all cases seen here; a control without a case has a place behind them all
        known = pool.kept_h.notna().to_numpy()
        order = pd.concat([cases[["h", "id"]].astype({"h": "int64"}), pd.DataFrame({"h": pool.kept_h[known].astype("int64"), "id": pool.kept[known]})]).drop_duplicates().sort_values(["h", "id"], kind="stable")
        place = {key: p for p, key in enumerate(zip(order.h, order.id))}
        kept = np.full(len(pool), len(place), np.int64)
        kept[known] = [place[key] for key in zip(pool.kept_h[known].astype("int64"), pool.kept[known])]
        own, case_ids, case_h, y = [place[key] for key in zip(cases.h, cases.id)], cases.id.to_numpy(), cases.h.to_numpy(), cases[cols].to_numpy(float)
        where = {p: i for i, p in enumerate(own)}
        todo = [i for i, asks in enumerate(cases.asks) if asks]  # sorted, so it is a heap
        queued = set(todo)
        told: dict[int, tuple] = {}
        while todo:
            i = heapq.heappop(todo)
            queued.discard(i)
            lo, hi = (0, len(pool)) if axis is None else (np.searchsorted(at, y[i, along] - reach, "left"), np.searchsorted(at, y[i, along] + reach, "right"))
            inside, d = np.ones(hi - lo, bool), np.zeros(hi - lo)
            for c in range(len(cols)):  # column by column: a window holds many rows and few columns
                diff = np.abs(x[c][lo:hi] - y[i, c])
                if calipers[c] < np.inf:
                    inside &= diff <= calipers[c]
                diff /= scale[c]
                d += diff * diff
            ok = np.flatnonzero(inside if replace else inside & (kept[lo:hi] >= own[i]))
            d = d[ok]
            if len(ok) > n:  # ties with the n-th are kept for the order below
                few = d <= np.partition(d, n - 1)[n - 1]
                ok, d = ok[few], d[few]
            pick = np.lexsort((ids[ok + lo], h[ok + lo], d))[:n]
            chosen = ok[pick] + lo
            told[i] = (chosen, d[pick], inside.any())
            if not replace:
                for late in kept[chosen]:
                    if own[i] < late and late in where and where[late] not in queued:
                        queued.add(where[late])
                        heapq.heappush(todo, where[late])
                kept[chosen] = own[i]
        out = [(case_ids[i], case_h[i], ids[c], h[c], d, bool(near), len(chosen) < n) for i, (chosen, ds, near) in told.items() for c, d in zip(chosen, ds) if replace or kept[c] == own[i]]
        out += [(case_ids[i], case_h[i], None, None, None, bool(near), len(chosen) < n) for i, (chosen, _, near) in told.items()]
        got = pd.DataFrame(out, columns=["case", "case_h", "control", "control_h", "d2", "near", "ended"])
        return got.astype({"case_h": "int64", "control_h": "Int64", "d2": "float64"})

    return run


def match_controls(
    cases: DataFrame, pool: DataFrame, key: str, exact: tuple[str, ...] = (), numeric: dict[str, float | None] | None = None, n: int = 1, seed: int = 0, replace: bool = False
) -> Matches:
    """Up to n controls from pool for each case, nearest first, ties by the hash of id and seed.

    numeric: column -> caliper in raw units, or None. Pool rows that are cases don't count, nor do repeated ids (one row of an id stays).
    A task holds one stretch of one stratum and a caliper on each side: at least four calipers of the axis, or the stratum where no
    column has a caliper. Rows of equal covariates beyond a stretch's share stay together, so a caliper should not span most of a table.
    """
    numeric = numeric or {}
    sound = reduce(Column.__and__, [F.col(c).isNotNull() for c in exact] + [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in numeric], F.lit(True))
    h = F.conv(F.substring(hash_rank(F.col(key).cast("string"), seed=seed), 1, 12), 16, 10).cast("long")
    slim = lambda df: df.dropDuplicates([key]).select(F.col(key).alias("id"), h.alias("h"), *(F.col(c).alias(f"e{i}") for i, c in enumerate(exact)), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(numeric)), sound.alias("sound"))
    cases, pool = cut(slim(cases)), slim(pool)
    pool = cut(pool.join(cases.select("id"), "id", "left_anti"))
    strata, cols = [f"e{i}" for i in range(len(exact))], {f"x{i}": c for i, c in enumerate(numeric.values())}
    # spread and ends over the whole pool, before the strata
    facts = pool.agg(*(F.stddev_samp(c).alias(f"sd_{c}") for c in cols), *(f(F.when(F.col("sound"), F.col(c))).alias(f"{p}_{c}") for c in cols for p, f in (("lo", F.min), ("hi", F.max))), F.count("*").alias("n")).first()
    sd = {c: facts[f"sd_{c}"] or 1.0 for c in cols}
    pool = pool.where("sound").drop("sound")
    missing = cases.where("not sound").select(F.col("id").alias("case"), F.lit("missing").alias("reason"))
    left = cases.where("sound").drop("sound")
    if strata:
        missing = missing.unionByName(left.join(pool.select(*strata).distinct(), strata, "left_anti").select(F.col("id").alias("case"), F.lit("no_stratum").alias("reason")))
        left = left.join(pool.select(*strata).distinct(), strata, "left_semi")
    capped = [c for c in cols if cols[c] is not None and facts[f"lo_{c}"] is not None]
    axis = min(capped, key=lambda c: cols[c] / sd[c]) if capped else None
    if axis is not None:
        step = max(4 * cols[axis] * (1 + SLACK), (facts[f"hi_{axis}"] - facts[f"lo_{axis}"]) / max(1, facts["n"] // STRETCH)) or 1.0
        reach = cols[axis] * (1 + SLACK)
    kind = cases.schema["id"].dataType.simpleString()
    out = f"case {kind}, case_h long, control {kind}, control_h long, d2 double, near boolean, ended boolean"
    first = F.struct(F.col("case_h"), F.col("case"), F.col("control_h"), F.col("d2"))
    # kept: the earliest case of each control that was asked; state: what each case found; asking: the cases of this round
    kept = cases.limit(0).select(F.col("id").alias("control"), F.lit(None).cast(f"struct<case_h:bigint,case:{kind},control_h:bigint,d2:double>").alias("k"))
    state = left.select(F.col("id").alias("case"), F.lit(False).alias("near"), F.lit(False).alias("ended"))
    asking, rounds = left.select("id"), 0
    while True:
        have = pool.join(kept.select(F.col("control").alias("id"), F.col("k.case_h").alias("kept_h"), F.col("k.case").alias("kept")), "id", "left") if rounds else pool.withColumns({"kept_h": F.lit(None).cast("long"), "kept": F.lit(None).cast(kind)})
        own = left.join(asking.withColumn("asks", F.lit(True)), "id", "left").withColumns({"asks": F.coalesce("asks", F.lit(False)), "kind": F.lit(0), "kept_h": F.lit(None).cast("long"), "kept": F.lit(None).cast(kind)})
        have = have.withColumns({"asks": F.lit(False), "kind": F.lit(1)})
        if axis is None:
            both = own.unionByName(have).withColumn("cell", F.lit(0).cast("long"))
        else:
            shift = 0.0 if rounds % 2 == 0 else step / 2
            own = own.withColumn("cell", F.floor((F.col(axis) + shift) / step))
            # the pool reaches over borders, so that every case sees all controls it may ask; a stretch without a case that asks rests
            have = have.withColumn("cell", F.explode(F.sequence(F.floor((F.col(axis) - reach + shift) / step), F.floor((F.col(axis) + reach + shift) / step))))
            both = own.unionByName(have)
            if rounds:
                both = both.join(own.where("asks").select(*strata, "cell").distinct(), [*strata, "cell"], "left_semi")
        got = cut(both.groupBy(*strata, "cell").applyInPandas(_settle(cols, sd, axis, n, replace), out))
        rounds += 1
        if replace:
            kept = got.where("control is not null").select("control", first.alias("k"))
            state = got.where("control is null").select("case", "near", "ended")
            break
        asked = got.where("control is not null").select("control", first.alias("k"))
        kept = cut(kept.unionByName(asked).groupBy("control").agg(F.min("k").alias("k")))
        new = got.where("control is null").select("case", F.col("near").alias("_near"), F.col("ended").alias("_ended"))
        state = cut(state.join(new, "case", "left").select("case", F.coalesce("_near", "near").alias("near"), F.coalesce("_ended", "ended").alias("ended")))
        # a case that found fewer than n has asked all it could; any other that keeps fewer has lost one
        counts = kept.groupBy(F.col("k.case").alias("case")).agg(F.count("*").alias("_n"))
        asking = cut(state.where("not ended").join(counts, "case", "left").where(F.coalesce("_n", F.lit(0)) < n).select(F.col("case").alias("id")))
        if asking.isEmpty():
            break
    of = Window.partitionBy("case").orderBy("d2", "control_h", "control")
    pairs = kept.select("k.case", "control", "k.control_h", "k.d2").withColumn("rank", F.row_number().over(of) - 1).select("case", "control", "rank", F.sqrt("d2").alias("distance"))
    alone = state.join(pairs.select("case"), "case", "left_anti").select("case", F.when(F.col("near"), "exhausted").otherwise("out_of_caliper").alias("reason"))
    return Matches(pairs, missing.unionByName(alone), rounds)


def smd(value: Column, first: Column) -> Column:
    """Aggregate: difference of means over the root of the mean population variance; 0 where nothing varies."""
    a, b = F.when(first, value), F.when(~first, value)
    spread = F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2)
    return F.when(spread > 0, (F.avg(a) - F.avg(b)) / spread).otherwise(F.when(F.count(a) * F.count(b) > 0, F.lit(0.0)))


def balance(cases: DataFrame, pool: DataFrame, pairs: DataFrame, key: str, numeric: list[str], categorical: list[str] = ()) -> DataFrame:
    """(covariate, level, smd_before, smd_after): cases against the pool, then matched cases against their controls.

    A categorical column is one indicator a level; null is the level `unknown`. A control counts once for each case it serves.
    """
    cols = [key, *numeric, *categorical]
    pool = pool.join(cases.select(key), key, "left_anti").dropDuplicates([key]).select(*cols)
    cases = cases.dropDuplicates([key]).select(*cols)
    before = cases.withColumn("_case", F.lit(True)).unionByName(pool.withColumn("_case", F.lit(False)))
    matched = cases.join(pairs.select(F.col("case").alias(key)).distinct(), key).withColumn("_case", F.lit(True))
    after = matched.unionByName(pool.join(pairs.select(F.col("control").alias(key)), key).withColumn("_case", F.lit(False)))
    levels = {c: [r[0] for r in before.select(F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c)).distinct().orderBy(c).limit(1001).collect()] for c in categorical}
    if any(len(v) > 1000 for v in levels.values()):
        raise ValueError("a categorical covariate has over 1,000 levels")
    what = [(c, None, F.col(c).cast("double")) for c in numeric] + [(c, v, (F.coalesce(F.col(c).cast("string"), F.lit("unknown")) == v).cast("double")) for c in categorical for v in levels[c]]

    def told(df: DataFrame, name: str) -> DataFrame:
        row = df.agg(F.array(*(F.struct(F.lit(c).alias("covariate"), F.lit(v).cast("string").alias("level"), smd(x, F.col("_case")).alias(name)) for c, v, x in what)).alias("_s"))
        return row.select(F.explode("_s").alias("_s")).select("_s.*")

    a, b = told(before, "smd_before"), told(after, "smd_after")
    return a.join(b.withColumnsRenamed({"covariate": "_c", "level": "_l"}), (F.col("covariate") == F.col("_c")) & F.col("level").eqNullSafe(F.col("_l"))).select("covariate", "level", "smd_before", "smd_after")
