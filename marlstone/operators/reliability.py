"""Pairs of profiles: overlapping cells of pairs, split halves by cell, comparison of strata, composition.

A profile is a row's array over groups (few), with nulls where a group has no value. Strata, cells and groups are few;
loci, pairs and donors aren't bounded. Ranks and distribution functions come from running totals (`ordered`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import maths
from marlstone.operators import ordered, splits

#: Places kept before values are ranked, so that sums in another order tie alike.
PLACES = 9


def cells(distance_class: Column, across: str, variance: Column, v_edges: list[Column], v_top: Column, mean: Column, m_edges: list[Column]) -> Column:
    """The names of all cells a pair lies in: its distance class, within or across, quartile and top tenth of variance,
    quartile of mean. An edge belongs to the upper quartile; a pair without variance or mean has no cell of that kind.
    """

    def quartile(x, edges, name):
        above = sum(((x >= e).cast("int") for e in edges), F.lit(1))
        return F.when(x.isNotNull(), F.concat(F.lit(name), above.cast("string")))

    names = [
        F.lit("all"),
        F.concat(F.lit("dist_"), distance_class),
        F.when(distance_class.isNotNull(), F.when(distance_class == across, "chrom_inter").otherwise("chrom_intra")),
        quartile(variance, v_edges, "V_Q"),
        F.when(variance >= v_top, "V_top10pct"),
        quartile(mean, m_edges, "M_Q"),
    ]
    return F.array_compact(F.array(*names))


def edges(pairs: DataFrame, variance: str, mean: str) -> DataFrame:
    """(v, m): the quartiles and 9th decile of variance and the quartiles of mean, exact; one row."""
    v = ordered.quantiles(pairs, variance, [0.25, 0.5, 0.75, 0.9]).select(F.col("quantiles").alias("v"))
    m = ordered.quantiles(pairs, mean, [0.25, 0.5, 0.75]).select(F.col("quantiles").alias("m"))
    return v.crossJoin(m)  # one row each


def check_edges(pairs: DataFrame, variance: str, mean: str, v_edges: list[float], m_edges: list[float], rtol: float = 1e-6) -> dict:
    """The quantiles of the pairs; an error where registered edges (three quartiles and the 9th decile, three quartiles) differ."""
    got = edges(pairs, variance, mean).first()
    for name, have, want in (("variance", got.v, v_edges), ("mean", got.m, m_edges)):
        if len(have) != len(want) or any(h is None or abs(h - w) > rtol * abs(w) for h, w in zip(have, want)):
            raise ValueError(f"registered {name} edges {list(want)} differ from the quantiles of the pairs {have}")
    return {"v": list(got.v), "m": list(got.m)}


def with_cells(rows: DataFrame, at_edges: DataFrame, distance_class: str, across: str, variance: str, mean: str) -> DataFrame:
    """rows with the names of their cells (column cells, an array) between the given edges, as from `edges`."""
    at = rows.crossJoin(F.broadcast(at_edges.toDF("_v", "_m")))  # one row
    v, m = F.col("_v"), F.col("_m")
    names = cells(F.col(distance_class), across, F.col(variance), [v[k] for k in range(3)], v[3], F.col(mean), [m[k] for k in range(3)])
    return at.withColumn("cells", names).drop("_v", "_m")


def in_cells(pairs: DataFrame, distance_class: str, across: str, variance: str, mean: str) -> DataFrame:
    """pairs with a row for each cell (column cell); the edges are quantiles of the pairs themselves."""
    return with_cells(pairs, edges(pairs, variance, mean), distance_class, across, variance, mean).withColumn("cell", F.explode("cells")).drop("cells")


def cell_names(classes: list[str]) -> list[str]:
    """The names of all cells that pairs of these distance classes can lie in."""
    quarters = [f"{kind}_Q{k}" for kind in "VM" for k in range(1, 5)]
    return ["all", *(f"dist_{c}" for c in classes), "chrom_inter", "chrom_intra", *quarters, "V_top10pct"]


def pearson(a: Column, b: Column, least: int, floor: float = 1e-12) -> Column:
    """Correlation of two profiles over the groups that both have; null with fewer than `least` or a variance up to floor."""
    both = F.filter(F.arrays_zip(a.alias("x"), b.alias("y")), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    start = F.struct(*(F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")))

    def add(s, p):
        x, y = p["x"].cast("double"), p["y"].cast("double")
        parts = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
        return F.struct(*((s[k] + v).alias(k) for k, v in parts.items()))

    def done(s):
        vx, vy = s["xx"] / s["n"] - (s["x"] / s["n"]) ** 2, s["yy"] / s["n"] - (s["y"] / s["n"]) ** 2
        r = (s["xy"] / s["n"] - s["x"] * s["y"] / (s["n"] * s["n"])) / F.sqrt(vx * vy)
        return F.when((s["n"] >= least) & (vx > floor) & (vy > floor), r)

    return F.aggregate(both, start, add, done)


def pearson_rows(x: pa.ListArray, y: pa.ListArray, groups: int, least: int, floor: float = 1e-12) -> list[pa.Array]:
    """`pearson` for each stretch of `groups` values of two columns of arrays, all of one length: an array for each stretch."""

    def table(c):
        flat = c.flatten()
        return flat.fill_null(0.0).to_numpy().reshape(len(c), -1, groups), flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(c), -1, groups)

    (a, has_a), (b, has_b) = table(x), table(y)
    both = has_a & has_b
    a, b = np.where(both, a, 0.0), np.where(both, b, 0.0)
    total = lambda v: sum((v[:, :, g] for g in range(groups)), np.zeros(v.shape[:2]))
    n, sx, sy = both.sum(axis=2), total(a), total(b)
    with np.errstate(all="ignore"):
        vx, vy = total(a * a) / n - (sx / n) ** 2, total(b * b) / n - (sy / n) ** 2
        r = (total(a * b) / n - sx * sy / (n * n)) / np.sqrt(vx * vy)
    known = (n >= least) & ~(vx <= floor) & ~(vy <= floor)  # a figure that isn't a number counts as large, as in Spark
    return [pa.array(np.ascontiguousarray(r[:, k]), pa.float64(), mask=~known[:, k]) for k in range(r.shape[1])]


def halves(donors: DataFrame, donor: str, group: str, repetitions: int, seed: int = 0) -> DataFrame:
    """(donor, group, rep, half): in each repetition the donors of a group in hash order, the first half and the rest.

    Donors stand once. Of an odd number the middle one goes to the second half; a lone donor too.
    """
    reps = F.explode(F.array(*(F.lit(r) for r in range(repetitions))))
    key = F.concat_ws(":", F.col(donor).cast("string"), F.col("rep").cast("string"))
    each = donors.select(donor, group).withColumn("rep", reps).withColumn("_key", key)
    placed = splits.hash_positions(each, "_key", seed, ("rep", group))
    return placed.select(donor, group, "rep", (F.col("_rn") >= F.floor(F.col("_n") / 2)).cast("int").alias("half"))


def half_tables(values: DataFrame, split: DataFrame, locus: str, donor: str, group: str, value: str, groups: list, reps: list[int]) -> DataFrame:
    """(locus, mean, var, reps): mean and variance of a locus' group means over all donors, and for each repetition (few)
    the profiles a and b of both halves, a mean over a half's donors with a value for each group; null without one.

    values has a row for each locus and donor. Each is shuffled once by locus, for all repetitions together.
    """
    sides = split.groupBy(donor, group).agg(*(F.max(F.when(F.col("rep") == r, F.col("half"))).alias(f"_h{k}") for k, r in enumerate(reps)))
    at = values.select(locus, donor, value).where(F.col(value).isNotNull()).join(sides, donor).drop(donor)
    of = lambda k, h: F.avg(F.when(F.col(f"_h{k}") == h, F.col(value)))
    names = [f"_{s}{k}" for k in range(len(reps)) for s in "ab"]
    means = at.repartition(locus).groupBy(locus, group).agg(F.avg(value).alias("_m"), *(of(k, h).alias(f"_{s}{k}") for k in range(len(reps)) for h, s in enumerate("ab")))
    held = means.groupBy(locus).agg(F.avg("_m").alias("mean"), F.var_pop("_m").alias("var"), F.map_from_entries(F.collect_list(F.struct(group, F.struct(*names)))).alias("_by"))
    held = held.select(locus, "mean", "var", *(F.try_element_at("_by", F.lit(g)).alias(f"_g{n}") for n, g in enumerate(groups)))
    side = lambda c: F.array(*(F.col(f"_g{n}")[c] for n in range(len(groups))))
    return held.select(locus, "mean", "var", F.array(*(F.struct(F.lit(r).alias("rep"), side(f"_a{k}").alias("a"), side(f"_b{k}").alias("b")) for k, r in enumerate(reps))).alias("reps"))


def half_profiles(values: DataFrame, split: DataFrame, locus: str, donor: str, group: str, value: str, groups: list) -> DataFrame:
    """(rep, locus, a, b): the profiles of both halves of each repetition, as in `half_tables`; loci without a value are left out."""
    reps = sorted(r.rep for r in split.select("rep").distinct().collect())  # few
    return half_tables(values, split, locus, donor, group, value, groups, reps).select(locus, F.explode("reps").alias("_r")).select("_r.rep", locus, "_r.a", "_r.b")


def half_similarities(pairs: DataFrame, tables: DataFrame, locus: str, i: str, j: str, reps: list[int], groups: int, least: int, also: tuple[Column, ...] = ()) -> DataFrame:
    """pairs x rep with ta and tb, the similarity of a pair's profiles (of that many groups) within each half; tables as from
    `half_tables` with the same reps, pairs without them are left out. A pair is joined once for all repetitions.

    also: further columns of a pair, made of mean_i, var_i, mean_j, var_j of its loci.
    """
    flat = F.flatten(F.transform("reps", lambda r: F.concat(r["a"], r["b"])))
    of = lambda k, s: tables.select(F.col(locus).alias(k), F.col("mean").alias(f"mean_{s}"), F.col("var").alias(f"var_{s}"), flat.alias(f"_{s}"))
    both = pairs.join(of(i, "i"), i).join(of(j, "j"), j).select(*pairs.columns, *also, "_i", "_j")
    kept = [c for c in both.columns if c not in ("_i", "_j")]
    names = [f"_t{side}{k}" for k in range(len(reps)) for side in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = pearson_rows(b.column("_i"), b.column("_j"), groups, least) if len(b) else [pa.array([], pa.float64()) for _ in names]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *told], [*kept, *names])

    fields = [f"`{c}` {both.schema[c].dataType.simpleString()}" for c in kept]
    t = both.mapInArrow(run, ", ".join([*fields, *(f"{c} double" for c in names)]))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rep"), F.col(f"_ta{k}").alias("ta"), F.col(f"_tb{k}").alias("tb")) for k, r in enumerate(reps))))
    return t.select(*kept, each.alias("_r")).select(*kept, "_r.rep", F.round("_r.ta", PLACES).alias("ta"), F.round("_r.tb", PLACES).alias("tb"))


def reliability(similarities: DataFrame, by: list[str], fewest: int = 10) -> DataFrame:
    """(by, n, r_spearman, r_pearson, rho_sb, ceiling) of ta against tb; null figures where fewer than `fewest` pairs have both."""
    ok = similarities.where("ta is not null and tb is not null")
    ranked = ordered.mid_ranks(ordered.mid_ranks(ok, "ta", "_ra", tuple(by)), "tb", "_rb", tuple(by))
    return _figures(ranked, by, fewest)


def _figures(ranked: DataFrame, by: list[str], fewest: int) -> DataFrame:
    told = ranked.groupBy(*by).agg(F.count("*").alias("n"), maths.safe_corr(F.col("_ra"), F.col("_rb")).alias("r_spearman"), maths.safe_corr(F.col("ta"), F.col("tb")).alias("r_pearson"))
    enough = lambda c: F.when(F.col("n") >= fewest, c)
    told = told.withColumns({"r_spearman": enough(F.col("r_spearman")), "r_pearson": enough(F.col("r_pearson"))})
    told = told.withColumn("rho_sb", maths.spearman_brown(F.col("r_spearman")))
    return told.withColumn("ceiling", maths.ceiling(F.col("rho_sb"), F.lit(1.0)))


def reliability_in_cells(similarities: DataFrame, cells: str, names: list[str], by: list[str], fewest: int = 10) -> DataFrame:
    """`reliability` by cell and by, for rows with an array of their cells (few: names holds them all). A row is ranked in all
    its cells at once (see `ordered.ranks_in_sets`)."""
    known = F.array(*map(F.lit, names))
    sets = similarities.withColumn("_sets", F.transform(cells, lambda c: (F.array_position(known, c) - 1).cast("int"))).drop(cells)
    ranked = ordered.ranks_in_sets(sets, {"ta": "_pa", "tb": "_pb"}, "_sets", len(names), tuple(by))
    each = ranked.select(*by, "ta", "tb", F.explode(F.arrays_zip("_sets", "_pa", "_pb")).alias("_z"))
    told = _figures(each.select(*by, "ta", "tb", F.col("_z._sets").alias("_set"), F.col("_z._pa").alias("_ra"), F.col("_z._pb").alias("_rb")), [*by, "_set"], fewest)
    return told.withColumn("cell", F.get(known, F.col("_set"))).drop("_set")


def over_repetitions(told: DataFrame, by: str, columns: tuple[str, ...] = ("n", "r_spearman", "rho_sb", "ceiling")) -> DataFrame:
    """(by, <c>_median, <c>_q025, <c>_q975): over the repetitions (few) that have the figure."""
    out = [F.percentile(F.col(c).cast("double"), F.lit(q)).alias(f"{c}_{n}") for c in columns for n, q in (("median", 0.5), ("q025", 0.025), ("q975", 0.975))]
    return told.groupBy(by).agg(*out)


def strata_matrices(df: DataFrame, value: str, stratum: str, names: list[str]) -> DataFrame:
    """(a, b, smd, ks) for each ordered pair of strata (few): the standardised mean difference and the largest gap of the
    distribution functions. All gaps come from one set of running totals. Null where a stratum has no value.
    """
    x, s = F.col(value), F.col(stratum)
    held = df.where(x.isNotNull() & s.isin(names))
    steps = ordered.tie_groups(held, value, **{f"_c{k}": F.when(s == name, 1).otherwise(0) for k, name in enumerate(names)})
    share = lambda k: (F.col(f"before__c{k}") + F.col(f"_c{k}")) / F.nullif(F.col(f"all__c{k}"), F.lit(0))
    several = [(k, m) for k in range(len(names)) for m in range(k + 1, len(names))]
    gaps = steps.agg(*(F.max(F.abs(share(k) - share(m))).alias(f"g{k}_{m}") for k, m in several)) if several else None
    of = {name: F.struct(F.avg(F.when(s == name, x)).alias("m"), F.var_samp(F.when(s == name, x)).alias("v"), F.count_if(s == name).alias("n")) for name in names}
    row = held.agg(*(c.alias(f"s{k}") for k, c in enumerate(of.values())))
    row = row.crossJoin(gaps) if gaps is not None else row  # one row each
    cells_ = []
    for k, a in enumerate(names):
        for m, b in enumerate(names):
            p, q = F.col(f"s{k}"), F.col(f"s{m}")
            smd = (p["m"] - q["m"]) / F.nullif(F.sqrt((p["v"] + q["v"]) / 2), F.lit(0.0))
            ks = F.when(p["n"] > 0, F.lit(0.0)) if k == m else F.col(f"g{min(k, m)}_{max(k, m)}").cast("double")
            cells_.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), smd.alias("smd"), ks.alias("ks")))
    return row.select(F.explode(F.array(*cells_)).alias("c")).select("c.*")


def composition(df: DataFrame, stratum: str, part: str, reference: list[str]) -> DataFrame:
    """(stratum, n, js): the Jensen-Shannon distance (base 2) of each stratum's shares of parts from those of the reference
    strata together. Parts and strata are few; rows are added up first.
    """
    counts = df.where(F.col(stratum).isNotNull() & F.col(part).isNotNull()).groupBy(stratum, part).agg(F.count("*").alias("n"))
    ref = counts.where(F.col(stratum).isin(reference)).groupBy(part).agg(F.sum("n").alias("_r"))
    whole = ref.agg(F.sum("_r").alias("_rn"))
    totals = counts.groupBy(stratum).agg(F.sum("n").alias("_n"))
    grid = totals.crossJoin(F.broadcast(counts.select(part).distinct().join(ref, part, "left").crossJoin(whole)))  # strata x parts, both few
    both = grid.join(counts, [stratum, part], "left")
    own = both.select(stratum, (F.coalesce("n", F.lit(0)) / F.col("_n")).alias("p"), (F.coalesce("_r", F.lit(0)) / F.col("_rn")).alias("q"))
    mid = (F.col("p") + F.col("q")) / 2
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / mid)).otherwise(F.lit(0.0))
    told = own.groupBy(stratum).agg(F.sqrt(F.greatest(F.sum(kl("p") + kl("q")) / 2, F.lit(0.0))).alias("js"))
    return told.join(totals.withColumnRenamed("_n", "n"), stratum).select(stratum, "n", "js")
