"""Cells, split halves, strata and audits against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import audits, ordered, probes, reliability


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_cells_overlap_and_edges_go_up(spark):
    rows = [(k, "near" if k % 2 else "inter", float(k), float(k)) for k in range(9)] + [(9, None, None, 2.0)]
    p = spark.createDataFrame(rows, "id int, dist string, v double, m double")
    got = {}
    for r in reliability.in_cells(p, "dist", "inter", "v", "m").collect():
        got.setdefault(r.id, set()).add(r.cell)
    assert got[2] == {"all", "dist_inter", "chrom_inter", "V_Q2", "M_Q2" if 2.0 >= np.quantile([*range(9), 2], 0.25) else "M_Q1"}
    assert got[8] >= {"V_Q4", "V_top10pct", "chrom_inter"} and "V_top10pct" not in got[7]
    assert got[9] == {"all", "M_Q2" if 2.0 >= np.quantile([*range(9), 2], 0.25) else "M_Q1"}
    v, m = np.quantile(range(9), [0.25, 0.5, 0.75, 0.9]), np.quantile([*range(9), 2], [0.25, 0.5, 0.75])
    reliability.check_edges(p, "v", "m", list(v), list(m))
    with pytest.raises(ValueError, match="variance"):
        reliability.check_edges(p, "v", "m", [*v[:3], 99.0], list(m))


def test_pearson_over_shared_groups(spark):
    rows = [([1.0, 2.0, None, 4.0], [2.0, 1.0, 5.0, 8.0]), ([1.0, None, None, 4.0], [2.0, 1.0, 5.0, 8.0]), ([1.0, 1.0, 1.0, 1.0], [2.0, 1.0, 5.0, 8.0]), (None, [1.0])]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r.r for r in d.select(reliability.pearson(F.col("a"), F.col("b"), 3).alias("r")).collect()]
    assert got[0] == pytest.approx(np.corrcoef([1, 2, 4], [2, 1, 8])[0, 1]) and got[1:] == [None, None, None]


def test_split_halves_against_loops(spark):
    rng = np.random.default_rng(5)
    donors = [(k, k % 3) for k in range(17)] + [(99, 7)]
    values = [(locus, d, float(rng.normal())) for locus in range(8) for d, _ in donors if rng.random() < 0.7] + [(0, 3, None)]
    values = [v for k, v in enumerate(values) if v[:2] not in {w[:2] for w in values[:k]}]
    split = reliability.halves(spark.createDataFrame(donors, "donor int, grp int"), "donor", "grp", 2, seed=7)
    half = {(r.donor, r.rep): r.half for r in split.collect()}
    for rep in range(2):
        for g in (0, 1, 2, 7):
            ids = sorted((d for d, h in donors if h == g), key=lambda d: hashlib.sha256(f"{d}:{rep}:7".encode()).hexdigest())
            assert [half[d, rep] for d in ids] == [int(k >= len(ids) // 2) for k in range(len(ids))]
    profiles = reliability.half_profiles(spark.createDataFrame(values, "locus int, donor int, v double"), split, "locus", "donor", "grp", "v", [0, 1, 2])
    group = dict(donors)
    for r in profiles.collect():
        for h, have in ((0, r.a), (1, r.b)):
            for g in range(3):
                xs = [v for locus, d, v in values if locus == r.locus and group[d] == g and half[d, r.rep] == h and v is not None]
                assert (have[g] is None and not xs) or have[g] == pytest.approx(np.mean(xs))


def test_reliability_with_ties_and_few(spark):
    rng = np.random.default_rng(2)
    rows = [("big", float(a), float(a + rng.integers(0, 4))) for a in rng.integers(0, 9, 60)] + [("few", 1.0, 2.0)] * 9 + [("big", None, 1.0)]
    got = {r.cell: r for r in reliability.reliability(spark.createDataFrame(rows, "cell string, ta double, tb double"), ["cell"]).collect()}
    a, b = zip(*((x, y) for c, x, y in rows if c == "big" and x is not None))
    r = np.corrcoef(ranks(a), ranks(b))[0, 1]
    assert got["big"].n == 60 and got["big"].r_spearman == pytest.approx(r) and got["big"].rho_sb == pytest.approx(2 * r / (1 + r))
    assert got["big"].ceiling == pytest.approx(math.sqrt(2 * r / (1 + r))) and got["few"].n == 9 and got["few"].r_spearman is None
    reps = spark.createDataFrame([("x", k, float(k)) for k in range(5)], "cell string, rep int, rho double")
    told = reliability.over_repetitions(reps, "cell", ("rho",)).first()
    assert (told.rho_median, told.rho_q025, told.rho_q975) == pytest.approx((2.0, *np.quantile(range(5), [0.025, 0.975])))


def test_ranks_in_all_sets_at_once(spark):
    rng = np.random.default_rng(6)
    rows = [(k, int(k % 2), float(rng.choice([0.25, rng.normal()], p=[0.4, 0.6]).round(2)), float(rng.integers(0, 5)), sorted({0, int(rng.integers(1, 4))})) for k in range(600)]
    rows += [(600, 0, None, 1.0, [0]), (601, 2, 0.5, 0.5, [3]), (602, 0, 0.1, 0.1, [])]
    d = spark.createDataFrame(rows, "id int, rep int, a double, b double, sets array<int>")
    for ranges in (1, 3, 64):
        got = {r.id: r for r in ordered.ranks_in_sets(d, {"a": "ra", "b": "rb"}, "sets", 4, ("rep",), ranges).collect()}
        assert sorted(got) == [k for k in range(603) if k != 600] and got[602].ra == [] and got[601].ra == [1.0]
        for rep in (0, 1):
            for s in range(4):
                own = [r for r in rows if r[1] == rep and s in r[4] and r[2] is not None]
                for c, name in ((2, "ra"), (3, "rb")):
                    assert [got[r[0]][name][r[4].index(s)] for r in own] == ranks([r[c] for r in own]).tolist()
    x = spark.createDataFrame([(k / 7, [0.5 * b for b in range(n)]) for n in (0, 1, 5, 64) for k in range(-3, 240)], "x double, b array<double>")
    assert all(r.p == sum(b < r.x for b in r.b) for r in x.select("*", ordered.place(F.col("b"), F.col("x"), 64).alias("p")).collect())


def test_reliability_of_arrays_of_cells_equals_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(int(k % 2), float(a), float(a + rng.integers(0, 4)), ["all", *(["odd"] if k % 3 else [])]) for k, a in enumerate(rng.integers(0, 9, 90))]
    d = spark.createDataFrame(rows, "rep int, ta double, tb double, cells array<string>")
    told = {(r.rep, r.cell): r for r in reliability.reliability_in_cells(d, "cells", ["odd", "all", "none"], ["rep"]).collect()}
    want = reliability.reliability(d.withColumn("cell", F.explode("cells")).drop("cells"), ["rep", "cell"]).collect()
    assert len(told) == len(want) == 4
    for r in want:
        t = told[r.rep, r.cell]
        assert (t.n, t.r_spearman, t.r_pearson) == (r.n, pytest.approx(r.r_spearman), pytest.approx(r.r_pearson))


def test_half_similarities_equal_pearson_over_shared_groups(spark):
    rng = np.random.default_rng(9)
    side = lambda: [None if rng.random() < 0.3 else float(rng.normal()) for _ in range(5)]
    loci = [(k, float(k), 1.0, [(r, side(), [1.0] * 5 if k == 3 else side()) for r in (4, 7)]) for k in range(12)]
    tables = spark.createDataFrame(loci, "locus int, mean double, var double, reps array<struct<rep:int,a:array<double>,b:array<double>>>")
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(i + 1, 13)], "i int, j int")  # locus 12 has no profile
    got = {(r.i, r.j, r.rep): r for r in reliability.half_similarities(pairs, tables, "locus", "i", "j", [4, 7], 5, 3, (F.col("mean_j").alias("m"),)).collect()}
    assert len(got) == 66 * 2
    flat = spark.createDataFrame([(i, j, r, x[s], y[s]) for i in range(12) for j in range(i + 1, 12) for r, x, y in zip((4, 7), loci[i][3], loci[j][3]) for s in (1, 2)], "i int, j int, rep int, x array<double>, y array<double>")
    want = {}
    for r in flat.select("*", F.round(reliability.pearson(F.col("x"), F.col("y"), 3), 9).alias("t")).collect():
        want.setdefault((r.i, r.j, r.rep), []).append(r.t)
    assert all((r.ta, r.tb) == tuple(want[k]) and r.m == k[1] for k, r in got.items()) and any(r.ta is None for r in got.values())


def test_strata_matrices_and_composition(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(np.round(rng.normal(k), 1)), str(rng.integers(0, 3 + k))) for k, s in enumerate("abc") for _ in range(40)] + [("a", None, None), ("z", 1.0, "0")]
    d = spark.createDataFrame(rows, "s string, x double, chrom string")
    of = {s: np.array([x for t, x, _ in rows if t == s and x is not None]) for s in "abc"}
    for r in reliability.strata_matrices(d, "x", "s", ["a", "b", "c", "none"]).collect():
        if "none" in (r.a, r.b):
            assert r.smd is None and r.ks is None
            continue
        p, q = of[r.a], of[r.b]
        assert r.smd == pytest.approx((p.mean() - q.mean()) / math.sqrt((p.var(ddof=1) + q.var(ddof=1)) / 2))
        assert r.ks == pytest.approx(max(abs((p <= x).mean() - (q <= x).mean()) for x in [*p, *q]))
    got = {r.s: (r.n, r.js) for r in reliability.composition(d, "s", "chrom", ["b", "c"]).collect()}
    parts = sorted({c for _, _, c in rows if c})
    share = lambda keep: np.array([sum(c == k for s, _, c in rows if s in keep) for k in parts], float)
    q = share("bc") / share("bc").sum()
    for s in "abcz":
        p = share(s) / share(s).sum()
        m = (p + q) / 2
        kl = lambda v: sum(a * math.log2(a / b) for a, b in zip(v, m) if a > 0)
        assert got[s] == (int(share(s).sum()), pytest.approx(math.sqrt((kl(p) + kl(q)) / 2)))


def test_mapping_audit(spark):
    used = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "y")], "z int, g string, h string")
    pub = spark.createDataFrame([(1, "a", None), (2, "q", "w"), (4, "d", "v")], "z int, g string, h string")
    got = {(r.z, r.problem) for r in audits.mapping_audit(used, pub, "z", ["g", "h"]).collect()}
    assert got == {(2, "g_mismatch"), (2, "h_mismatch"), (3, "unmatched"), (4, "extra")}
    assert audits.mapping_audit(used, used, "z", ["g", "h"]).count() == 0
    with pytest.raises(ValueError, match="null"):
        audits.mapping_audit(used.unionByName(spark.createDataFrame([(None, "a", "b")], used.schema)), pub, "z", ["g"])
    with pytest.raises(Exception, match="duplicate key"):
        audits.mapping_audit(used.unionByName(used), pub, "z", ["g"]).collect()


def test_half_precision_values(spark):
    rng = np.random.default_rng(4)
    xs = [*map(float, rng.normal(0, 3, 200)), 0.0, 1e-6, -2.5, 1.0 + 2**-11, 1.0 + 3 * 2**-11, 60000.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", audits.half_precision(F.col("x")).alias("h"), audits.midpoint_distance(F.col("x")).alias("d")).collect()
    for r in got:
        assert r.h == float(np.float16(r.x)) and 0 <= r.d <= 0.5
    at = {r.x: r.d for r in got}
    assert at[1.0 + 2**-11] == 0 and at[-2.5] == 0.5 and at[0.0] == 0.5
    fresh = spark.createDataFrame([(k, x) for k, x in enumerate(xs)] + [(1000, None), (1001, float("nan")), (1002, 1.0)], "k int, v double")
    frozen = [(k, float(np.float16(x))) for k, x in enumerate(xs)]
    frozen[3] = (3, frozen[3][1] + 1.0)
    told = audits.value_diff(fresh, spark.createDataFrame([*frozen, (1000, None), (1001, 2.0)], "k int, v double"), ["k"], "v").first()
    assert (told.n_cells, told.pattern_mismatch, told.beyond_half_ulp, told.rounding_mismatch) == (len(xs), 2, 1, 1)
    assert told.max_abs_diff == pytest.approx(max(abs(a - b) for a, (_, b) in zip(xs, frozen)))
    none = audits.value_diff(fresh.where("false"), fresh.where("false"), ["k"], "v").first()
    assert (none.n_cells, none.max_abs_diff) == (0, 0.0)


def test_tree_diff(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("z", None)], "path string, digest string")
    b = spark.createDataFrame([("y", "3"), ("z", None), ("w", "4")], "path string, digest string")
    assert {tuple(r) for r in audits.tree_diff(a, b).collect()} == {("x", "removed"), ("y", "changed"), ("z", "same"), ("w", "added")}


def test_tail_gaps_use_common_steps(spark):
    rows = [("ref", 0, t, 10.0) for t in range(0, 20, 2)] + [("alt", 0, t, 11.0 + t) for t in range(20)] + [("mix", 0, 18, 9.0), ("mix", 0, 16, 12.0), ("late", 0, 99, 1.0)]
    got = {r.arm: r for r in audits.tail_gaps(spark.createDataFrame(rows, "arm string, run int, step int, m double"), "arm", "run", "step", ["m"], "ref", 3).collect()}
    assert set(got) == {"alt", "mix"}
    assert (got["alt"].n_steps, got["alt"].gap, got["alt"].relative, got["alt"].sign_stable) == (3, 17.0, 1.7, True)
    assert (got["mix"].n_steps, got["mix"].gap, got["mix"].sign_stable) == (2, 0.5, False)


def test_verdicts(spark):
    rows = [("a", 1.0, 2.0, -1.0, 3.0), ("b", 1.0, -2.0, -3.0, -1.0), ("b", 1.0, 1.0, 0.0, 2.0), ("c", 1.0, -2.0, -3.0, 1.0), ("d", None, 1.0, 0.0, 1.0)]
    d = spark.createDataFrame(rows, "s string, p double, d double, lo double, hi double")
    c = d.withColumn("c", audits.contrast_category(F.col("p"), F.col("d"), F.col("lo"), F.col("hi")))
    assert [r.c for r in c.collect()] == ["same_sign", "flip_resolved", "same_sign", "flip_unresolved", None]
    assert {r.s: r.v for r in c.groupBy("s").agg(audits.verdict(F.col("c")).alias("v")).collect()} == {"a": "CONFIRMS", "b": "CHANGES", "c": "WEAKENS", "d": "CONFIRMS"}


def test_growing_grid_and_effective_ranks(spark):
    assert audits.edge_report([1, 1, 10, 0.1], (0.1, 1, 10), 0.25) == {"n": 4, "at_max": 0.25, "at_min": 0.25, "hit_max": True, "hit_min": True}
    up = [{"hit_max": True, "hit_min": False}]
    assert audits.wider_grid((1, 10), up, 0) == ((1.0, 10.0, 100.0, 1000.0), True)
    assert audits.wider_grid((1, 10), up, 2) == ((1.0, 10.0), False)
    assert audits.wider_grid((1, 10), [{"hit_max": False, "hit_min": True}], 1) == ((0.01, 0.1, 1.0, 10.0), True)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4)) * [5, 1, 1, 0.1] + 2
    y = rng.normal(size=60)  # no signal: the largest penalty wins, and the grid grows upwards
    rows = [(k % 4, [float(v) for v in x[k]], [float(y[k])]) for k in range(60)]
    parts = probes.sums(spark.createDataFrame(rows, "fold int, x array<double>, y array<double>"), "x", "y", "fold")
    grid, done, fits, reports = audits.ridge_on_growing_grid({"one": parts}, (0.1, 1.0))
    plain, n = (0.1, 1.0), 0
    while n < 2:
        chosen = np.concatenate(list(probes.blocked_ridge(parts, plain)[1].values()))
        top, low = (chosen == max(plain)).mean() >= 0.05, (chosen == min(plain)).mean() >= 0.05
        if not (top or low):
            break
        ends = (min(plain), max(plain))
        plain = tuple(([ends[0] / 100, ends[0] / 10] if low else []) + list(plain) + ([ends[1] * 10, ends[1] * 100] if top else []))
        n += 1
    assert grid == pytest.approx(plain) and done == n >= 1 and set(fits) == set(reports) == {"one"}
    for centred in (False, True):
        z = x - x.mean(0) if centred else x
        lam = np.linalg.eigvalsh(z.T @ z / 60)
        p = lam / lam.sum()
        got = audits.effective_ranks(parts, centred)
        assert (got["participation"], got["entropy_rank"]) == pytest.approx((1 / (p**2).sum(), np.exp(-(p * np.log(p)).sum())))
