"""Bootstraps of rank statistics, crossed units and seed mixtures against loops over replicates."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import bootstrap


def plain_auroc(score, positive):
    p, n = score[positive], score[~positive]
    return np.nan if not len(p) or not len(n) else ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def mid(x):
    return pd.Series(x).rank().to_numpy()


def draw(n, *parts):
    return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) % n


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    n = 500
    d = pd.DataFrame({"arm": rng.choice(["a", "b"], n), "x": np.round(rng.normal(size=n), 1), "y": rng.integers(0, 9, n), "chrom": rng.choice(["c1", "c2", "c3", "c4"], n, p=[0.6, 0.2, 0.15, 0.05])})
    d["positive"] = rng.random(n) < 0.3 + 0.1 * d.x.clip(-1, 1)
    return d, spark.createDataFrame(d).repartition(4)


def test_rank_replicates_equal_resampled_rows(scored):
    d, df = scored
    names = ["c1", "c2", "c3", "c4"]
    draws = bootstrap.pcg_draws(4, 40, 17)
    order = np.random.Generator(np.random.PCG64(17)).integers(0, 4, size=(40, 4))
    assert (draws.sum(1) == 4).all() and all((np.bincount(o, minlength=4) == m).all() for o, m in zip(order, draws))
    au = bootstrap.auroc_replicates(df, "arm", "x", F.col("positive"), "chrom", names, draws)
    sp = bootstrap.spearman_replicates(df, "arm", "x", "y", "chrom", names, draws)
    for arm in "ab":
        own = d[d.arm == arm]
        assert abs(au[arm][0] - plain_auroc(own.x.to_numpy(), own.positive.to_numpy())) < 1e-12
        assert abs(sp[arm][0] - np.corrcoef(mid(own.x), mid(own.y))[0, 1]) < 1e-10
        for b in range(40):
            again = pd.concat([own[own.chrom == names[k]] for k in order[b]])
            want = plain_auroc(again.x.to_numpy(), again.positive.to_numpy())
            assert np.isnan(want) and np.isnan(au[arm][1][b]) or abs(au[arm][1][b] - want) < 1e-12
            assert abs(sp[arm][1][b] - np.corrcoef(mid(again.x), mid(again.y))[0, 1]) < 1e-9
    c = bootstrap.contrast(au["a"], au["b"])
    diff = au["a"][1] - au["b"][1]
    assert c["delta"] == au["a"][0] - au["b"][0] and c["ci_lo"] == np.quantile(diff, 0.025)
    assert c["p"] == min(1, 2 * min(1 + (diff <= 0).sum(), 1 + (diff >= 0).sum()) / 41)


def test_blocks_are_declared_and_few(scored):
    _, df = scored
    with pytest.raises(Exception, match="outside the declared blocks"):
        bootstrap.auroc_replicates(df, "arm", "x", F.col("positive"), "chrom", ["c1", "c2"], np.ones((1, 2)))
    with pytest.raises(ValueError):
        bootstrap.auroc_replicates(df, "arm", "x", F.col("positive"), "chrom", list("x" * 65), np.ones((1, 65)))
    assert bootstrap.auroc_replicates(df.limit(0), "arm", "x", F.col("positive"), "chrom", ["c1"], np.ones((1, 1))) == {}


def test_counts_of_a_replicate_add_up(spark):
    got = bootstrap.hash_counts(spark, 37, 20, 5, "unit").toPandas()
    assert (got.groupby("replicate").times.sum() == 37).all() and len(got.replicate.unique()) == 20
    want = np.bincount([draw(37, 5, "unit", 3, k) for k in range(37)], minlength=37)
    mine = got[got.replicate == 3].set_index("unit").times.reindex(range(37), fill_value=0).to_numpy()
    assert (mine == want).all()


def crossed_tables(spark):
    rng = np.random.default_rng(6)
    keys = [(f"p{i}", int(c), f"b{c // 5}") for i in range(9) for c in rng.choice(30, 12, replace=False)]
    d = pd.DataFrame(keys, columns=["patient", "column", "block"])
    d["target"], d["n"] = rng.random(len(d)), rng.integers(1, 4, len(d))
    d["r"], d["a"] = rng.random(len(d)), rng.random(len(d)) * 0.9
    table = lambda c: spark.createDataFrame(d.assign(squared_error=d[c])[["patient", "column", "block", "target", "squared_error", "n"]])
    return d, table("r"), table("a")


def test_crossed_bootstrap_equals_a_loop(spark):
    d, r, a = crossed_tables(spark)
    got = bootstrap.paired_crossed(r, a, "patient", "column", "block", replicates=60, seed=3).first()
    place = lambda c: {v: i for i, v in enumerate(sorted(d[c].unique(), key=lambda v: hashlib.sha256(f"{v}:3".encode()).hexdigest()))}
    pi, bi = d.patient.map(place("patient")).to_numpy(), d.block.map(place("block")).to_numpy()
    np_, nb = pi.max() + 1, bi.max() + 1
    est, rel = [], []
    for rep in range(60):
        w = np.bincount([draw(np_, 3, "unit", rep, k) for k in range(np_)], minlength=np_)[pi] * np.bincount([draw(nb, 3, "block", rep, k) for k in range(nb)], minlength=nb)[bi] * d.n
        if w.sum():
            est.append((w * (d.a - d.r)).sum() / w.sum())
            rel.append((w * (d.a - d.r)).sum() / (w * d.r).sum())
    point = np.average(d.a - d.r, weights=d.n)
    assert abs(got.delta_mse - point) < 1e-12 and abs(got.relative_delta_mse - point / np.average(d.r, weights=d.n)) < 1e-12
    assert np.allclose([got.ci_lo, got.ci_hi], np.quantile(est, [0.025, 0.975])) and np.allclose([got.relative_ci_lo, got.relative_ci_hi], np.quantile(rel, [0.025, 0.975]))
    assert abs(got.p - (1 + (np.abs(np.array(est) - point) >= abs(point)).sum()) / (1 + len(est))) < 1e-12
    assert (got.n_units, got.n_blocks, got.n_pairs, got.n_observations) == (9, 6, len(d), d.n.sum())


def test_crossed_bootstrap_refuses_unpaired_tables(spark):
    _, r, a = crossed_tables(spark)
    for other in (a.limit(50), a.withColumn("target", F.col("target") + 1e-3), a.withColumn("n", F.col("n") + 1)):
        with pytest.raises(Exception, match="not paired"):
            bootstrap.paired_crossed(r, other, "patient", "column", "block", 5, 1).collect()
    with pytest.raises(ValueError):
        bootstrap.paired_crossed(r.where("patient = 'p1'"), a.where("patient = 'p1'"), "patient", "column", "block", 5, 1)


def test_seed_mixture_equals_a_loop(spark):
    rng = np.random.default_rng(9)
    d = pd.DataFrame([(s, f"c{rng.integers(3)}", i) for s in (11, 12, 13) for i in range(40)], columns=["ms", "chrom", "pair"])
    for c in ("pa", "na", "pb", "nb"):
        d[c] = np.round(rng.normal(0.3 * (c[0] == "p"), 1, len(d)), 1)
    arms = {"a": ("pa", "na"), "b": ("pb", "nb")}
    df = spark.createDataFrame(d).repartition(3)
    boot = {(r.arm, r.replicate): r.auroc for r in bootstrap.seed_mixture(df, "ms", "chrom", "pair", arms, 30, 7).collect()}
    au = lambda p, n: ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    for rep in range(30):
        own = d[d.ms == (11, 12, 13)[draw(3, 7, "seed", rep)]]
        picked = pd.concat([g.sort_values("pair").iloc[[draw(len(g), 7, rep, c, k) for k in range(len(g))]] for c, g in own.groupby("chrom")])
        for arm, (p, n) in arms.items():
            assert abs(boot[arm, rep] - au(picked[p].to_numpy(), picked[n].to_numpy())) < 1e-12
    rows = {(r.kind, r.arm): r for r in bootstrap.mixture_report(df, "ms", "chrom", "pair", arms, 30, 7, [("a", "b")]).collect()}
    by_seed = np.array([[au(g[p].to_numpy(), g[n].to_numpy()) for p, n in arms.values()] for _, g in d.groupby("ms")])
    diff = np.array([boot["a", r] - boot["b", r] for r in range(30)])
    assert abs(rows["auc", "a"].estimate - by_seed[:, 0].mean()) < 1e-12 and abs(rows["auc", "b"].between_seed_sd - by_seed[:, 1].std(ddof=1)) < 1e-12
    got = rows["delta", "a"]
    assert got.comparison == "a - b" and np.allclose([got.ci_lo, got.ci_hi], np.quantile(diff, [0.025, 0.975])) and rows["auc", "a"].p is None
    assert abs(got.p - min(1, 2 * (min((diff <= 0).mean(), (diff >= 0).mean()) + 1 / 31))) < 1e-12


def test_crossed_pairs_are_made_once(spark):
    cells = spark.range(300).select((F.col("id") % 6).alias("u"), F.col("id").alias("item"), (F.col("id") % 4).alias("b"), F.lit(0.5).alias("target"), F.lit(1).alias("n"))
    r, a = (cells.withColumn("squared_error", F.rand(s)) for s in (3, 4))
    out = bootstrap.paired_crossed(r, a, "u", "item", "b", 10, 1)
    assert "FullOuter" not in out._jdf.queryExecution().optimizedPlan().toString()  # branches read the written cells, not the pairs
    assert out.first().n_pairs == 300


def test_draws_of_a_mixture_are_shuffled_once(spark):
    n = F.col("id")
    df = spark.range(200).select((n % 2).alias("ms"), (n % 3).cast("string").alias("chrom"), n.alias("pair"), F.rand(1).alias("p"), F.rand(2).alias("q"))
    plan = bootstrap.seed_mixture(df, "ms", "chrom", "pair", {"a": ("p", "q")}, 8, 7)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin [_place" in plan  # no count by pair before, no sort of the draws
