"""Probes, compressor, imputer and eigenvectors against plain versions on the collected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import probes

RNG = np.random.default_rng(3)
N, D = 240, 5
X = RNG.normal(size=(N, D)) * [1, 2, 3, 0.5, 1] + 1
Y = X @ [1, -1, 0.5, 0, 0] + RNG.normal(size=N)
CLASS = (Y + RNG.normal(size=N) > np.median(Y)).astype(float)
GROUP = np.arange(N) % 7
FOLD = GROUP % 4


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, X[i].tolist(), float(Y[i]), float(CLASS[i]), int(GROUP[i]), int(FOLD[i])) for i in range(N)]
    data += [(N, None, 1.0, 1.0, 0, 0), (N + 1, X[0].tolist(), None, None, 0, 0), (N + 2, X[0].tolist(), 1.0, 1.0, None, None)]
    df = spark.createDataFrame(data, "id int, x array<double>, y double, c double, g int, f int").repartition(5)
    return df.withColumn("t", F.when(F.col("y").isNotNull(), F.array("y", F.col("y") * F.col("y"))))


def ridge(x, y, alpha, sd):
    z = x / sd
    zm, ym = z.mean(0), y.mean(0)
    w = np.linalg.solve((z - zm).T @ (z - zm) + alpha * np.eye(x.shape[1]), (z - zm).T @ (y - ym))
    return lambda new: (new / sd - zm) @ w + ym


def test_blocked_ridge(rows):
    alphas = (0.1, 10.0, 1000.0)
    b, chosen = probes.blocked_ridge(probes.sums(rows, "x", "t", "f"), alphas)
    t = np.column_stack([Y, Y * Y])
    for f in range(4):
        tr = FOLD != f
        sd = X[tr].std(0)
        for k in range(2):
            sse = {a: sum(((t[FOLD == g, k] - ridge(X[tr & (FOLD != g)], t[tr & (FOLD != g), k], a, sd)(X[FOLD == g])) ** 2).sum() for g in range(4) if g != f) for a in alphas}
            best = min(sorted(alphas, reverse=True), key=sse.get)
            assert chosen[f][k] == best
            want = ridge(X[tr], t[tr, k], best, sd)(X[FOLD == f])
            assert np.allclose(np.column_stack([X[FOLD == f], np.ones((FOLD == f).sum())]) @ b[f][:, k], want)
    got = {r.id: r.p for r in probes.predicted(rows, "x", "f", b, "p").select("id", "p").collect()}
    assert got[N] is None and got[N + 2] is None and np.allclose(got[5], np.append(X[5], 1) @ b[FOLD[5]])


def test_nested_ridge(spark, rows):
    p = probes.nested_ridge(probes.sums(rows.withColumn("t", F.when(F.col("y").isNotNull(), F.array("y"))), "x", "t", "g"), folds=3, inner=2)
    assert p.status == "complete" and p.n == N and sorted(sum(p.groups.values(), [])) == list(range(7))
    guess = np.zeros(N)
    for f, groups in p.groups.items():
        te = np.isin(GROUP, groups)
        guess[te] = ridge(X[~te], Y[~te], p.alpha[f][0], X[~te].std(0))(X[te])
    assert abs(p.overall["mse"] - ((Y - guess) ** 2).mean()) < 1e-8
    assert abs(p.overall["r2"] - (1 - ((Y - guess) ** 2).sum() / ((Y - Y.mean()) ** 2).sum())) < 1e-8
    assert abs(p.overall["pearson"] - np.corrcoef(Y, guess)[0, 1]) < 1e-8
    assert probes.nested_ridge({}).status == "insufficient_support"
    assert probes.sums(rows.where("id < 0"), "x", "t", "g") == {}


def test_leave_one_out_ridge(rows):
    alphas = (0.01, 1.0, 100.0)
    got = probes.leave_one_out_ridge(rows, "x", "y", "f", alphas)
    for f in (0, 3):
        tr = FOLD != f
        x, y, sd = X[tr], Y[tr], X[tr].std(0)
        errors = []
        for a in alphas:
            # the scale stays that of all training rows, as the leverages have it
            errors.append(sum((y[i] - ridge(np.delete(x, i, 0), np.delete(y, i), a, sd)(x[i])) ** 2 for i in range(len(y))))
        assert got[f][0] == alphas[int(np.argmin(errors))]
        assert abs(got[f][2]["mse"] - ((Y[~tr] - ridge(x, y, got[f][0], sd)(X[~tr])) ** 2).mean()) < 1e-8


def test_logistic_is_at_the_minimum(rows):
    b, chosen = probes.blocked_logistic(rows, "x", "c", "f", (0.1, 1.0))
    for f in range(4):
        tr = FOLD != f
        sd, a = X[tr].std(0), np.column_stack([X[tr], np.ones(tr.sum())])
        p = 1 / (1 + np.exp(-(a @ b[f])))
        g = chosen[f] * a.T @ (p - CLASS[tr]) + np.append(sd * sd, 0) * b[f]
        assert np.abs(g).max() < 1e-3
        assert (((np.column_stack([X[~tr], np.ones((~tr).sum())]) @ b[f]) > 0) == (CLASS[~tr] == 1)).mean() > 0.6


def test_compressor_matches_svd(rows):
    s = probes.sums(rows.withColumn("all", F.lit(0)).where("id < 240"), "x", "t", "all")[0]
    w = probes.replicate_weights(["a", "a", "b", "c", "c"])
    assert np.allclose(w, [0.5**0.5, 0.5**0.5, 1, 0.5**0.5, 0.5**0.5])
    for blocks in ([list(range(5))], [[0, 2, 4], [1, 3]]):
        loadings, share = probes.compressor(s, 2, blocks, w)
        energy = ((X @ loadings) ** 2).sum(0)
        want = np.concatenate([np.linalg.svd((X * w)[:, q])[1][:2] ** 2 for q in blocks])
        assert np.allclose(energy, want) and np.allclose(share, want / ((X * w) ** 2).sum())


def test_imputer(spark):
    low = RNG.normal(size=(150, 2))
    o, t = (1 / (1 + np.exp(-(low @ RNG.normal(size=(2, m)) + 0.05 * RNG.normal(size=(150, m))))) for m in (6, 3))
    data = [(i, [None if (i + k) % 29 == 0 else float(v) for k, v in enumerate(o[i])], [None if (i + k) % 31 == 0 else float(v) for k, v in enumerate(t[i])]) for i in range(150)]
    df = spark.createDataFrame(data, "id int, o array<double>, t array<double>").repartition(3)
    m = probes.fit_imputer(df.where("id < 90"), df.where("id between 90 and 119"), "o", "t", (1, 2, 4), (0.1, 10.0))
    lo, lt = (np.array([[np.nan if v is None else np.log(v / (1 - v)) for v in r[c]] for r in data]) for c in (1, 2))
    po, pt = np.nanmean(lo[:90], 0), np.nanmean(lt[:90], 0)
    ro, rt = np.nan_to_num(lo - po), np.nan_to_num(lt - pt)
    mu = ro[:90].mean(0)
    v = np.linalg.svd(ro[:90] - mu, full_matrices=False)[2].T
    best, fits = None, {}
    for k in (1, 2, 4):
        for a in (0.1, 10.0):
            z = (ro[:90] - mu) @ v[:, :k]
            fits[k, a] = v[:, :k] @ np.linalg.solve(z.T @ z + a * np.eye(k), z.T @ rt[:90])
            p = 1 / (1 + np.exp(-(pt + (ro[90:120] - mu) @ fits[k, a])))
            truth = 1 / (1 + np.exp(-lt[90:120]))
            e = np.nanmean((p - truth) ** 2)
            best = (e, k, a) if best is None or e < best[0] else best
    assert (m.k, m.alpha) == best[1:] and abs(m.error - best[0]) < 1e-8
    got = {r.id: r.imputed for r in probes.impute(df.where("id >= 120"), "o", m).collect()}
    want = 1 / (1 + np.exp(-(pt + (ro - mu) @ fits[m.k, m.alpha])))
    assert all(np.allclose(got[i], want[i]) for i in range(120, 150))


def test_compartments_find_two_halves(spark):
    n, side = 30, np.where(np.arange(30) % 10 < 5, 1, -1)
    pixels = [("c1", i, j, float(100 / (j - i + 1) * (1 + 0.5 * side[i] * side[j]))) for i in range(n) for j in range(i, n) if 7 not in (i, j)]
    bins = [("c1", i, 0.4 + 0.1 * float(side[i]), i != 7) for i in range(n)] + [("c2", 0, 0.5, False)]
    got = probes.compartments(spark.createDataFrame(pixels, "chrom string, i long, j long, value double"), spark.createDataFrame(bins, "chrom string, bin long, gc double, valid boolean")).collect()
    first = {r.bin: r.value for r in got if r.chrom == "c1" and r.eigenvector == 1}
    assert len(first) == n and first[7] is None
    assert all((v > 0) == (side[b] > 0) for b, v in first.items() if b != 7)
    assert not [r for r in got if r.chrom == "c2" and r.value is not None]


def test_group_folds_are_balanced():
    assert probes.group_folds({1: 5, 2: 5, 3: 9, 4: 1}, 2) == {3: 0, 2: 1, 1: 1, 4: 0}


def test_last_wanted_hash_is_exact(spark):
    from marlstone.plans import probes as plans

    rng = np.random.default_rng(6)
    rows = [(g, int(h)) for g in range(4) for h in rng.integers(-(2**63), 2**63 - 1, 500)] + [(3, -5)] * 40 + [(4, 9)]
    want = {0: 1, 1: 250, 2: 499, 3: 260, 4: 7}
    got = plans.last_wanted(spark.createDataFrame(rows, "g long, h long").repartition(4), spark.createDataFrame(list(want.items()), "g long, want long"), "h", ["g"], ["g"])
    assert "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    held = {g: sorted(h for k, h in rows if k == g) for g in want}
    assert {r.g: r["last"] for r in got.collect()} == {g: held[g][min(n, len(held[g])) - 1] for g, n in want.items()}


def test_membership_pairs_are_made_once(spark, sf, monkeypatch):
    from marlstone.plans import probes as plans
    from marlstone.plans import registry

    seen = []
    monkeypatch.setattr(plans.probes, "blocked_logistic", lambda df, *_: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or ({f: np.zeros(65) for f in range(5)}, {}))
    registry.QUERIES["cq5_membership_probe"](spark, sf)
    assert len(seen) == 2 and not any("Join" in plan for plan in seen)  # every pass of the fits reads the written pairs
