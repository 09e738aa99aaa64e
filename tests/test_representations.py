"""Gathers, similarities without the rows' covariance, profile ridge: against numpy on collected rows."""

import numpy as np
import pytest
from pyspark.errors import PySparkException

from marlstone.operators import geometry, lookups, profiles

rng = np.random.default_rng(5)
STORE = "id long, v array<float>"


def test_aligned_gather_keeps_every_row_of_the_axis(spark):
    store = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (4, [0.0, 0.5])], STORE)
    axis = spark.createDataFrame([(4, 0), (1, 1), (1, 2), (2, 3), (9, 4)], "id long, place int")
    got = {r.place: (r.covered, r.v) for r in lookups.aligned_gather(axis, store, "id", "v", 2).collect()}
    assert got == {0: (True, [0.0, 0.5]), 1: (True, [1.0, 2.0]), 2: (True, [1.0, 2.0]), 3: (False, None), 4: (False, None)}
    filled = lookups.aligned_gather(axis, store, "id", "v", 2, fill=True).where("not covered").collect()
    assert [r.v for r in filled] == [[0.0, 0.0]] * 2
    assert lookups.aligned_gather(axis.where("false"), store, "id", "v", 2).count() == 0


@pytest.mark.parametrize("rows, width", [([(1, [1.0, 2.0]), (1, [3.0, 4.0])], 2), ([(1, [1.0])], 2)])
def test_aligned_gather_refuses(spark, rows, width):
    axis = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(PySparkException):
        lookups.aligned_gather(axis, spark.createDataFrame(rows, STORE), "id", "v", width).collect()


def test_strict_gather(spark):
    store = spark.createDataFrame([(1, [1.0, 2.0]), (2, [float("nan"), 0.0]), (3, [None, 1.0]), (4, None), (5, [float("inf"), 0.0])], STORE)
    ids = lambda *k: spark.createDataFrame([(i,) for i in k], "id long")
    assert [r.v for r in lookups.strict_gather(ids(1, 1), store, "id", "v", 2).collect()] == [[1.0, 2.0]] * 2
    for bad in (2, 3, 4, 5, 6):
        with pytest.raises(PySparkException):
            lookups.strict_gather(ids(1, bad), store, "id", "v", 2).collect()


def test_similarities_equal_numpy(spark):
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 3
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "id long, x array<double>").repartition(3)
    pairs = spark.createDataFrame([(i, (i * 7 + 3) % 61, "p") for i in range(61)], "i long, j long, tag string")
    s = geometry.spectrum(df, "x")
    got = {r.i: r for r in geometry.similarities(df, "id", "x", pairs, s, removed=(0, 2)).collect()}
    c = x - x.mean(0)
    lam, v = np.linalg.eigh(c.T @ c / 60)
    top = v[:, -2:]
    want = {"centred_0": c, "centred_2": c - c @ top @ top.T, "standardised": c / c.std(0), "whitened": c @ v / np.sqrt(lam + 1e-6 * lam.max())}
    assert 60 not in got and len(got) == 59 and got[0].tag == "p"
    for i, r in got.items():
        for name, z in want.items():
            a, b = z[i], z[r.j]
            assert abs(r[name] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9


def test_a_vector_on_the_removed_axes_is_an_error(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(4)], "id long, x array<double>")
    pairs = spark.createDataFrame([(0, 1)], "i long, j long")
    with pytest.raises(Exception, match="nothing is left"):
        geometry.similarities(df, "id", "x", pairs, geometry.spectrum(df, "x"), removed=(1,)).collect()
    with pytest.raises(ValueError):
        geometry.spectrum(df.where("false"), "x")


@pytest.fixture(scope="module")
def profile_table(spark):
    x, w = rng.normal(size=(120, 4)), rng.normal(size=(4, 3))
    y = x @ w + rng.normal(size=(120, 3)) * 0.3
    rows = [(i, i % 4, i % 6, x[i].tolist(), y[i].tolist()) for i in range(120)]
    rows += [(120, 0, 0, x[0].tolist(), None), (121, 1, 1, x[0].tolist(), [1.0, None, 2.0]), (122, 2, 2, x[0].tolist(), [1.0, float("nan"), 2.0])]
    return spark.createDataFrame(rows, "id long, fold int, block int, x array<double>, p array<double>").repartition(3), x, y


def test_profile_ridge_equals_a_plain_one(profile_table):
    df, x, y = profile_table
    alphas = (0.1, 10.0, 1000.0)
    fit, _b, alpha = profiles.fitted(df, "x", "p", "fold", alphas)
    got = {r.id: r for r in fit.collect()}
    assert sorted(got) == list(range(120))
    fold = np.arange(120) % 4
    forms = {"raw": y, "centred": y - y.mean(1, keepdims=True), "level": y.mean(1, keepdims=True)}

    def solve(train, t, a, sd):
        m, n = x[train].mean(0), t[train].mean(0)
        z = (x[train] - m) / sd
        b = np.linalg.solve(z.T @ z + a * np.eye(4), z.T @ (t[train] - n))
        return lambda q: (x[q] - m) / sd @ b + n

    at = 0
    for kind, t in forms.items():
        for f in range(4):
            train = fold != f
            sd = x[train].std(0)
            errors = {a: sum(((solve(train & (fold != g), t, a, sd)(fold == g) - t[fold == g]) ** 2).sum(0) for g in range(4) if g != f) for a in alphas}
            for k in range(t.shape[1]):
                best = min(sorted(alphas, reverse=True), key=lambda a: errors[a][k])
                assert alpha[f][at + k] == best
                p = solve(train, t, best, sd)(fold == f)[:, k]
                assert np.allclose([got[i][f"{kind}_oof"][k] for i in np.flatnonzero(fold == f)], p, atol=1e-8)
        at += t.shape[1]


def test_train_mean_and_scores_under_draws(profile_table):
    df, _x, y = profile_table
    rows = profiles.complete(df, "p")
    told = profiles.against_train_mean(rows, "p", "fold")
    fold, block = np.arange(120) % 4, np.arange(120) % 6
    p = np.stack([y[fold != f].mean(0) for f in fold])
    assert np.allclose([r.baseline for r in told.orderBy("id").collect()], p)
    draws = np.array([[2, 0, 1, 1, 1, 1], [0, 3, 3, 0, 0, 0]])
    got = profiles.scores(told, "p", "baseline", "block", list(range(6)), draws)
    for i, m in enumerate([np.ones(6, int), *draws]):
        a, b = np.repeat(y, m[block], axis=0), np.repeat(p, m[block], axis=0)
        sse, sst = ((a - b) ** 2).sum(0), ((a - a.mean(0)) ** 2).sum(0)
        want = {"r2_global": 1 - sse.sum() / sst.sum(), "r2_macro": (1 - sse / sst).mean(), "pearson_pooled": np.corrcoef(a.ravel(), b.ravel())[0, 1], "pearson_mean": np.mean([np.corrcoef(u, v)[0, 1] for u, v in zip(a, b)])}
        for k, v in want.items():
            assert abs((got[k][0] if i == 0 else got[k][1][i - 1]) - v) < 1e-8, k


def test_one_fold_has_no_train_mean(spark):
    df = spark.createDataFrame([(1, 0, [1.0, 2.0])], "id long, fold int, p array<double>")
    assert profiles.against_train_mean(df, "p", "fold").first().baseline == [None, None]


def test_level_r2_skips_what_is_missing(spark):
    rows = [(0, [1.0, 2.0, 4.0, None]), (1, [3.0, 1.0, 2.0, 5.0]), (2, [1.0, None, None, 2.0]), (3, [2.0, 2.0, 2.0, 2.0]), (4, None)]
    got = {r.id: r.r2 for r in profiles.r2_with_level(spark.createDataFrame(rows, "id long, p array<double>"), "p").collect()}
    y = np.array([[v if v is not None else np.nan for v in p] for _, p in rows[:4]])
    level = np.nanmean(y, 0)
    assert got[2] is None and got[3] is None and got[4] is None
    assert abs(got[0] - np.corrcoef(y[0, :3], level[:3])[0, 1] ** 2) < 1e-9
    assert abs(got[1] - np.corrcoef(y[1], level)[0, 1] ** 2) < 1e-9
