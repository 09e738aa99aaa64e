"""Sparse estimators against dense ones on the same rows."""

import tracemalloc

import numpy as np
import pytest

from marlstone.operators import eigen, sparse


def table(spark, n=300, d=150, p=3, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, d)) < np.linspace(0.5, 0.02, d)) * rng.integers(1, 4, (n, d)).astype(float)
    z = rng.normal(size=(n, p)) * [1.0, 5.0, 0.0][:p] + 2
    y = z[:, 0] + 0.5 * x[:, 3] + rng.normal(size=n)
    y[5] = np.nan
    rows = [(i, np.flatnonzero(x[i]).tolist(), x[i][x[i] != 0].tolist(), z[i].tolist(), float(y[i]), int(i % 3)) for i in range(n)]
    return x, z, y, spark.createDataFrame(rows, "id long, i array<int>, v array<double>, z array<double>, y double, fold int").repartition(5)


@pytest.mark.parametrize("balanced", [False, True])
def test_components_are_those_of_a_dense_svd(spark, monkeypatch, balanced):
    monkeypatch.setattr(sparse, "COLUMNS", 40)  # sums go in several blocks
    x, z, _, df = table(spark)
    fit = np.arange(300) % 3 > 0
    m = sparse.fit_transform_map(df.where("fold > 0"), "i", "v", "z", 150, 12, balanced)
    std = z[fit].std(0)
    std[std < 1e-8] = 1
    scale = 1 / np.sqrt((x[fit] ** 2).sum() / (fit.sum() * 150)) / (np.sqrt(150) if balanced else 1)
    a = np.hstack([x * scale, (z - z[fit].mean(0)) / std / (np.sqrt(3) if balanced else 1)])
    _, s, vt = np.linalg.svd(a[fit], full_matrices=False)
    assert np.linalg.norm(m.components.T @ m.components - vt[:12].T @ vt[:12], 2) < 1e-6
    got = {r.id: np.array(r.embedding) for r in m.apply(df, "i", "v", "z").collect()}
    want = a @ m.components.T
    assert all(np.allclose(got[i], want[i], atol=1e-4) for i in range(300))
    assert (m.components[np.arange(12), np.abs(m.components).argmax(1)] > 0).all()
    t = a[fit] @ vt[:12].T
    assert abs(m.explained - t.var(0).sum() / a[fit].var(0).sum()) < 1e-6


def test_few_columns_are_kept_as_they_are(spark):
    x, z, _, df = table(spark, n=30, d=5)
    m = sparse.fit_transform_map(df, "i", None, "z", 5, 12)
    got = {r.id: r.embedding for r in m.apply(df, "i", None, "z").collect()}
    assert m.components is None and all(len(v) == 12 for v in got.values())
    assert np.allclose(got[3][:5], (x[3] > 0) * m.track_scale) and got[3][8:] == [0.0] * 4
    with pytest.raises(ValueError):
        sparse.fit_transform_map(df.limit(1), "i", None, "z", 5, 12)
    with pytest.raises(Exception, match="outside the columns"):
        sparse.fit_transform_map(df, "i", None, "z", 2, 12)


def test_associations_equal_residuals_of_dense_fits(spark):
    x, z, y, df = table(spark)
    got = sparse.residual_associations(df, "i", "v", "z", 150, "y", "fold")
    ok, fold = np.isfinite(y), np.arange(300) % 3
    xr, yr = np.zeros_like(x), np.zeros(300)
    for f in range(3):
        tr, te = ok & (fold != f), ok & (fold == f)
        c = np.column_stack([np.ones(300), z])
        inverse = np.linalg.pinv(c[tr].T @ c[tr] + 1e-6 * np.eye(4))
        xr[te] = x[te] - c[te] @ (inverse @ c[tr].T @ x[tr])
        yr[te] = y[te] - c[te] @ (inverse @ c[tr].T @ y[tr])
    want = xr.T @ yr / np.sqrt((xr**2).sum(0) * (yr @ yr))
    assert np.allclose(got, want, atol=1e-8) and got[3] == got.max()


def test_eigenpairs_of_close_values():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    e = np.concatenate([[5.0, 4.999, 4.99, 4.9], np.linspace(4.5, 0.1, 196)])
    values, found, worst, made = eigen.lobpcg(lambda b: (q * e) @ (q.T @ b), 200, 4)
    assert np.allclose(values, e[:4], rtol=1e-12) and worst < 1e-13 and made < 60
    assert np.allclose(np.abs((q[:, :4] * found).sum(0)), 1, atol=1e-10)
    assert eigen.lobpcg(lambda b: 0 * b, 5, 2)[0].tolist() == [0, 0]


def test_products_take_bounded_work_space():
    entries, width = 1_000_000, 48
    rng = np.random.default_rng(1)
    row, column, right = np.sort(rng.integers(0, 10_000, entries)), rng.integers(0, 400, entries), rng.normal(size=(400, width))
    tracemalloc.start()
    got = sparse._times(row, column, np.ones(entries), right, 10_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - got.nbytes < 100e6  # entries x width doubles are 384 MB
    assert np.allclose(got[17], right[column[row == 17]].sum(0))
