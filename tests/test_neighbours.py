"""Exact neighbours by pivots against all pairs."""

import numpy as np
import pytest

from marlstone.operators import neighbours


def plain(x, ids, q, qids, k, metric):
    if metric == "cosine":
        norm = lambda a: a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        s = norm(q) @ norm(x).T
    else:
        s = -np.sqrt(((q[:, None] - x[None]) ** 2).sum(-1))
    out = {}
    for i, row in enumerate(s):
        order = [j for j in sorted(range(len(ids)), key=lambda j: (-round(row[j], 9), ids[j])) if ids[j] != qids[i]][:k]
        out[qids[i]] = [(ids[j], row[j]) for j in order]
    return out


def check(spark, x, metric, k=4, q=None):
    ids = list(range(len(x)))
    frame = lambda a, i: spark.createDataFrame([(int(n), v.tolist()) for n, v in zip(i, a)] + [(10_000, None)], "id long, v array<double>").repartition(3)
    counted = spark.sparkContext.accumulator(0)
    qids = ids if q is None else [5_000 + i for i in range(len(q))]
    got = neighbours.nearest_vectors(frame(x, ids), "id", "v", k, None if q is None else frame(q, qids), metric, counted).collect()
    want = plain(x, ids, x if q is None else q, qids, k, metric)
    mine = {}
    for r in sorted(got, key=lambda r: (r.query, r["rank"])):
        mine.setdefault(r.query, []).append((r.neighbour, r.similarity))
    assert set(mine) == {i for i, w in want.items() if w}  # a query without any neighbour has no row
    for i, w in ((i, w) for i, w in want.items() if w):
        assert np.allclose([v for _, v in mine[i]], [v for _, v in w], atol=1e-7)
        # ids agree unless two candidates are nearer to each other than rounding
        differ = [(a, b) for (a, _), (b, _) in zip(mine[i], w) if a != b]
        assert len(mine[i]) == len(w) == len({n for n, _ in mine[i]}) and all(abs(dict(w).get(a, w[-1][1]) - dict(w)[b]) < 1e-8 for a, b in differ)
    return counted.value


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_clusters_are_searched_in_few_cells(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    monkeypatch.setattr(neighbours, "QUERIES", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 8))[rng.integers(20, size=600)] + 0.01 * rng.normal(size=(600, 8))
    assert check(spark, x, metric) < 0.35 * 600 * 600
    check(spark, x, metric, q=rng.normal(size=(30, 8)))


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_scattered_vectors_copies_and_zero_vectors(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(150, 6))
    x[20:90] = x[0]  # a class of copies
    x[100], x[120] = 0, 0
    check(spark, x, metric)


def test_few_rows_and_none(spark):
    check(spark, np.eye(3), "cosine", k=5)
    check(spark, np.ones((1, 2)), "euclidean")
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert neighbours.nearest_vectors(empty, "id", "v", 3).count() == 0


def test_queries_that_visit_every_cell_are_written_once(spark, monkeypatch):
    """A query that pivots cannot guide goes to each block, not to each cell, and no table of such copies is written."""
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    written, cut = [], neighbours.cut
    monkeypatch.setattr(neighbours, "cut", lambda df: written.append(cut(df)) or written[-1])
    check(spark, np.random.default_rng(4).normal(size=(400, 24)), "cosine")
    assert max(df.count() for df in written) <= 400


def test_distances_held_at_once_are_bounded(monkeypatch):
    rng, held, plain = np.random.default_rng(5), [], neighbours._likeness
    x, p = rng.normal(size=(900, 4)), rng.normal(size=(64, 4))
    want = plain(x, p, "euclidean").argmax(1)
    monkeypatch.setattr(neighbours, "_likeness", lambda *a: held.append(len(a[0]) * len(a[1])) or plain(*a))
    monkeypatch.setattr(neighbours, "ROOM", 6_400)
    cell, away = neighbours._located(x, p, "euclidean")
    assert (cell == want).all() and np.allclose(away, np.sqrt(((x - p[want]) ** 2).sum(1))) and max(held) <= 6_400
