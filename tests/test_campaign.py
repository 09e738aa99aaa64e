"""The eleven endpoints and their replicates against plain versions."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import bootstrap
from marlstone.plans import campaign

rng = np.random.default_rng(11)


def weighted_spearman(x, y, w):
    def ranks(v):
        at = pd.Series(w).groupby(v).sum().sort_index()
        mid = at.cumsum() - at / 2
        return mid.loc[v].to_numpy()

    a, b = ranks(x), ranks(y)
    ma, mb = np.average(a, weights=w), np.average(b, weights=w)
    return np.average((a - ma) * (b - mb), weights=w) / np.sqrt(np.average((a - ma) ** 2, weights=w) * np.average((b - mb) ** 2, weights=w))


def test_weighted_spearman_under_draws(spark):
    n = 300
    x, y = rng.integers(0, 40, n).astype(float), rng.integers(0, 30, n).astype(float)
    g, w = rng.integers(0, 5, n), rng.choice([0.5, 1.75], n)
    df = spark.createDataFrame([("k", *map(float, (a, b, v)), int(k)) for a, b, v, k in zip(x, y, w, g)], "key string, x double, y double, w double, g int").repartition(4)
    draws = np.array([[1, 2, 0, 1, 1], [0, 5, 0, 0, 0]])
    value, reps = bootstrap.spearman_replicates(df, "key", "x", "y", "g", list(range(5)), draws, F.col("w"))["k"]
    assert abs(value - weighted_spearman(x, y, w)) < 1e-9
    for m, r in zip(draws, reps):
        keep = m[g] > 0
        assert abs(r - weighted_spearman(x[keep], y[keep], (w * m[g])[keep])) < 1e-9
    plain = bootstrap.spearman_replicates(df, "key", "x", "y", "g", list(range(5)), draws)["k"]
    assert abs(plain[0] - weighted_spearman(x, y, np.ones(n))) < 1e-9


def test_ratio_under_draws(spark):
    rows = [("a", 0, 1.0, 2.0), ("a", 0, 0.0, 1.0), ("a", 1, 3.0, 1.0), ("b", 1, None, 4.0)]
    df = spark.createDataFrame(rows, "key string, g int, p double, q double")
    got = bootstrap.ratio_replicates(df, "key", F.col("p"), F.col("q"), "g", [0, 1], np.array([[2, 0], [0, 2], [1, 1]]))
    assert got["a"][0] == 1.0 and got["a"][1].tolist() == [1 / 3, 3.0, 1.0]
    assert got["b"][0] == 0.0 and np.isnan(got["b"][1][0]) and got["b"][1][1] == 0.0


@pytest.fixture(scope="module")
def told(spark, sf):
    return campaign.statistics(spark, sf)


def test_every_endpoint_has_both_arms_and_draws(told):
    assert set(told) == {(e, a) for e in campaign.ENDPOINTS for a in campaign.ARMS}
    assert len(campaign.ENDPOINTS) == 11 and len(campaign.PRIMARY) == 4
    assert all(np.isfinite(v) and r.shape == (campaign.DRAWS,) for v, r in told.values())


def test_contact_endpoints_equal_sql(told, sf):
    c = duckdb.connect()
    for t in ("lineitem", "embeddings", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cos = "round(list_inner_product(a.{0}, b.{0}) / sqrt(list_inner_product(a.{0}, a.{0}) * list_inner_product(b.{0}, b.{0})), 9) AS {0}"
    t = c.execute(
        f"""WITH e AS (SELECT vec_id AS i, label, list_slice(embedding::DOUBLE[], 1, 32) AS first, list_slice(embedding::DOUBLE[], 33, 64) AS second FROM embeddings JOIN part ON p_partkey = vec_id WHERE label IS NOT NULL),
        l AS (SELECT DISTINCT l_orderkey AS k, l_partkey AS i FROM lineitem JOIN e ON e.i = l_partkey), met AS (SELECT a.i, b.i AS j FROM l a JOIN l b ON a.k = b.k AND a.i < b.i GROUP BY ALL),
        d AS (SELECT i, ('0x' || substr(sha256('{campaign.SEED + 1}:' || i || ':' || j), 1, 12))::BIGINT % (SELECT count(*) FROM embeddings) AS k FROM met),
        o AS (SELECT least(i, k) AS i, greatest(i, k) AS j FROM d WHERE i <> k EXCEPT SELECT i, j FROM met), t AS (SELECT i, j, 1 AS y FROM met UNION ALL SELECT i, j, 0 FROM o)
        SELECT y, a.label <> b.label AS across, {cos.format('first')}, {cos.format('second')} FROM t JOIN e a ON a.i = t.i JOIN e b ON b.i = t.j"""
    ).fetchdf()
    for name, rows in (("contact", t), ("contact_between_blocks", t[t.across])):
        for arm in campaign.ARMS:
            p = rows.y == 1
            u = rows[arm].rank()[p].sum() - p.sum() * (p.sum() + 1) / 2
            assert abs(told[name, arm][0] - u / (p.sum() * (~p).sum())) < 1e-9


def test_enrichment_equals_brute_force(told, spark, sf):
    rows = campaign.loci(spark, sf).select("i", "marker", *campaign.ARMS).toPandas().sort_values("i").reset_index(drop=True)
    marker = rows.marker.to_numpy(float)
    share = {m: np.mean(marker == m) for m in set(marker[~np.isnan(marker)])}
    for arm in campaign.ARMS:
        x = np.stack(rows[arm]).astype(float)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = x @ x.T
        np.fill_diagonal(s, -np.inf)
        asked = np.flatnonzero(~np.isnan(marker))
        near = np.argsort(-s[asked], axis=1, kind="stable")[:, : campaign.NEIGHBOURS]
        observed = (marker[near] == marker[asked][:, None]).sum()
        assert abs(told["marker_neighbours", arm][0] - observed / sum(share[m] * campaign.NEIGHBOURS for m in marker[asked])) < 1e-9


def test_statistics_read_written_rows(spark, sf, monkeypatch):
    read = {}
    for name in ("auroc_replicates", "spearman_replicates"):
        monkeypatch.setattr(bootstrap, name, lambda df, *a, name=name, **k: read.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or {})
    campaign.statistics(spark, sf)
    assert len(read) == 2 and not any(k in plan for plan in read.values() for k in ("ArrowEvalPython", "Join", "Aggregate"))  # no second fit, join or prediction
