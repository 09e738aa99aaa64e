"""Greedy matching against one plain loop over the cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import case_control


def tie(i, seed):
    return int(hashlib.sha256(f"{i}:{seed}".encode()).hexdigest()[:12], 16)


def plain(cases, pool, calipers, n, seed, replace, sd):
    """cases and pool: rows (id, stratum, values). -> {(case, control, rank)}, {case: reason}."""
    case_ids = {c[0] for c in cases}
    pool = [p for p in pool if p[0] not in case_ids]
    sound = lambda r: r[1] is not None and all(v is not None and math.isfinite(v) for v in r[2])
    strata = {p[1] for p in pool if sound(p)}
    used, pairs, reasons = set(), set(), {}
    for c in sorted(cases, key=lambda c: (tie(c[0], seed), c[0])):
        if not sound(c):
            reasons[c[0]] = "missing"
            continue
        if c[1] not in strata:
            reasons[c[0]] = "no_stratum"
            continue
        near = [p for p in pool if sound(p) and p[1] == c[1] and all(k is None or abs(a - b) <= k for a, b, k in zip(p[2], c[2], calipers))]
        free = [p for p in near if p[0] not in used]
        free.sort(key=lambda p: (float(sum((np.abs(np.array(p[2]) - np.array(c[2])) / sd) ** 2)), tie(p[0], seed), p[0]))
        for r, p in enumerate(free[:n]):
            pairs.add((c[0], p[0], r))
            if not replace:
                used.add(p[0])
        if not free:
            reasons[c[0]] = "exhausted" if near else "out_of_caliper"
    return pairs, reasons


def check(spark, cases, pool, calipers, n=1, seed=3, replace=False):
    schema = "k long, s string, " + ", ".join(f"v{i} double" for i in range(len(calipers)))
    flat = lambda rows: spark.createDataFrame([(r[0], r[1], *r[2]) for r in rows], schema).repartition(3)
    ids = {c[0] for c in cases}
    sd = np.array([np.nanstd([math.nan if p[2][i] is None else p[2][i] for p in pool if p[0] not in ids], ddof=1) or 1.0 for i in range(len(calipers))])
    got = case_control.match_controls(flat(cases), flat(pool), "k", ("s",), {f"v{i}": c for i, c in enumerate(calipers)}, n=n, seed=seed, replace=replace)
    pairs, reasons = plain(cases, pool, calipers, n, seed, replace, sd)
    assert {(r.case, r.control, r["rank"]) for r in got.pairs.collect()} == pairs
    assert {r.case: r.reason for r in got.unmatched.collect()} == reasons
    return got


@pytest.mark.parametrize("n,replace", [(1, False), (2, False), (2, True)])
def test_two_hundred_strata_equal_one_loop(spark, n, replace):
    rng = np.random.default_rng(n)
    row = lambda i: (int(i), f"s{rng.integers(200)}", (float(rng.integers(0, 30)), float(np.round(rng.normal(), 1))))
    check(spark, [row(i) for i in range(900)], [row(i) for i in range(850, 2400)], (2.0, None), n=n, replace=replace)


@pytest.mark.parametrize("kind", ["spread", "ties", "one value"])
def test_one_stratum_runs_in_many_stretches(spark, kind, monkeypatch):
    monkeypatch.setattr(case_control, "STRETCH", 40)
    rng = np.random.default_rng(1)
    value = {"spread": lambda: float(rng.uniform(0, 100)), "ties": lambda: float(rng.integers(0, 60)), "one value": lambda: 5.0}[kind]
    row = lambda i: (int(i), "s", (value(), float(rng.normal())))
    got = check(spark, [row(i) for i in range(300)], [row(i) for i in range(300, 700)], (0.5 if kind == "spread" else 1.0, 1.5))
    assert got.rounds <= 2 if kind == "one value" else got.rounds > 1


def test_missing_rows_repeats_and_empty_tables(spark):
    cases = [(1, "a", (1.0,)), (2, None, (1.0,)), (3, "a", (None,)), (4, "zz", (1.0,)), (5, "a", (50.0,)), (6, "a", (1.0,)), (7, "a", (math.nan,))]
    pool = [(1, "a", (1.0,)), (10, "a", (1.25,)), (11, "a", (None,)), (12, None, (1.0,)), (13, "b", (9.0,))]
    got = check(spark, cases, pool, (1.0,))
    assert {r.reason for r in got.unmatched.collect()} == {"missing", "no_stratum", "out_of_caliper", "exhausted"}
    none = check(spark, [], pool, (1.0,))
    assert none.pairs.count() == 0 == none.unmatched.count()
    check(spark, cases, [], (1.0,))
    twice = spark.createDataFrame([(20, 1.0), (20, 1.0)], "k long, v double")
    assert case_control.match_controls(twice, spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0)], "k long, v double"), "k", (), {"v": 1.0}, n=2).pairs.count() == 2
    assert case_control.match_controls(twice, spark.createDataFrame([(1, 9.0)], "k long, v double"), "k").pairs.count() == 1  # no covariate at all: hash order


def test_balance_before_and_after(spark):
    rng = np.random.default_rng(8)
    cases = spark.createDataFrame([(i, float(rng.normal(1)), "ab"[i % 2] if i % 5 else None) for i in range(80)], "k long, v double, c string")
    pool = spark.createDataFrame([(i, float(rng.normal(0, 1.5)), "abc"[i % 3]) for i in range(100, 900)], "k long, v double, c string")
    m = case_control.match_controls(cases, pool, "k", (), {"v": 0.3}, seed=1)
    got = {(r.covariate, r.level): r for r in case_control.balance(cases, pool, m.pairs, "k", ["v"], ["c"]).collect()}
    a, b, pairs = cases.toPandas().set_index("k"), pool.toPandas().set_index("k"), m.pairs.toPandas()
    s = lambda x, y: (x.mean() - y.mean()) / np.sqrt((x.var(ddof=0) + y.var(ddof=0)) / 2)
    assert abs(got["v", None].smd_before - s(a.v, b.v)) < 1e-9
    assert abs(got["v", None].smd_after - s(a.loc[pairs.case.unique()].v, b.loc[pairs.control].v)) < 1e-9
    assert abs(got["v", None].smd_after) < abs(got["v", None].smd_before)
    u = lambda d, v: (d.c.fillna("unknown") == v).astype(float)
    assert {k[1] for k in got if k[0] == "c"} == {"a", "b", "c", "unknown"}
    assert abs(got["c", "unknown"].smd_before - s(u(a, "unknown"), u(b, "unknown"))) < 1e-9


def test_matching_query_keeps_its_contract(spark, sf):
    from marlstone.plans import registry

    registry.load()
    got = registry.QUERIES["jn25_greedy_matching"](spark, sf).collect()
    where = {r.c_custkey: r for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("b")).collect()}
    assert len({r.control_id for r in got}) == len(got) > 0
    for r in got:
        c, p = where[r.case_id], where[r.control_id]
        assert c.c_nationkey < 5 <= p.c_nationkey and c.c_mktsegment == p.c_mktsegment and abs(c.b - p.b) <= 400


def test_crowded_stretches_end_in_few_rounds(spark, monkeypatch):
    """Cases that all prefer the same few controls: a round settles whole stretches, not only the first cases of each."""
    monkeypatch.setattr(case_control, "STRETCH", 40)
    rng = np.random.default_rng(6)
    row = lambda i, k: (int(i), "s", (float(np.round(rng.uniform(0, 100), 2)), float(k)))
    got = check(spark, [row(i, rng.integers(0, 5)) for i in range(150)], [row(i, rng.integers(5, 25)) for i in range(150, 750)], (4.0, None), n=2)
    assert got.rounds <= 8
