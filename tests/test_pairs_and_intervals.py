"""Sampled pair spaces and interval overlaps against listed ones."""

import math

import numpy as np
import pytest

from marlstone.operators import intervals, pair_space


def test_products_are_capped_and_uniform(spark):
    left = spark.createDataFrame([("big", i) for i in range(60)] + [("small", 1), ("small", 2), ("left only", 5)], "k string, a long")
    right = spark.createDataFrame([("big", 100 + i) for i in range(70)] + [("small", 7), ("right only", 5)], "k string, b long")
    got = pair_space.capped_products(left, right, "k", "a", "b", 20, 3).collect()
    big, small = [(r.a, r.b) for r in got if r.k == "big"], [(r.a, r.b) for r in got if r.k == "small"]
    assert len(big) == len(set(big)) == 20 and sorted(small) == [(1, 7), (2, 7)] and len(got) == 22
    many = pair_space.capped_products(left, right, "k", "a", "b", 2000, 3).where("k = 'big'").toPandas()
    assert len(many.drop_duplicates()) == 2000 and abs((many.a < 30).mean() - 0.5) < 0.05 and abs((many.b < 135).mean() - 0.5) < 0.05
    assert pair_space.capped_products(left.limit(0), right, "k", "a", "b", 20, 3).count() == 0


@pytest.mark.parametrize("wanted", [5, 60, 100_000])
def test_binned_pairs_lie_in_their_bins(spark, wanted):
    rng = np.random.default_rng(5)
    pts = [(int(i), f"c{rng.integers(3)}", int(p)) for i, p in enumerate(rng.integers(0, 400, 300))]
    edges = [0, 1, 10, 100, math.inf]
    got = pair_space.binned_pairs(spark.createDataFrame(pts, "id long, chrom string, pos long"), edges, wanted, 7, 50.0).collect()
    where = {i: (c, p) for i, c, p in pts}
    sizes = {k: 0 for k in range(4)}
    for a in pts:
        for b in pts:
            if a[0] < b[0] and a[1] == b[1]:
                sizes[next(k for k in range(4) if edges[k] <= abs(a[2] - b[2]) < edges[k + 1])] += 1
    assert len({(r.i, r.j) for r in got}) == len(got)
    for r in got:
        assert r.i < r.j and where[r.i][0] == where[r.j][0] and r.distance == abs(where[r.i][1] - where[r.j][1]) and edges[r.bin] <= r.distance < edges[r.bin + 1]
    assert {k: sum(r.bin == k for r in got) for k in range(4)} == {k: min(n, wanted) for k, n in sizes.items()}


@pytest.mark.parametrize("wanted", [40, 100_000])
def test_crossing_pairs(spark, wanted):
    rng = np.random.default_rng(6)
    pts = [(int(i), f"c{c}") for i, c in enumerate(rng.choice([0, 1, 2, 7], 80, p=[0.6, 0.2, 0.1, 0.1]))]
    got = pair_space.crossing_pairs(spark.createDataFrame(pts, "id long, chrom string"), wanted, 7).collect()
    where = dict(pts)
    n = sum(where[a] != where[b] for a in where for b in where if a < b)
    assert len(got) == len({(r.i, r.j) for r in got}) == min(n, wanted)
    assert all(r.i < r.j and where[r.i] != where[r.j] for r in got)


def test_overlaps_of_mixed_lengths(spark):
    rng = np.random.default_rng(7)
    make = lambda n: [(int(i), "xy"[rng.integers(2)], int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(-300, 1000, n), (2 ** rng.uniform(-1, 11, n)).astype(int)))]
    a, b = make(120) + [(900, "x", 5, 4), (901, None, 1, 2), (902, "x", None, 2)], make(150) + [(900, "x", 7, 6), (901, "x", -5, 10_000)]
    df = lambda rows: spark.createDataFrame(rows, "id long, t string, start long, stop long")
    hit = lambda x, y: x[1] is not None and x[1] == y[1] and None not in (x[2], y[2]) and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
    got = [(r.id, r.r_id) for r in intervals.overlap_pairs(df(a), df(b), ("t",)).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in a for y in b if hit(x, y))
    flags = {r.id: r.overlaps for r in intervals.with_overlap_flag(df([x for x in a if x[2] is not None]), df(b), ("t",), 64.0).collect()}
    assert flags == {x[0]: any(hit(x, y) for y in b) for x in a if x[2] is not None}
    loci = spark.createDataFrame([(i, "xy"[i % 2], i) for i in range(-50, 200, 3)], "locus long, t string, pos long")
    inside = [(r.id, r.r_locus) for r in intervals.expand_blocks(df(a), loci, ("t",)).collect()]
    assert sorted(inside) == sorted((x[0], i) for x in a for i in range(-50, 200, 3) if hit(x, (0, "xy"[i % 2], i, i)))
    assert intervals.overlap_pairs(df(a), df([]), ("t",)).count() == 0 == intervals.overlap_pairs(df([]), df(b), ("t",)).count()


def test_partners_are_shuffled_as_lists(spark, tmp_path):
    """200 sets that share one part: 39,800 pairs, which no shuffle writes."""
    import __spark_entry__ as entry

    line = spark.range(200).selectExpr("id AS l_suppkey", "7L AS l_partkey", "'R' AS l_returnflag")
    line.write.parquet(f"{tmp_path}/lineitem.parquet")
    out = entry.queries()["jn32_best_overlap_partner"](spark, str(tmp_path))
    store = spark.sparkContext._jsc.sc().statusStore()
    array = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    stages = lambda: {s.stageId(): s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, array, None))}
    before = set(stages())
    rows = {r.s: (r.partner, r.jaccard) for r in out.collect()}
    assert rows == {s: (0 if s else 1, 1.0) for s in range(200)}
    assert max(n for s, n in stages().items() if s not in before) < 5_000
