"""Readers on small files: matrices, stores, catalogs, annotation folders, association tables, wide series matrices."""

import math

import numpy as np
import pytest

from marlstone.operators import lookups, ordered, splits, stopping
from marlstone.sources import readers


def test_matrices_in_long_form(spark, tmp_path):
    spark.createDataFrame([("s1", 1, 0.5), ("s1", 2, math.nan), ("s2", 1, None)], "sample_name string, cpg_idx long, beta double").write.parquet(str(tmp_path / "b"))
    assert sorted((r.sample_name, r.cpg_idx, r.beta) for r in readers.beta_long(spark, str(tmp_path / "b")).collect() if r.beta) == [("s1", 1, 0.5)]
    assert readers.beta_long(spark, str(tmp_path / "b")).where("beta is null").count() == 2
    spark.createDataFrame([("s1", 1, 0.5)], "sample_name string, cpg_idx long, beta double").write.mode("append").parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="duplicate key"):
        readers.beta_long(spark, str(tmp_path / "b")).collect()
    wide = spark.createDataFrame([(1, 0.1, math.nan), (2, None, 0.4)], "probe long, a double, b double")
    assert sorted((r.probe, r.sample_name, r.beta) for r in readers.wide_to_long(wide, "probe").collect()) == [(1, "a", 0.1), (2, "b", 0.4)]


def test_stores_catalogs_and_annotations(spark, tmp_path):
    spark.createDataFrame([(7, [1.0, 2.0])], "vec_id long, X array<float>").write.parquet(str(tmp_path / "e"))
    assert [tuple(r) for r in readers.embedding_store(spark, str(tmp_path / "e")).collect()] == [(7, [1.0, 2.0])]
    spark.createDataFrame([(8, [1.0])], "vec_id long, X array<float>").write.mode("append").parquet(str(tmp_path / "e"))
    with pytest.raises(Exception, match="several widths"):
        readers.embedding_store(spark, str(tmp_path / "e")).collect()
    (tmp_path / "c.tsv").write_text("track_index\tname\n10\tx\n2\ty\n")
    assert [(r.ordinal, r.name) for r in readers.catalog(spark, str(tmp_path / "c.tsv")).orderBy("ordinal").collect()] == [(0, "y"), (1, "x")]
    for name in ("islands", "shores"):
        spark.range(2).coalesce(1).write.parquet(str(tmp_path / "ann" / f"{name}.parquet"))
    got = readers.annotations(spark, str(tmp_path / "ann" / "*.parquet"))
    assert sorted({r.set for r in got.collect()}) == ["islands", "shores"]
    (tmp_path / "a.tsv").write_bytes("p\ttrait\n1e-9\tSjögren\n0.5\tx\nNA\ty\n".encode("latin-1"))
    assert [r.trait for r in readers.associations(spark, str(tmp_path / "a.tsv")).collect()] == ["Sjögren"]


def test_series_matrix_of_many_samples(spark, tmp_path):
    n = 100_050
    ids, cells, values = "\t".join(f'"S{i}"' for i in range(n)), "\t".join('"Age: 3"' for _ in range(n)), "\t".join("0.5" for _ in range(n))
    (tmp_path / "m.txt").write_text(f'!Sample_geo_accession\t{ids}\n!Sample_characteristics_ch1\t{cells}\n!series_matrix_table_begin\n"ID_REF"\t{ids}\n"cg1"\t{values}\n')
    assert readers.series_matrix_values(spark, str(tmp_path / "m.txt")).count() == n
    assert readers.series_matrix_samples(spark, str(tmp_path / "m.txt")).count() == n


def test_places_within_groups_equal_sorted_ones(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), int(g)) for i, g in enumerate(rng.integers(0, 3, 300))]
    got = splits.hash_positions(spark.createDataFrame(rows, "k long, g int").repartition(5), "k", 9, ("g",)).collect()
    import hashlib

    for g in range(3):
        want = sorted((k for k, h in rows if h == g), key=lambda k: hashlib.sha256(f"{k}:9".encode()).hexdigest())
        assert [r.k for r in sorted((r for r in got if r.g == g), key=lambda r: r._rn)] == want and {r._n for r in got if r.g == g} == {len(want)}
    q = ordered.quantiles(spark.createDataFrame([(float(v), 1) for v in range(11)], "v double, g int"), "v", [0.0, 0.25, 1.0], ("g",)).first()
    assert q.quantiles == [0.0, 2.5, 10.0]


def test_contract_of_the_outer_join_leaks_and_tails(spark):
    df = lambda rows, s: spark.createDataFrame(rows, s)
    a, b = df([(1, "x"), (2, "y")], "k int, a string"), df([(1, 5), (2, 6)], "k int, b int")
    assert sorted(tuple(r) for r in lookups.paired_outer(a, b, "k").collect()) == [(1, "x", 5), (2, "y", 6)]
    for left, right, side in ((a, b.where("k = 1"), "left"), (a.where("k = 2"), b, "right")):
        with pytest.raises(Exception, match=f"only on the {side}"):
            lookups.paired_outer(left, right, "k").collect()
    with pytest.raises(Exception, match="duplicate key"):
        lookups.paired_outer(a.union(a), b, "k").collect()
    rows = df([("p", "train"), ("p", "train"), ("q", "train"), ("q", "test"), (None, "test"), (None, "train"), ("r", None)], "g string, s string")
    assert [tuple(r) for r in splits.leaks(rows, "g", "s").collect()] == [("q", 2)]
    by_group = splits.group_split(rows.select("g").where("g is not null").distinct(), "g", 1)
    assert splits.leaks(rows.join(by_group, "g"), "g", "split").count() == 0
    t = df([(1, e, v) for e, v in enumerate([3.0, 1.0, 1.0, math.nan, 5.0, 7.0])] + [(2, 0, 4.0), (3, 0, None)], "u int, e int, v double")
    got = {r.u: tuple(r)[1:] for r in stopping.tail_report(t, "u", ["e"], "v", 2).collect()}
    assert got == {1: (5, 1.0, 2, 6.0, False), 2: (1, 4.0, 1, 4.0, True)}
    places = splits.interleaved(df([(i, "ab"[i % 3 > 0]) for i in range(9)], "k int, p string"), "k", "p", 4).orderBy("place").collect()
    assert [r.p for r in places] == list("abababbbb"[:9]) and [r.place for r in places] == list(range(9))
