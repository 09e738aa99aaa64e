"""Contracts, estimators, inference, matching, readers, sinks and the stream, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import coords
from marlstone.operators import contracts, inference, linear, lookups, ordered
from marlstone.sources import readers, sinks
from marlstone.streaming import moments


def test_contracts_raise(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="duplicate key"):
        contracts.require_unique(twice, "k").collect()
    with pytest.raises(Exception, match="not found"):
        lookups.strict_lookup(spark.createDataFrame([(2,)], "k int"), twice.limit(1), "k").collect()
    with pytest.raises(Exception, match="overlap"):
        contracts.require_disjoint(twice.select("k"), twice.select("k"), "k").collect()
    with pytest.raises(ValueError):
        contracts.require_columns(twice, ["k"], ["v"])
    with pytest.raises(Exception, match="unsupported"):
        spark.createDataFrame([("chrUn",)], "c string").select(coords.strict_chromosome(F.col("c"))).collect()


def test_labels(spark):
    got = spark.createDataFrame([(c,) for c in ("1", "chr1", "CHR1", "23", "MT", "chrUn", None)], "c string").select(coords.nullable_chromosome(F.col("c")), coords.chromosome_code(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [("chr1", 1)] * 3 + [("chrX", 23), ("chrM", 25), (None, -1), (None, -1)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "k long, x double")
    assert ordered.mid_ranks(empty, "x").count() == 0
    assert [r.auroc for r in ordered.auroc(empty, "x", F.col("k") == 1).collect()] == [None]
    assert lookups.last_at_or_before(empty, empty.withColumn("p", F.lit(1)), "x", ["p"], width=1.0).count() == 0


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x, fold = rng.normal(size=(200, 4)), np.arange(200) % 4
    y = x @ [1, -2, 0.5, 0] + 3 + 0.1 * rng.normal(size=200)
    df = spark.createDataFrame([(x[i].tolist(), float(y[i]), int(fold[i])) for i in range(200)], "x array<double>, y double, fold int").repartition(5)
    b, chosen = linear.blocked_ridge(df, "x", "y", "fold", [0.1, 10.0])
    for f in range(4):
        a = np.column_stack([x, np.ones(200)])[fold != f]
        p = np.diag([chosen[f]] * 4 + [0])
        assert np.allclose(b[f], np.linalg.solve(a.T @ a + p, a.T @ y[fold != f]))
    got = linear.out_of_fold(df, "x", "fold", b).select("x", "fold", "prediction").collect()
    for r in got:
        assert abs(r.prediction - (np.array([*r.x, 1.0]) @ b[r.fold])) < 1e-9


def test_axes_are_those_of_the_covariance(spark):
    x = np.random.default_rng(1).normal(size=(100, 3)) * [3, 2, 1]
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    mean, axes, values = linear.principal_axes(df, "x", 2)
    want = np.linalg.eigvalsh(np.cov(x.T, ddof=0))[::-1][:2]
    assert np.allclose(values, want) and np.allclose(mean, x.mean(0))
    assert all(a[np.abs(a).argmax()] > 0 for a in axes)


def test_bootstrap_draws_are_shared_between_arms(spark):
    cells = spark.createDataFrame([(a, b, float(b + (a == "y")), 1.0) for a in "xy" for b in range(10)], "arm string, block int, total double, n double")
    got = {(r.arm, r.replicate): r.mean for r in inference.block_bootstrap(cells, "arm", "block", "total", "n", 50, 3).collect()}
    assert all(abs(got["y", i] - got["x", i] - 1) < 1e-9 for i in range(50))


def test_multiplicity_with_nulls_and_ties(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.04), ("d", None)], "name string, p double")
    holm = {r.name: r.p_holm for r in inference.holm(df, "p", "name").collect()}
    assert holm["d"] is None and abs(holm["a"] - 0.03) < 1e-12 and abs(holm["b"] - 0.08) < 1e-12 and abs(holm["c"] - 0.08) < 1e-12


def test_bands_and_overlaps_match_brute_force(spark):
    rng = np.random.default_rng(4)
    a = [(int(i), int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(-50, 200, 60), rng.integers(0, 40, 60)))]
    df = spark.createDataFrame(a, "id int, start long, stop long")
    got = {(r.id, r.r_id) for r in lookups.overlapping(df, df, 16).collect()}
    assert got == {(x[0], y[0]) for x in a for y in a if x[1] <= y[2] and y[1] <= x[2]}
    p = df.select("id", F.col("start").alias("pos"))
    got = [(r.id, r.r_id) for r in lookups.within(p, p, 7).collect()]
    assert sorted(got) == sorted((x[0], y[0]) for x in a for y in a if abs(x[1] - y[1]) <= 7)


def test_readers(spark, tmp_path):
    (tmp_path / "a.bed").write_text("chr1\t9\t20\tx\nchrUn\t1\t2\ty\n")
    assert [(r.chrom, r.start, r.end) for r in readers.bed(spark, str(tmp_path / "a.bed")).collect()] == [("chr1", 10, 20)]
    (tmp_path / "g.gtf").write_text("#c\nchr1\ts\ttranscript\t5\t9\t.\t+\t.\tz\nchr1\ts\ttranscript\t5\t9\t.\t-\t.\tz\nchr1\ts\tgene\t1\t9\t.\t-\t.\tz\n")
    assert sorted(r.tss for r in readers.gtf_tss(spark, str(tmp_path / "g.gtf")).collect()) == [4, 8]
    (tmp_path / "m.txt").write_text('!Sample_geo_accession\t"S1"\t"S2"\n!Sample_characteristics_ch1\t"Age: 3"\t"Age: 4"\n!series_matrix_table_begin\n"ID_REF"\t"S1"\t"S2"\n"cg1"\t0.5\tnull\n')
    assert sorted((r.sample, r.key, r.value) for r in readers.series_matrix_samples(spark, str(tmp_path / "m.txt")).collect()) == [("S1", "age", "3"), ("S2", "age", "4")]
    assert [(r.probe, r.value) for r in readers.series_matrix_values(spark, str(tmp_path / "m.txt")).orderBy("at").collect()] == [("cg1", 0.5), ("cg1", None)]
    (tmp_path / "p.pat").write_text("chr1\t10\tCT.C\t2\nchr1\t11\tT\t1\n")
    assert sorted((r.cpg, r.methylated, r.covered) for r in readers.pat_counts(spark, str(tmp_path / "p.pat")).collect()) == [(10, 2, 2), (11, 0, 3), (13, 2, 2)]
    (tmp_path / "r" / "1").mkdir(parents=True)
    (tmp_path / "r" / "1" / "summary.json").write_text('{"dataset":"d","representation":"e","seed":1,"evaluation":{"v":{"m":{"mse":0.5}}}}')
    assert [(r.dataset, r.view, r.mask, r.metric, r.value) for r in readers.run_summaries(spark, str(tmp_path / "r")).collect()] == [("d", "v", "m", "mse", 0.5)]
    (tmp_path / "s.fa").write_text(">c1 x\nACGT\nCGNN\n>c2\nGG\n")
    assert sorted(tuple(r) for r in readers.fasta_windows(spark, str(tmp_path / "s.fa"), 4).collect()) == [("c1", 0, 2, 1, 4), ("c1", 1, 2, 1, 2), ("c2", 0, 2, 0, 2)]
    runs = readers.contiguous_runs(spark.createDataFrame([(x,) for x in (1, 2, 3, 7, 8, 8)], "x int"), "x")
    assert sorted((r.first, r.last, r.n) for r in runs.collect()) == [(1, 3, 3), (7, 8, 2)]


def test_sinks(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    root = str(tmp_path)
    with pytest.raises(ValueError):
        sinks.guarded(df, "/elsewhere/x", root)
    with pytest.raises(ValueError):
        sinks.guarded(df, f"{root}/frozen/x", root, frozen=(f"{root}/frozen",))
    assert sinks.resume(df, f"{root}/t", "id").count() == 10
    sinks.guarded(df.where("id < 4"), f"{root}/t", root)
    assert sinks.resume(df, f"{root}/t", "id").count() == 6
    assert sinks.manifest(df).first() == sinks.manifest(df.repartition(3)).first() != sinks.manifest(df.limit(9)).first()
    sinks.verify_or_create(spark, df, f"{root}/p")
    sinks.verify_or_create(spark, df.repartition(2), f"{root}/p")
    with pytest.raises(ValueError):
        sinks.verify_or_create(spark, df.limit(3), f"{root}/p")


def test_stream_equals_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.orderBy("ts").coalesce(1).write.parquet(folder)
    stream = moments.windowed_moments(moments.event_stream(spark, folder, events.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windowed").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r.start), r.event_type, r.n, round(r.mean, 6)) for r in df.where("n > 0").collect())
    assert key(spark.table("windowed")) == key(moments.windowed_moments(events))
