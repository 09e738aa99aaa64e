"""Sequences in many splits, prefix sums, chunk ledger and early stopping against plain versions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import lookups, stopping
from marlstone.sources import ledger, sequences


@pytest.fixture(scope="module")
def genome(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    seqs = {f"chr{i}": "".join(rng.choice(list("ACGTNacgt"), n, p=[0.1, 0.2, 0.2, 0.1, 0.1, 0.05, 0.1, 0.1, 0.05])) for i, n in enumerate((5000, 61, 1, 3000, 60))}
    text = "".join(f">{k} some words\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n\n" for k, s in seqs.items())
    path = tmp_path_factory.mktemp("fasta")
    (path / "a.fa").write_text(text)
    (path / "b.fa").write_text(">lone\nACG\nT\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "517")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    lines = sequences.fasta_lines(spark, str(path)).persist()
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 10 and lines.count() > 100
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    yield {**{k: s.upper() for k, s in seqs.items()}, "lone": "ACGT"}, lines
    lines.unpersist()


def test_lines_of_many_splits_make_up_the_records(genome):
    seqs, lines = genome
    rows = lines.collect()
    for k, s in seqs.items():
        own = sorted((r for r in rows if r.record == k), key=lambda r: r.offset)
        assert "".join(r.bases for r in own) == s and all(s[r.offset :].startswith(r.bases) for r in own)
        assert all(r.next_base == (s[r.offset + len(r.bases)] if r.offset + len(r.bases) < len(s) else None) for r in own)
    got = {(r.record, r.pos) for r in sequences.cg_positions(lines).collect()}
    assert got == {(k, m.start() + 1) for k, s in seqs.items() for m in re.finditer("CG", s)}


def test_windows_at_random_positions(spark, genome):
    seqs, lines = genome
    rng = np.random.default_rng(2)
    asks = [(i, k, int(rng.integers(1, len(seqs[k]) + 1))) for i, k in enumerate(rng.choice(list(seqs), 300))] + [(900, "absent", 5)]
    p = sequences.prefix_sums(lines)
    got = {r.id: r for r in sequences.composition(spark.createDataFrame(asks, "id long, record string, pos long"), p, "id", 70, 500.0).collect()}
    for i, k, pos in asks[:-1]:
        lo, hi = max(0, pos - 71), min(len(seqs[k]), pos + 70)
        w = seqs[k][lo:hi]
        known = len(w) - w.count("N")
        assert got[i].cg_count == seqs[k][lo : hi + 1].count("CG")
        assert got[i].gc_content is None if not known else abs(got[i].gc_content - (w.count("G") + w.count("C")) / known) < 1e-12
    assert 900 not in got or got[900].cg_count is None
    cgs = [(i, k, m.start() + 1) for k in ("chr0", "chr3") for i, m in enumerate(re.finditer("CG", seqs[k]), 1000 * int(k[3:]))]
    rate = {r["shift"]: r for r in sequences.cg_rate_at_offsets(spark.createDataFrame(cgs, "id long, record string, pos long"), p, "id", stretch=500.0).collect()}
    assert rate[0].rate == 1.0 and rate[0].n == len(cgs) and rate[1].rate == 0.0 == rate[-1].rate


def test_bases_before_a_header_are_an_error(spark, tmp_path):
    (tmp_path / "x.fa").write_text("ACGT\n>a\nAC\n")
    with pytest.raises(Exception, match="before any header"):
        sequences.fasta_lines(spark, str(tmp_path / "x.fa")).collect()


def test_a_killed_run_neither_loses_nor_repeats_rows(spark, tmp_path, monkeypatch):
    df = spark.range(100).select("id", (F.col("id") % 5).alias("part"))
    path = str(tmp_path / "t")
    commit, calls = ledger._commit, []

    def dies(s, p, row):
        calls.append(row[0])
        if len(calls) == 3:
            raise KeyboardInterrupt
        commit(s, p, row)

    monkeypatch.setattr(ledger, "_commit", dies)
    with pytest.raises(KeyboardInterrupt):
        ledger.materialise(df, "part", path, "v1")
    assert ledger.read(spark, path, df.schema).count() == 40
    monkeypatch.setattr(ledger, "_commit", commit)
    with pytest.raises(ValueError, match="other inputs"):
        ledger.materialise(df, "part", path, "v2")
    got = ledger.materialise(df, "part", path, "v1")
    assert sorted(r.id for r in got.collect()) == list(range(100))
    assert sorted(r.rows for r in ledger.committed(spark, path).collect()) == [20] * 5 and ledger.verify(spark, path, df.schema) == []
    folder = ledger.committed(spark, path).where("chunk = '1'").first().folder
    spark.range(1).select("id", F.lit(1).cast("long").alias("part")).write.mode("append").parquet(folder)
    assert ledger.verify(spark, path, df.schema) == ["1"]
    assert ledger.read(spark, str(tmp_path / "none"), df.schema).count() == 0


def plain_stopping(values, patience, least):
    """What a training loop does: (steps, reference, stalled, best, best_at, stopped, stopped_at)."""
    best, reference, stalled, history, stopped = math.inf, math.inf, 0, [], None
    for at, v in values:
        history.append((at, v))
        best = min(best, v)
        if v < reference * (1 - least):
            reference, stalled = v, 0
        else:
            stalled += 1
        if stalled >= patience:
            stopped = at
            break
    first = next(a for a, v in history if v == best)
    return len(history), reference, stalled, best, first, stopped is not None, stopped


def test_early_stopping_of_table_and_stream(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(int(u), e, float(v)) for u in range(12) for e, v in enumerate(np.round(5 * np.exp(-0.3 * np.arange(40)) + 0.2 * rng.random(40), 3))][: 12 * 40 - 35]
    df = spark.createDataFrame(rows + [(5, 99, None)], "user long, epoch int, loss double").repartition(7)
    want = {u: plain_stopping([(e, v) for k, e, v in rows if k == u], 4, 0.02) for u in range(12)}
    same = lambda r: (r.steps, r.reference, r.stalled, r.best, r.best_at, r.stopped, None if r.stopped_at is None or math.isnan(r.stopped_at) else r.stopped_at)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)  # keys go over batches
    got = {r.user: same(r) for r in stopping.early_stopping(df, "user", ["epoch"], "loss", 4, 0.02).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and any(w[5] for w in want.values())
    folder = str(tmp_path / "in")
    for lo in range(0, 120, 15):
        df.where(f"epoch >= {lo} and epoch < {lo + 15}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = stopping.early_stopping_stream(stream, "user", ["epoch"], "loss", 4, 0.02).writeStream.outputMode("update").format("memory").queryName("stops").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for r in sorted(spark.table("stops").collect(), key=lambda r: r.steps):
        last[r.user] = same(r)
    assert last == want


def test_a_split_is_dealt_out_in_pieces(spark, tmp_path, monkeypatch):
    s = {k: "".join(np.random.default_rng(n).choice(list("ACGT"), n)) for k, n in (("a", 7000), ("b", 31), ("c", 2000))}
    (tmp_path / "x.fa").write_text("".join(f">{k}\n" + "\n".join(v[i : i + 10] for i in range(0, len(v), 10)) + "\n\n" for k, v in s.items()))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() == 1
    monkeypatch.setattr(sequences, "PIECE", 5, raising=False)
    lines = sequences.fasta_lines(spark, str(tmp_path))
    rows = lines.collect()
    for k, v in s.items():
        told = sorted((r.offset, r.bases, r.next_base) for r in rows if r.record == k)
        assert told == [(i, v[i : i + 10], v[i + 10 : i + 11] or None) for i in range(0, len(v), 10)]
    assert "piece" in lines._jdf.queryExecution().optimizedPlan().toString()  # the windows' key is a piece, not the whole split


def test_points_are_not_sorted_for_the_latest_mark(spark):
    p, m = spark.createDataFrame([(1, 5), (2, 45), (3, 2), (4, None)], "id int, at long"), spark.createDataFrame([(3, "x"), (11, "y")], "at long, v string")
    got = lookups.last_at_or_before(p, m, "at", ["v"], width=10.0)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 3, "x"), (2, 45, 11, "y"), (3, 2, None, None)]
    assert "FullOuter" in got._jdf.queryExecution().optimizedPlan().toString()  # marks' latest meets the points' stretches
