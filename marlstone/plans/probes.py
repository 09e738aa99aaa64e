"""Probes, compression, imputation and eigenvectors as queries, and the composites built on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import maths, vectors
from marlstone.operators import inference, ordered, probes
from marlstone.plans.registry import query
from marlstone.session import table
from marlstone.sources import sinks

ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)
LOO_ALPHAS = tuple(float(a) for a in np.logspace(-2, 4, 13))


def vectors_of(spark, sf_dir):
    """Vectors with a group (for chromosomes), a fold that no group crosses, and a target."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    e = e.withColumn("chrom", F.pmod(F.xxhash64("vec_id"), F.lit(11)).cast("int"))
    return e.withColumn("fold", (F.col("chrom") % 5).cast("int")).withColumn("y", F.col("label").cast("double")).withColumn("positive", (F.col("label") % 2).cast("double"))


@query("ml3_nested_ridge_probe")
def _(spark, sf_dir):
    parts = probes.sums(vectors_of(spark, sf_dir).withColumn("t", F.array("y")), "embedding", "t", "chrom")
    p = probes.nested_ridge(parts)
    rows = [(p.status, f, ",".join(map(str, p.groups[f])), float(p.alpha[f][0]), p.mse[f], None, None) for f in sorted(p.mse)]
    rows.append((p.status, None, None, None, p.overall.get("mse"), p.overall.get("r2"), p.overall.get("pearson")))  # a row for each fold
    return spark.createDataFrame(rows, "status string, fold int, test_groups string, alpha double, mse double, r2 double, pearson double")


@query("ml4_probe_report")
def _(spark, sf_dir):
    e = vectors_of(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("vec_id", F.lit(17)), F.lit(5)).cast("int"))
    rows = [("regression", f, a, m["mse"], m["r2"], m["pearson"], None) for f, (a, _b, m) in probes.leave_one_out_ridge(e, "embedding", "y", "fold", LOO_ALPHAS).items()]
    b, cs = probes.blocked_logistic(e, "embedding", "positive", "fold")
    scored = probes.predicted(e, "embedding", "fold", {f: v[:, None] for f, v in b.items()}).select("fold", "positive", F.col("prediction")[0].alias("s"))
    auroc = {r.fold: r.auroc for r in ordered.auroc(scored, "s", F.col("positive") == 1, by=("fold",)).collect()}  # a row a fold
    rows += [("classification", f, cs[f], None, None, None, auroc.get(f)) for f in sorted(cs)]
    return spark.createDataFrame(rows, "probe string, fold int, penalty double, mse double, r2 double, pearson double, auroc double")


@query("ml7_block_compression")
def _(spark, sf_dir):
    """Blocks of features that fit no replicate group alone: features in threes are replicates of one track."""
    e = vectors_of(spark, sf_dir).withColumn("t", F.array(F.lit(0.0))).withColumn("all", F.lit(0))
    s = probes.sums(e, "embedding", "t", "all")[0]
    d = len(s.xx) - 1
    loadings, share = probes.compressor(s, 3, [list(range(0, d // 2)), list(range(d // 2, d))], probes.replicate_weights([i // 3 for i in range(d)]))
    scores = probes.predicted(e, "embedding", "all", {0: np.vstack([loadings, np.zeros(loadings.shape[1])])}, "scores")
    energy = scores.select(F.posexplode("scores").alias("axis", "v")).groupBy("axis").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v") * F.col("v")), 4).alias("energy"))
    return energy.withColumn("share", F.round(F.element_at(F.array(*(F.lit(float(v)) for v in share)), F.col("axis") + 1), 6))


@query("ml8_component_imputer")
def _(spark, sf_dir):
    e = vectors_of(spark, sf_dir).withColumn("beta", F.transform("embedding", lambda v: (v.cast("double") + 1) / 2))
    e = e.select("vec_id", "fold", F.slice("beta", 1, 24).alias("o"), F.slice("beta", 25, 8).alias("t"))
    m = probes.fit_imputer(e.where("fold < 3"), e.where("fold = 3"), "o", "t", (2, 8, 16), (1.0, 10.0, 100.0))
    test = probes.impute(e.where("fold = 4"), "o", m)
    errors = test.select(F.explode(F.arrays_zip(F.col("t").alias("t"), F.col("imputed").alias("p"))).alias("c"))
    return errors.agg(F.count("*").alias("n"), F.round(F.avg((F.col("c.t") - F.col("c.p")) ** 2), 8).alias("mse")).withColumn("k", F.lit(m.k)).withColumn("alpha", F.lit(m.alpha))


@query("ml13_compartment_eigenvectors")
def _(spark, sf_dir):
    """Contacts of part bins (keys modulo 40) within a return flag; the mean part size stands for GC."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("chrom"), (F.col("l_partkey") % 40).alias("a"), (F.col("l_suppkey") % 40).alias("b"), "l_quantity")
    contacts = line.groupBy("chrom", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).agg(F.sum("l_quantity").alias("value"))
    gc = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 40).alias("bin")).agg(F.avg("p_size").alias("gc"))
    bins = line.select("chrom", F.col("a").alias("bin")).distinct().join(gc, "bin").withColumn("valid", F.col("bin") % 13 != 5)
    return probes.compartments(contacts, bins).withColumn("value", F.round("value", 6)).withColumn("compartment", F.when(F.col("value") > 0, "A").when(F.col("value") < 0, "B"))


def out_of_fold(spark, sf_dir, y, alphas=ALPHAS):
    """(rows with an array of out-of-fold predictions, coefficients, alphas) of the array target y."""
    e = vectors_of(spark, sf_dir).withColumn("profile", y)
    b, alpha = probes.blocked_ridge(probes.sums(e, "embedding", "profile", "fold"), alphas)
    return probes.predicted(e, "embedding", "fold", b, "oof"), b, alpha


@query("cq4_compartment_probe")
def _(spark, sf_dir):
    p, _b, alpha = out_of_fold(spark, sf_dir, F.array("y"))
    p = p.select(F.col("fold").alias("part"), "y", F.col("oof")[0].alias("p"))
    both = p.unionByName(p.withColumn("part", F.lit(-1)))  # -1: all folds
    ranked = ordered.mid_ranks(ordered.mid_ranks(both, "y", "ry", ("part",)), "p", "rp", ("part",))
    mean = ranked.groupBy("part").agg(F.avg("y").alias("m"))
    out = ranked.join(F.broadcast(mean), "part").groupBy("part").agg(
        F.count("*").alias("n"),
        F.round(maths.safe_corr(F.col("ry"), F.col("rp")), 5).alias("spearman"),
        F.round(1 - F.sum((F.col("y") - F.col("p")) ** 2) / F.nullif(F.sum((F.col("y") - F.col("m")) ** 2), F.lit(0.0)), 5).alias("r2"),
    )
    chosen = F.create_map(*(v for f, a in alpha.items() for v in (F.lit(f), F.lit(float(a[0])))))
    return out.withColumn("alpha", F.try_element_at(chosen, F.col("part")))


@query("cq5_membership_probe")
def _(spark, sf_dir):
    """Pairs of a positive and the control after it; a variant keeps the pairs whose positive has strength >= N."""
    e = vectors_of(spark, sf_dir)
    lead = e.where("positive = 1").select((F.col("vec_id") + 1).alias("vec_id"), F.col("vec_id").alias("pair"), F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(4)).alias("strength"))
    control = e.where("positive = 0").join(lead, "vec_id")
    case = e.where("positive = 1").join(control.select(F.col("pair").alias("vec_id"), "pair", "strength"), "vec_id")
    rows = sinks.written(case.unionByName(control).select("pair", "strength", "fold", "embedding", "positive"))  # each pass of the probes reads it
    out = None
    for least in (0, 2):
        kept = rows.where(F.col("strength") >= least)
        b, _c = probes.blocked_logistic(kept, "embedding", "positive", "fold", (0.1, 1.0))
        s = probes.predicted(kept, "embedding", "fold", {f: v[:, None] for f, v in b.items()}).select("positive", F.col("prediction")[0].alias("s"))
        n = kept.agg(F.count_if(F.col("positive") == 1).alias("n_pos"), F.count_if(F.col("positive") == 0).alias("n_neg"))
        one = n.join(ordered.auroc(s, "s", F.col("positive") == 1).select(F.round("auroc", 5).alias("auroc")), how="cross").withColumn("least", F.lit(least))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query("cq16_out_of_fold_pairs")
def _(spark, sf_dir):
    """Pearson of predicted and measured profiles of pairs (a vector and the fifth after it) whose rows share a fold."""
    p, _b, _a = out_of_fold(spark, sf_dir, F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: (F.col("label") == k).cast("double") + F.col("embedding")[k]))
    a = p.select(F.col("vec_id").alias("i"), (F.col("vec_id") + 5).alias("j"), F.col("fold").alias("fi"), F.col("oof").alias("oi"), F.col("profile").alias("yi"))
    b = p.select(F.col("vec_id").alias("j"), F.col("fold").alias("fj"), F.col("oof").alias("oj"), F.col("profile").alias("yj"))
    q = a.join(b, "j").withColumn("same_fold", F.col("fi") == F.col("fj"))
    return q.select("i", "j", "same_fold", F.round(vectors.paired_pearson(F.col("oi"), F.col("oj"), floor=1e-24), 5).alias("predicted_r"), F.round(vectors.paired_pearson(F.col("yi"), F.col("yj"), floor=1e-24), 5).alias("measured_r"))


@query("cq16_refit_check")
def _(spark, sf_dir):
    """Largest difference of the stored predictions from a separate centred fit on the rows of the other folds."""
    p, _b, alpha = out_of_fold(spark, sf_dir, F.array("y"))
    out = None
    for f, a in sorted(alpha.items()):
        train = p.where(F.col("fold") != f).withColumn("one", F.lit(0))
        s = probes.sums(train, "embedding", "profile", "one")[0]
        mean, sd, ym = s.xx[-1, :-1] / s.n, s.sd(), s.xy[-1] / s.n
        z = (s.xx[:-1, :-1] / s.n - np.outer(mean, mean)) / np.outer(sd, sd)
        w = np.linalg.solve(z + a[0] / s.n * np.eye(len(z)), (s.xy[:-1] / s.n - np.outer(mean, ym)) / sd[:, None]) / sd[:, None]
        again = probes.predicted(p.where(F.col("fold") == f), "embedding", "fold", {f: np.vstack([w, ym - mean @ w])}, "again")
        one = again.groupBy("fold").agg(F.count("*").alias("n"), (F.max(F.abs(F.col("oof")[0] - F.col("again")[0])) < 1e-6).alias("agrees"))
        out = one if out is None else out.unionByName(one)
    return out


SEEDS, ARMS, VARIANTS, REPLICATES = 4, 2, 2, 500
#: Leading bits of a hash that are counted first.
BITS = 12


def last_wanted(rows, wanted, h, by, per):
    """(by, last): the greatest of the `want` (table wanted, keyed by per) least 64-bit hashes h of each group, repeats counted; in a group
    with fewer rows its greatest.

    Hashes are counted by their leading bits, which tasks add up; only the hashes of the bin where the count is reached are ordered.
    """
    bins = rows.withColumn("bin", F.shiftright(h, 64 - BITS))
    counts = bins.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    so_far = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** BITS rows a group
    reached = counts.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).join(F.broadcast(wanted), per).where("before < want")
    held = reached.groupBy(*by).agg(F.max_by(F.struct("bin", "before", "want"), "bin").alias("at"))
    inside = bins.join(F.broadcast(held.select(*by, "at.*")), [*by, "bin"])
    order = Window.partitionBy(*by).orderBy(h).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.groupBy(*by, "before", "want", h).agg(F.count("*").alias("n")).withColumn("place", F.col("before") + F.sum("n").over(order) - F.col("n"))
    return placed.where("place < want").groupBy(*by).agg(F.max(h).alias("last"))


@query("cq25_set_robustness")
def _(spark, sf_dir):
    """Labels as sets, seeded controls, two representations (halves of the vector), with and without held-out probes.

    Controls: each fold's rows of other labels of least seeded hash, as many as its positives. A run is a (set, seed,
    variant, arm); its out-of-fold AUROC is from ridge scores. Per set and variant: the mean difference of the arms over
    seeds drawn with replacement, its two-sided p, q within the variant, standardised difference of a covariate, status.
    """
    e = vectors_of(spark, sf_dir).select("vec_id", "fold", "label", "embedding").where("label is not null")
    sets = e.groupBy(F.col("label").alias("trait")).agg(F.count("*").alias("n_pos"))
    labels = sorted(r.trait for r in sets.collect())  # the fixed list of sets
    each = e.withColumn("trait", F.explode(F.array(*(F.lit(v) for v in labels)))).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1)))).withColumn("case", F.col("label") == F.col("trait"))
    each = each.withColumn("h", F.when(~F.col("case"), F.xxhash64("vec_id", "trait", "seed")))
    wanted = e.groupBy(F.col("label").alias("trait"), "fold").agg(F.count("*").alias("want"))
    last = last_wanted(each.where("h is not null"), wanted, "h", ["trait", "seed", "fold"], ["trait", "fold"])
    # a row a set, seed and fold
    rows = each.join(F.broadcast(last), ["trait", "seed", "fold"], "left").where(F.col("case") | (F.col("h") <= F.col("last"))).drop("h", "last")
    rows = rows.withColumn("variant", F.explode(F.when(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(10)) == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    rows = rows.withColumn("arm", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", F.floor(F.size("embedding") / 2).cast("int"))
    rows = rows.withColumn("x", F.slice("embedding", F.col("arm") * F.col("half") + 1, F.col("half"))).withColumn("t", F.array(F.col("case").cast("double")))
    place = F.array_position(F.array(*(F.lit(v) for v in labels)), F.col("trait")).cast("int") - 1
    rows = rows.withColumn("run", ((place * SEEDS + F.col("seed")) * VARIANTS + F.col("variant")) * ARMS + F.col("arm")).withColumn("key", F.col("run") * 8 + F.col("fold"))
    parts = probes.sums(rows, "x", "t", "key")
    b = {}
    for key in parts:
        others = [parts[g] for g in parts if g // 8 == key // 8 and g != key]
        if others:
            b[key] = probes.total(others).ridge(10.0)
    scored = probes.predicted(rows, "x", "key", b).select("trait", "seed", "variant", "arm", "case", F.col("prediction")[0].alias("s"), F.col("embedding")[0].alias("c"))
    auc = ordered.auroc(scored, "s", F.col("case"), by=("trait", "seed", "variant", "arm"))
    delta = auc.groupBy("trait", "variant", "seed").agg((F.max(F.when(F.col("arm") == 0, F.col("auroc"))) - F.max(F.when(F.col("arm") == 1, F.col("auroc")))).alias("delta"), F.max(F.when(F.col("arm") == 0, F.col("auroc"))).alias("auroc"))
    draws = delta.groupBy("trait", "variant").agg(F.array_sort(F.collect_list(F.struct("seed", "delta"))).alias("d"), F.avg("delta").alias("observed"), F.avg("auroc").alias("auroc"))  # a few seeds
    draws = draws.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))))
    pick = F.transform(F.sequence(F.lit(1), F.size("d")), lambda k: F.element_at("d", (F.pmod(F.xxhash64("replicate", k, F.lit(25)), F.size("d")) + 1).cast("int"))["delta"])
    means = draws.withColumn("m", vectors.total(pick) / F.size("d"))
    p = means.groupBy("trait", "variant").agg(F.first("observed").alias("delta"), F.first("auroc").alias("auroc"), inference.two_sided_p("m").alias("p"))
    q = inference.benjamini_hochberg(p, "p", "trait", ("variant",))
    c, case = F.col("c"), F.col("case")
    balance = scored.where("arm = 0 and seed = 0").groupBy("trait", "variant").agg(
        F.count_if(case).alias("n_pos"),
        F.count_if(~case).alias("n_neg"),
        ((F.avg(F.when(case, c)) - F.avg(F.when(~case, c))) / F.nullif(F.sqrt((F.var_samp(F.when(case, c)) + F.var_samp(F.when(~case, c))) / 2), F.lit(0.0))).alias("smd"),
    )
    out = q.join(balance, ["trait", "variant"], "left")
    status = F.when((F.col("n_pos") >= 10) & (F.col("n_neg") >= 10), "evaluable").otherwise("insufficient_support")
    return out.select("trait", "variant", "n_pos", "n_neg", F.round("auroc", 4).alias("auroc"), F.round("delta", 4).alias("delta"), F.round("p", 4).alias("p"), F.round("q", 4).alias("q"), F.round("smd", 4).alias("smd"), status.alias("status"))
