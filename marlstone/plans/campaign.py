"""Eleven endpoints of two representations under shared draws of blocks, and the contrasts of the four primaries.

Loci are parts that have a vector, blocks their labels, folds the labels modulo five; the two arms are the halves of a
vector. Pairs are drawn by hash or come from orders, which hold few parts each. Probes are fitted out of fold.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import vectors
from marlstone.operators import bootstrap, inference, neighbours, probes
from marlstone.plans.registry import query
from marlstone.session import table
from marlstone.sources.sinks import written

#: Endpoint -> (class, statistic).
ENDPOINTS = {
    "profile_similarity": ("primary", "spearman_equal_strata"),
    "contact": ("primary", "auroc"),
    "membership_probe": ("primary", "auroc_out_of_fold"),
    "consensus_probe": ("primary", "spearman_out_of_fold"),
    "marker_neighbours": ("secondary", "enrichment"),
    "compartment_probe_a": ("secondary", "spearman_out_of_fold"),
    "compartment_probe_b": ("secondary", "spearman_out_of_fold"),
    "activity_similarity": ("secondary", "spearman"),
    "contact_second_assay": ("sensitivity", "auroc"),
    "contact_between_blocks": ("exploratory", "auroc"),
    "domain_probe": ("exploratory", "auroc_out_of_fold"),
}
#: The family that Holm's correction covers.
PRIMARY = tuple(e for e, (c, _) in ENDPOINTS.items() if c == "primary")
ARMS = ("first", "second")
ALPHAS, CS, DRAWS, SEED, NEIGHBOURS = (0.1, 10.0, 1000.0), (0.1, 1.0), 200, 17, 5


def loci(spark, sf_dir):
    """(i, block, fold, first, second) with each locus' targets; a target that a locus lacks is null."""
    half = lambda at: F.slice("embedding", at, 32)
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null").select(F.col("vec_id").alias("i"), F.col("label").alias("block"), (F.col("label") % 5).alias("fold"), half(1).alias("first"), half(33).alias("second"))
    li = table(spark, sf_dir, "lineitem").withColumn("i", F.col("l_partkey").cast("long"))
    by_line = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("_m"), F.stddev_pop("l_extendedprice").alias("_s"))
    z = li.join(F.broadcast(by_line), "l_returnflag").groupBy("i", "l_returnflag").agg(F.avg((F.col("l_extendedprice") - F.col("_m")) / F.col("_s")).alias("z"))  # a row a flag
    consensus = z.groupBy("i").agg(F.when(F.count("z") >= 3, F.avg("z")).alias("consensus"))
    mean = lambda v, c, of: F.array(*(F.avg(F.when(F.col(c) == k, F.col(v).cast("double"))) for k in of))
    modes = ["AIR", "FOB", "MAIL", "RAIL", "REG AIR", "SHIP", "TRUCK"]
    told = li.groupBy("i").agg(
        F.avg("l_tax").cast("double").alias("a"), F.avg("l_discount").cast("double").alias("b"), (F.avg((F.col("l_returnflag") == "R").cast("double")) > 0.25).cast("int").alias("domain"),
        mean("l_quantity", "l_linenumber", range(1, 8)).alias("profile"), mean("l_tax", "l_shipmode" if "l_shipmode" in li.columns else "l_linenumber", modes if "l_shipmode" in li.columns else range(1, 8)).alias("activity"),
    )
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("i"), (F.col("p_size") >= 25).cast("int").alias("member"), F.when(F.col("p_size") < 20, F.col("p_size") % 4).alias("marker"))
    return e.join(p, "i").join(told, "i", "left").join(consensus, "i", "left")


def compared(pairs, ends, *more: str):
    """pairs (i, j, ...) with block of i, block of j and the cosine of each arm, plus both ends' columns named in more."""
    side = lambda k: ends.select(F.col("i").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("block", *ARMS, *more)))
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    return both.withColumns({f"cos_{a}": F.round(vectors.cosine(F.col(f"{a}_i"), F.col(f"{a}_j")), 9) for a in ARMS}).drop(*(f"{a}_{k}" for a in ARMS for k in "ij"))


def by_arm(df, endpoint, *keep):
    """A row for each arm: (key, x, keep); endpoint is a name or a column of names."""
    arms = F.explode(F.create_map(*(c for a in ARMS for c in (F.lit(a), F.col(f"cos_{a}"))))).alias("arm", "x")
    rows = df.select(*keep, F.lit(endpoint).alias("_e") if isinstance(endpoint, str) else endpoint.alias("_e"), arms)
    return rows.select(F.concat_ws("|", "_e", "arm").alias("key"), "x", *keep)


def statistics(spark, sf_dir) -> dict[tuple[str, str], tuple[float, object]]:
    """(endpoint, arm) -> (value, replicates): all under one table of draws.

    Loci, pairs, predictions and scores are written once each: every statistic reads its rows several times.
    """
    ends = written(loci(spark, sf_dir))
    blocks = [r[0] for r in ends.select("block").distinct().orderBy("block").limit(65).collect()]  # 64 at most, checked by the operator
    draws = bootstrap.hash_draws(spark, len(blocks), DRAWS, SEED)
    n = table(spark, sf_dir, "embeddings").count()
    ids = ends.select("i")
    drawn = ids.select("i", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select("i", bootstrap.drawn(n, SEED, "i", "k").alias("j")).where("i <> j").distinct()
    like = lambda c: F.round(vectors.paired_pearson(F.col(f"{c}_i"), F.col(f"{c}_j")), 9).alias(c)
    pairs = written(compared(drawn, ends, "profile", "activity").select("block_i", "block_j", like("profile"), like("activity"), *(f"cos_{a}" for a in ARMS)))
    stratum = (F.col("block_i") == F.col("block_j")).alias("within")
    profile = pairs.select("block_i", stratum, F.col("profile").alias("y"), *(f"cos_{a}" for a in ARMS)).where("y is not null")
    strata = profile.groupBy("within").agg(F.count("*").alias("_n"))  # two rows: each stratum weighs the same in all
    whole = strata.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    profile = profile.join(F.broadcast(strata.crossJoin(F.broadcast(whole))), "within").withColumn("w", F.col("_t") / (F.col("_k") * F.col("_n")))
    ranked = by_arm(profile, "profile_similarity", "y", "block_i", "w")
    ranked = ranked.unionByName(by_arm(pairs.select("block_i", F.col("activity").alias("y"), F.lit(1.0).alias("w"), *(f"cos_{a}" for a in ARMS)), "activity_similarity", "y", "block_i", "w"))

    # contacts: loci of one order; each has a control with the same first end
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("i")).join(ids, "i").distinct()
    met = written(li.join(li.withColumnRenamed("i", "j"), "l_orderkey").where("i < j").join(o, "l_orderkey").groupBy("i", "j").agg(F.max((F.col("o_orderstatus") == "F").cast("int")).alias("second")))
    control = met.select("i", bootstrap.drawn(n, SEED + 1, "i", "j").alias("k"), "second").where("i <> k")
    control = control.select(F.least("i", "k").alias("i"), F.greatest("i", "k").alias("j"), "second").join(met.select("i", "j"), ["i", "j"], "left_anti").groupBy("i", "j").agg(F.max("second").alias("second"))
    both = compared(met.withColumn("y", F.lit(1)).unionByName(control.withColumn("y", F.lit(0))), ends)
    kinds = F.explode(F.array_compact(F.array(F.lit("contact"), F.when(F.col("second") == 1, "contact_second_assay"), F.when(F.col("block_i") != F.col("block_j"), "contact_between_blocks"))))
    scored = by_arm(both.select("*", kinds.alias("kind")), F.col("kind"), "y", "block_i")

    out = {}
    for arm in ARMS:
        held = ends.select("i", "block", "fold", F.col(arm).alias("x"), "member", "domain", "consensus", "a", "b")
        joint = held.where("a is not null and b is not null and domain is not null").withColumn("t", F.array("a", "b", F.col("domain").cast("double")))
        fit, _ = probes.blocked_ridge(probes.sums(joint, "x", "t", "fold"), ALPHAS)
        p = written(probes.predicted(joint, "x", "fold", fit, "p").select("p", "a", "b", "domain", "block"))
        for k, name in enumerate(("compartment_probe_a", "compartment_probe_b")):
            ranked = ranked.unionByName(p.select(F.lit(f"{name}|{arm}").alias("key"), F.col("p")[k].alias("x"), F.col("ab"[k]).alias("y"), F.col("block").alias("block_i"), F.lit(1.0).alias("w")))
        scored = scored.unionByName(p.select(F.lit(f"domain_probe|{arm}").alias("key"), F.col("p")[2].alias("x"), F.col("domain").alias("y"), F.col("block").alias("block_i")))
        timed = held.where("consensus is not null").withColumn("t", F.array("consensus"))
        fit, _ = probes.blocked_ridge(probes.sums(timed, "x", "t", "fold"), ALPHAS)
        ranked = ranked.unionByName(probes.predicted(timed, "x", "fold", fit, "p").select(F.lit(f"consensus_probe|{arm}").alias("key"), F.col("p")[0].alias("x"), F.col("consensus").alias("y"), F.col("block").alias("block_i"), F.lit(1.0).alias("w")))
        b, _ = probes.blocked_logistic(held, "x", "member", "fold", CS)
        p = probes.predicted(held, "x", "fold", {f: v[:, None] for f, v in b.items()}, "p")
        scored = scored.unionByName(p.select(F.lit(f"membership_probe|{arm}").alias("key"), F.col("p")[0].alias("x"), F.col("member").alias("y"), F.col("block").alias("block_i")))

    marks = ends.select("i", "marker", "block")
    share = marks.where("marker is not null").groupBy("marker").count().crossJoin(F.broadcast(marks.agg(F.count("*").alias("_t")))).select("marker", (F.col("count") / F.col("_t")).alias("expected"))  # few markers
    near = None
    for arm in ARMS:
        q = neighbours.nearest_vectors(ends.select("i", arm), "i", arm, NEIGHBOURS, ends.where("marker is not null").select("i", arm)).select(F.lit(f"marker_neighbours|{arm}").alias("key"), F.col("query").alias("i"), "neighbour")
        near = q if near is None else near.unionByName(q)
    told = near.join(marks, "i").join(F.broadcast(share), "marker").join(marks.select(F.col("i").alias("neighbour"), F.col("marker").alias("other")), "neighbour")
    found = bootstrap.ratio_replicates(told, "key", F.coalesce((F.col("marker") == F.col("other")).cast("double"), F.lit(0.0)), F.col("expected"), "block", blocks, draws)
    found |= bootstrap.auroc_replicates(written(scored), "key", "x", F.col("y") == 1, "block_i", blocks, draws)
    found |= bootstrap.spearman_replicates(written(ranked), "key", "x", "y", "block_i", blocks, draws, F.col("w"))
    for key, v in found.items():
        out[tuple(key.split("|"))] = v
    return out


@query("ca5_eleven_endpoints")
def _(spark, sf_dir):
    """Value and interval of each registered endpoint for both arms."""
    rows = [(e, *ENDPOINTS[e], arm, round(v, 5), *(round(c, 5) for c in bootstrap.interval(reps))) for (e, arm), (v, reps) in sorted(statistics(spark, sf_dir).items())]
    return spark.createDataFrame(rows, "endpoint string, class string, statistic string, arm string, value double, lo double, hi double")


@query("ca10_primary_contrasts")
def _(spark, sf_dir):
    """First arm less second under the shared draws; Holm's correction over the four primaries alone."""
    got = statistics(spark, sf_dir)
    rows = []
    for e, (kind, _) in ENDPOINTS.items():
        c = bootstrap.contrast(got[e, "first"], got[e, "second"])
        rows.append((e, kind, float(c["delta"]), float(c["ci_lo"]), float(c["ci_hi"]), float(c["p"])))
    t = spark.createDataFrame(rows, "endpoint string, class string, delta double, lo double, hi double, p double")
    t = t.withColumn("_p", F.when(F.col("endpoint").isin(*PRIMARY), F.col("p")))
    return inference.holm(t, "_p", "endpoint").select("endpoint", "class", *(F.round(c, 5).alias(c) for c in ("delta", "lo", "hi", "p", "p_holm")))
