"""Queries that assess a measurement: cells of pairs, split-half reliability, strata, audits of mappings, values and trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import maths
from marlstone.operators import audits, ordered, probes, reliability, splits
from marlstone.plans.registry import query
from marlstone.session import table
from marlstone.sources import sinks

#: Repetitions of the split, groups that two profiles must share, regions (the groups of donors), strata of distance.
REPETITIONS, LEAST, REGIONS = 4, 3, list(range(5))
STRATA = ["<50", "50-500", ">500", "interchromosomal"]

#: Donors are suppliers in the groups of their region, loci are parts, a part's chromosome is its type. Each part is paired
#: with the next two in an order by hash.
VALUES = "d AS (SELECT l_partkey AS locus, l_suppkey AS donor, n_regionkey AS grp, avg(l_discount * 10) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2, 3)"
PAIRS = f"""{VALUES}, f AS (SELECT locus, grp, avg(v) AS m FROM d GROUP BY 1, 2), s AS (SELECT locus, avg(m) AS mean, var_pop(m) AS var FROM f GROUP BY 1),
    o AS (SELECT p_partkey, p_type, row_number() OVER (ORDER BY sha256(CAST(p_partkey AS STRING) || ':41')) AS rn FROM part),
    pr AS (SELECT least(a.p_partkey, b.p_partkey) AS i, greatest(a.p_partkey, b.p_partkey) AS j, CASE WHEN a.p_partkey < b.p_partkey THEN a.p_type ELSE b.p_type END AS chrom,
        CASE WHEN a.p_type <> b.p_type THEN 'interchromosomal' WHEN abs(a.p_partkey - b.p_partkey) < 50 THEN '<50' WHEN abs(a.p_partkey - b.p_partkey) <= 500 THEN '50-500' ELSE '>500' END AS dist
        FROM o a JOIN (VALUES (1), (2)) t(k) ON true JOIN o b ON b.rn = a.rn + k),
    pv AS (SELECT pr.*, round(least(x.var, y.var), 9) AS vmin, round((x.mean + y.mean) / 2, 9) AS mmean FROM pr JOIN s x ON x.locus = i JOIN s y ON y.locus = j)"""
CELLS = f"""{PAIRS}, e AS (SELECT quantile_cont(vmin, [0.25, 0.5, 0.75, 0.9]) AS v, quantile_cont(mmean, [0.25, 0.5, 0.75]) AS m FROM pv),
    c AS (SELECT i, j, dist, vmin, mmean, unnest(list_filter(['all', 'dist_' || dist, CASE WHEN dist = 'interchromosomal' THEN 'chrom_inter' ELSE 'chrom_intra' END,
        'V_Q' || (1 + (vmin >= v[1])::INT + (vmin >= v[2])::INT + (vmin >= v[3])::INT), CASE WHEN vmin >= v[4] THEN 'V_top10pct' END,
        'M_Q' || (1 + (mmean >= m[1])::INT + (mmean >= m[2])::INT + (mmean >= m[3])::INT)], lambda x: x IS NOT NULL)) AS cell FROM pv, e)"""


def donors(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("grp"))
    return table(spark, sf_dir, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("donor"), "grp")


def donor_values(spark, sf_dir):
    """(locus, donor, v): the mean of a donor's lines of a locus."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_partkey").alias("locus"), F.col("l_suppkey").alias("donor")).agg(F.avg(F.col("l_discount") * 10).alias("v"))


def sampled(spark, sf_dir):
    """(i, j, chrom, dist): sampled pairs of loci with their stratum."""
    placed = splits.hash_positions(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_partkey", 41).select("p_partkey", "p_type", "_rn")
    placed = sinks.written(placed)  # read on both sides of the join
    a = placed.select(F.col("p_partkey").alias("p"), F.col("p_type").alias("tp"), "_rn").withColumn("_rn", F.explode(F.array(F.col("_rn") + 1, F.col("_rn") + 2)))
    b = placed.select(F.col("p_partkey").alias("q"), F.col("p_type").alias("tq"), "_rn")
    gap = F.abs(F.col("p") - F.col("q"))
    dist = F.when(F.col("tp") != F.col("tq"), "interchromosomal").when(gap < 50, "<50").when(gap <= 500, "50-500").otherwise(">500")
    chrom = F.when(F.col("p") < F.col("q"), F.col("tp")).otherwise(F.col("tq"))
    return a.join(b, "_rn").select(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), chrom.alias("chrom"), dist.alias("dist"))


def levels():
    """vmin and mmean of a pair with the mean and variance of both loci."""
    return F.round(F.least("var_i", "var_j"), 9).alias("vmin"), F.round((F.col("mean_i") + F.col("mean_j")) / 2, 9).alias("mmean")


def pairs(spark, sf_dir):
    """(i, j, chrom, dist, vmin, mmean): sampled pairs of loci with their stratum, lesser variance and mean level."""
    means = donor_values(spark, sf_dir).join(donors(spark, sf_dir), "donor").groupBy("locus", "grp").agg(F.avg("v").alias("m"))
    s = means.groupBy("locus").agg(F.avg("m").alias("mean"), F.var_pop("m").alias("var"))
    at = lambda k: s.select(F.col("locus").alias(k), F.col("mean").alias(f"mean_{k}"), F.col("var").alias(f"var_{k}"))
    both = sampled(spark, sf_dir).join(at("i"), "i").join(at("j"), "j")
    return sinks.written(both.select("i", "j", "chrom", "dist", *levels()))  # read for the quantiles and for the ranks


@query("cq10_pair_cells", f"WITH {CELLS} SELECT cell, count(*) AS n, round(avg(vmin), 6) AS vmin, round(avg(mmean), 6) AS mmean FROM c GROUP BY 1")
def _(spark, sf_dir):
    """Overlapping cells of pairs by distance class, quartile and top tenth of variance, quartile of mean."""
    c = reliability.in_cells(pairs(spark, sf_dir), "dist", "interchromosomal", "vmin", "mmean")
    return c.groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg("vmin"), 6).alias("vmin"), F.round(F.avg("mmean"), 6).alias("mmean"))


@query(
    "cq12_reliability_by_cell",
    f"""WITH {CELLS}, dn AS (SELECT s_suppkey AS donor, n_regionkey AS grp FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    h AS (SELECT donor, r, CASE WHEN row_number() OVER (PARTITION BY r, grp ORDER BY sha256(CAST(donor AS STRING) || ':' || CAST(r AS STRING) || ':7')) - 1 >= count(*) OVER (PARTITION BY r, grp) // 2 THEN 1 ELSE 0 END AS half FROM dn, range({REPETITIONS}) t(r)),
    g AS (SELECT r, locus, half, grp, avg(v) AS m FROM d JOIN h USING (donor) GROUP BY 1, 2, 3, 4),
    t AS (SELECT i, j, a.r, a.half, round(CASE WHEN count(*) >= {LEAST} AND var_pop(a.m) > 1e-12 AND var_pop(b.m) > 1e-12 THEN covar_pop(a.m, b.m) / sqrt(var_pop(a.m) * var_pop(b.m)) END, 9) AS x
        FROM pv JOIN g a ON a.locus = i JOIN g b ON b.locus = j AND b.r = a.r AND b.half = a.half AND b.grp = a.grp GROUP BY 1, 2, 3, 4),
    w AS (SELECT i, j, r, max(x) FILTER (WHERE half = 0) AS ta, max(x) FILTER (WHERE half = 1) AS tb FROM t GROUP BY 1, 2, 3),
    y AS (SELECT r, cell, rank() OVER (PARTITION BY r, cell ORDER BY ta) + (count(*) OVER (PARTITION BY r, cell, ta) - 1) / 2 AS ra, rank() OVER (PARTITION BY r, cell ORDER BY tb) + (count(*) OVER (PARTITION BY r, cell, tb) - 1) / 2 AS rb
        FROM w JOIN c USING (i, j) WHERE ta IS NOT NULL AND tb IS NOT NULL),
    z AS (SELECT r, cell, count(*) AS n, CASE WHEN count(*) >= 10 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END AS rs FROM y GROUP BY 1, 2),
    b AS (SELECT *, 2 * rs / nullif(1 + rs, 0) AS sb FROM z), k AS (SELECT *, CASE WHEN sb >= 0 THEN sqrt(sb) END AS ceil FROM b)
    SELECT cell, quantile_cont(n, 0.5)::DOUBLE AS n_median, round(quantile_cont(rs, 0.5), 5) AS r_spearman_median, round(quantile_cont(rs, 0.025), 5) AS r_spearman_q025, round(quantile_cont(rs, 0.975), 5) AS r_spearman_q975,
    round(quantile_cont(sb, 0.5), 5) AS rho_sb_median, round(quantile_cont(ceil, 0.5), 5) AS ceiling_median FROM k GROUP BY 1""",
)
def _(spark, sf_dir):
    """Donors split in halves within their group, repeatedly: how well the halves' profile similarities agree in each cell."""
    reps = list(range(REPETITIONS))
    split = reliability.halves(donors(spark, sf_dir), "donor", "grp", REPETITIONS, seed=7)
    tables = reliability.half_tables(donor_values(spark, sf_dir), split, "locus", "donor", "grp", "v", REGIONS, reps)
    held = reliability.half_similarities(sampled(spark, sf_dir), sinks.written(tables), "locus", "i", "j", reps, len(REGIONS), LEAST, levels())  # a pair joins two loci
    held = sinks.written(held.drop("chrom"))  # read for the quantiles and for the ranks
    at = sinks.written(reliability.edges(held.where("rep = 0"), "vmin", "mmean"))
    placed = reliability.with_cells(held, at, "dist", "interchromosomal", "vmin", "mmean").select("i", "j", "rep", "ta", "tb", "cells")
    told = reliability.reliability_in_cells(placed, "cells", reliability.cell_names(STRATA), ["rep"])
    told = reliability.over_repetitions(told, "cell")
    names = ["r_spearman_median", "r_spearman_q025", "r_spearman_q975", "rho_sb_median", "ceiling_median"]
    return told.select("cell", "n_median", *(F.round(c, 5).alias(c) for c in names))


def _matrices_sql() -> str:
    names = ", ".join(f"('{s}')" for s in STRATA)
    return f"""WITH {PAIRS}, l AS (SELECT dist, 'vmin' AS what, vmin AS x FROM pv UNION ALL SELECT dist, 'mmean', mmean FROM pv), n AS (SELECT * FROM (VALUES {names}) t(s)),
    m AS (SELECT what, dist, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY 1, 2), q AS (SELECT a.s AS a, b.s AS b, what FROM n a, n b, (VALUES ('vmin'), ('mmean')) t(what)),
    u AS (SELECT q.a, q.b, q.what, x, count(*) FILTER (WHERE dist = q.a) AS ca, count(*) FILTER (WHERE dist = q.b) AS cb FROM q JOIN l ON l.what = q.what AND dist IN (q.a, q.b) GROUP BY 1, 2, 3, 4),
    r AS (SELECT a, b, what, sum(ca) OVER w / nullif(sum(ca) OVER o, 0) AS fa, sum(cb) OVER w / nullif(sum(cb) OVER o, 0) AS fb FROM u WINDOW w AS (PARTITION BY a, b, what ORDER BY x), o AS (PARTITION BY a, b, what)),
    k AS (SELECT a, b, what, max(abs(fa - fb)) AS ks FROM r GROUP BY 1, 2, 3)
    SELECT q.what, q.a, q.b, round((x.m - y.m) / nullif(sqrt((x.v + y.v) / 2), 0), 6) AS smd, round(k.ks, 6) AS ks FROM q LEFT JOIN m x ON x.what = q.what AND x.dist = q.a LEFT JOIN m y ON y.what = q.what AND y.dist = q.b LEFT JOIN k ON k.a = q.a AND k.b = q.b AND k.what = q.what"""


@query("cq14_strata_matrices", _matrices_sql())
def _(spark, sf_dir):
    """Standardised mean difference and KS distance of every two strata, of the pairs' variance and level."""
    p = pairs(spark, sf_dir)
    told = [reliability.strata_matrices(p, v, "dist", STRATA).withColumn("what", F.lit(v)) for v in ("vmin", "mmean")]
    return told[0].unionByName(told[1]).select("what", "a", "b", F.round("smd", 6).alias("smd"), F.round("ks", 6).alias("ks"))


@query(
    "cq14_composition",
    f"""WITH {PAIRS}, n AS (SELECT dist, chrom, count(*) AS n FROM pv GROUP BY 1, 2), t AS (SELECT dist, sum(n) AS n FROM n GROUP BY 1), r AS (SELECT chrom, sum(n) FILTER (WHERE dist IN ('>500', 'interchromosomal')) AS r FROM n GROUP BY 1),
    g AS (SELECT t.dist, t.n, coalesce(n.n, 0) / t.n AS p, coalesce(r, 0) / (SELECT sum(r) FROM r) AS q FROM t CROSS JOIN r LEFT JOIN n ON n.dist = t.dist AND n.chrom = r.chrom)
    SELECT dist, CAST(max(n) AS BIGINT) AS n, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS js FROM g GROUP BY 1""",
)
def _(spark, sf_dir):
    told = reliability.composition(pairs(spark, sf_dir), "dist", "chrom", [">500", "interchromosomal"])
    return told.select("dist", "n", F.round("js", 6).alias("js"))


@query(
    "cq8_recurrence_fractions",
    """WITH a AS (SELECT l_partkey AS locus, l_suppkey AS sample, max(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END) AS state, max(s_acctbal) < 0 AS tumour FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)
    SELECT locus, count(*) FILTER (WHERE state >= 0) AS assessed, round(count(*) FILTER (WHERE state = 1) / nullif(count(*) FILTER (WHERE state >= 0), 0), 6) AS fraction,
    round(count(*) FILTER (WHERE state = 1 AND NOT tumour) / nullif(count(*) FILTER (WHERE state >= 0 AND NOT tumour), 0), 6) AS fraction_normal, CASE WHEN count(*) FILTER (WHERE state >= 0) = 0 THEN -1 ELSE (count(*) FILTER (WHERE state = 1) > 0)::INT END AS in_any FROM a GROUP BY 1""",
)
def _(spark, sf_dir):
    """How often a locus is in the state among the samples assessed there (-1 is not assessed), over all and over normal samples."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_acctbal") < 0).alias("tumour"))
    state = F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1)
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("locus"), F.col("l_suppkey").alias("sample")).agg(F.max(state).alias("state")).join(s, "sample")
    share = lambda ok: F.round(F.count_if((F.col("state") == 1) & ok) / F.nullif(F.count_if((F.col("state") >= 0) & ok), F.lit(0)), 6)
    assessed = F.count_if(F.col("state") >= 0)
    return a.groupBy("locus").agg(
        assessed.alias("assessed"), share(F.lit(True)).alias("fraction"), share(~F.col("tumour")).alias("fraction_normal"), F.when(assessed == 0, -1).otherwise((F.count_if(F.col("state") == 1) > 0).cast("int")).alias("in_any")
    )


@query("cq7_cq8_probes")
def _(spark, sf_dir):
    """Blocked ridge from a locus' vector to its consensus level and its recurrence: out-of-fold Spearman and R2."""
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("sd"))  # a row a line
    z = li.join(F.broadcast(s), "l_returnflag").groupBy("l_partkey", "l_returnflag").agg(F.avg((F.col("l_extendedprice") - F.col("m")) / F.col("sd")).alias("z"), F.count("*").alias("n"))
    returned = F.sum(F.when(F.col("l_returnflag") == "R", F.col("n")).otherwise(0))
    of = z.groupBy("l_partkey").agg(F.count("*").alias("lines"), F.avg("z").alias("consensus"), (returned / F.sum("n")).alias("recurrence")).where("lines >= 2")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("l_partkey"), "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(5)).cast("int").alias("fold"))
    rows = e.join(of, "l_partkey").withColumn("y", F.array("consensus", "recurrence"))
    b, _alpha = probes.blocked_ridge(probes.sums(rows, "embedding", "y", "fold"), (1.0, 10.0, 100.0, 1000.0))
    told = probes.predicted(rows, "embedding", "fold", b, "p").select(F.explode(F.array(*(F.struct(F.lit(n).alias("target"), F.col(n).alias("y"), F.col("p")[k].alias("p")) for k, n in enumerate(("consensus", "recurrence"))))).alias("c")).select("c.*")
    ranked = ordered.mid_ranks(ordered.mid_ranks(told, "y", "ry", ("target",)), "p", "rp", ("target",))
    r2 = 1 - F.sum((F.col("y") - F.col("p")) ** 2) / F.nullif(F.var_pop("y") * F.count("*"), F.lit(0.0))
    return ranked.groupBy("target").agg(F.count("*").alias("n"), F.round(maths.safe_corr(F.col("ry"), F.col("rp")), 5).alias("spearman"), F.round(r2, 5).alias("r2"))


@query(
    "cq19_mapping_audit",
    """WITH u AS (SELECT CAST(regexp_extract(s_name, '([0-9]+)$', 1) AS BIGINT) AS z, s_nationkey AS nation, s_acctbal > 0 AS solvent FROM supplier), p AS (SELECT CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS z, c_nationkey AS nation, c_acctbal > 0 AS solvent FROM customer WHERE c_custkey > 2),
    j AS (SELECT coalesce(u.z, p.z) AS z, u.z AS uz, p.z AS pz, u.nation AS un, p.nation AS pn, u.solvent AS us, p.solvent AS ps FROM u FULL JOIN p ON u.z = p.z)
    SELECT z, unnest(list_filter([CASE WHEN pz IS NULL THEN 'unmatched' END, CASE WHEN uz IS NULL THEN 'extra' END, CASE WHEN uz = pz AND un IS DISTINCT FROM pn THEN 'nation_mismatch' END, CASE WHEN uz = pz AND us IS DISTINCT FROM ps THEN 'solvent_mismatch' END], lambda x: x IS NOT NULL)) AS problem FROM j""",
)
def _(spark, sf_dir):
    """Suppliers' groups held against the customers' of the same number in the name: what has no match, differs or is extra."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("bigint").alias("z")
    used = table(spark, sf_dir, "supplier").select(number("s_name"), F.col("s_nationkey").alias("nation"), (F.col("s_acctbal") > 0).alias("solvent"))
    published = table(spark, sf_dir, "customer").where("c_custkey > 2").select(number("c_name"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("solvent"))
    return audits.mapping_audit(used, published, "z", ["nation", "solvent"])


@query(
    "cq20_value_diff",
    """WITH a AS (SELECT l_partkey, l_linenumber, avg(l_quantity) AS x FROM lineitem GROUP BY 1, 2), r AS (SELECT l_partkey, l_linenumber, avg(l_quantity) AS x FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2),
    b AS (SELECT *, pow(2, floor(log2(x)) - 10) AS u FROM r), j AS (SELECT a.x, round_even(b.x / u, 0) * u AS y, pow(2, floor(log2(a.x)) - 10) AS ulp FROM a FULL JOIN b ON a.l_partkey = b.l_partkey AND a.l_linenumber = b.l_linenumber)
    SELECT count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS n_cells, count(*) FILTER (WHERE (x IS NULL) <> (y IS NULL)) AS pattern_mismatch, round(max(abs(x - y)), 6) AS max_abs_diff, round(max(abs(x - y) / ulp), 4) AS max_diff_in_ulp,
    count(*) FILTER (WHERE abs(x - y) > ulp / 2 + 1e-6) AS beyond_half_ulp, count(*) FILTER (WHERE round_even(x / ulp, 0) * ulp <> y) AS rounding_mismatch FROM j""",
)
def _(spark, sf_dir):
    """Means computed anew against 16-bit means that lack the returned lines."""
    mean = lambda df: df.groupBy("l_partkey", "l_linenumber").agg(F.avg("l_quantity").alias("x"))
    li = table(spark, sf_dir, "lineitem")
    frozen = mean(li.where("l_returnflag <> 'R'")).withColumn("x", audits.half_precision(F.col("x")))
    told = audits.value_diff(mean(li), frozen, ["l_partkey", "l_linenumber"], "x")
    return told.withColumns({"max_abs_diff": F.round("max_abs_diff", 6), "max_diff_in_ulp": F.round("max_diff_in_ulp", 4)})


@query(
    "cq21_tree_diff",
    r"""WITH b AS (SELECT source || '/' || doc_id AS path, sha256(coalesce(text, '')) AS d FROM documents WHERE source IS NOT NULL), a AS (SELECT source || '/' || doc_id AS path, sha256(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'))) AS d FROM documents WHERE source IS NOT NULL AND length(text) >= 40)
    SELECT b.path, CASE WHEN a.path IS NULL THEN 'removed' WHEN a.d = b.d THEN 'same' ELSE 'changed' END AS state FROM b LEFT JOIN a ON a.path = b.path""",
)
def _(spark, sf_dir):
    """The documents as files before and after a cleaning: dropped when short, changed when a run of spaces was."""
    d = table(spark, sf_dir, "documents").where("source is not null").select(F.concat_ws("/", "source", "doc_id").alias("path"), "text")
    before = d.select("path", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"))
    after = d.where(F.length("text") >= 40).select("path", F.sha2(F.trim(F.regexp_replace("text", "[ \\t\\r\\n]+", " ")).cast("binary"), 256).alias("digest"))
    return audits.tree_diff(before, after)


@query(
    "ma9_midpoint_distance",
    """WITH x AS (SELECT p_partkey, p_retailprice AS x, pow(2, greatest(floor(log2(p_retailprice)), -14) - 10) AS u FROM part) SELECT p_partkey, round(abs(x / u - floor(x / u) - 0.5), 6) AS distance, round_even(x / u, 0) * u AS rounded FROM x""",
)
def _(spark, sf_dir):
    x = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(audits.midpoint_distance(x), 6).alias("distance"), audits.half_precision(x).alias("rounded"))


@query(
    "cq29_common_tail_gaps",
    """WITH c AS (SELECT event_type AS arm, user_id % 3 AS run, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, avg(value) AS mse, avg(abs(value - 10)) AS mae FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3),
    j AS (SELECT a.arm, a.run, row_number() OVER (PARTITION BY a.arm, a.run ORDER BY a.step DESC) AS k, a.mse - r.mse AS g1, r.mse AS r1, a.mae - r.mae AS g2, r.mae AS r2 FROM c a JOIN c r ON r.arm = 'click' AND r.run = a.run AND r.step = a.step WHERE a.arm <> 'click'),
    l AS (SELECT arm, run, 'mse' AS metric, g1 AS g, r1 AS r FROM j WHERE k <= 10 UNION ALL SELECT arm, run, 'mae', g2, r2 FROM j WHERE k <= 10)
    SELECT arm, run, metric, count(*) AS n_steps, round(avg(g), 6) AS gap, round(avg(g) / nullif(avg(r), 0), 6) AS relative, max(g) < 0 OR min(g) > 0 AS sign_stable FROM l GROUP BY 1, 2, 3""",
)
def _(spark, sf_dir):
    """Gap of each arm to the reference over the last ten steps that both have, and whether its sign holds."""
    e = table(spark, sf_dir, "events").where("value is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    step = F.floor(F.unix_micros("ts") / 3.6e9).cast("bigint")
    c = e.groupBy(F.col("event_type").alias("arm"), (F.col("user_id") % 3).alias("run"), step.alias("step")).agg(F.avg("value").alias("mse"), F.avg(F.abs(F.col("value") - 10)).alias("mae"))
    told = audits.tail_gaps(c, "arm", "run", "step", ["mse", "mae"], "click", 10)
    return told.withColumns({"gap": F.round("gap", 6), "relative": F.round("relative", 6)})


@query(
    "me23_contrast_verdicts",
    """WITH s AS (SELECT l_linenumber AS item, l_returnflag AS arm, avg(l_discount) AS m, var_samp(l_discount) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2), w AS (SELECT l_returnflag AS arm, avg(l_discount) AS m FROM lineitem GROUP BY 1),
    c AS (SELECT a.item, a.arm, pr.m - pa.m AS prim, r.m - a.m AS delta, 1.96 * sqrt(r.v / r.n + a.v / a.n) AS half FROM s a JOIN s r ON r.item = a.item AND r.arm = 'R' JOIN w pr ON pr.arm = 'R' JOIN w pa ON pa.arm = a.arm WHERE a.arm <> 'R'),
    k AS (SELECT item, CASE WHEN sign(prim) = sign(delta) THEN 'same_sign' WHEN delta - half > 0 OR delta + half < 0 THEN 'flip_resolved' ELSE 'flip_unresolved' END AS category FROM c)
    SELECT item, count(*) AS contrasts, count(*) FILTER (WHERE category = 'same_sign') AS same, CASE WHEN bool_or(category = 'flip_resolved') THEN 'CHANGES' WHEN bool_or(category = 'flip_unresolved') THEN 'WEAKENS' ELSE 'CONFIRMS' END AS verdict FROM k GROUP BY 1""",
)
def _(spark, sf_dir):
    """Whether the contrasts of each line number confirm those over all lines."""
    li = table(spark, sf_dir, "lineitem")
    x = F.col("l_discount")
    s = li.groupBy(F.col("l_linenumber").alias("item"), F.col("l_returnflag").alias("arm")).agg(F.avg(x).alias("m"), F.var_samp(x).alias("v"), F.count("*").alias("n"))
    w = li.groupBy(F.col("l_returnflag").alias("arm")).agg(F.avg(x).alias("m"))
    ref = s.where("arm = 'R'").select("item", F.col("m").alias("rm"), (F.col("v") / F.col("n")).alias("rv"))
    primary = w.where("arm <> 'R'").crossJoin(w.where("arm = 'R'").select(F.col("m").alias("pr"))).select("arm", (F.col("pr") - F.col("m")).alias("prim"))  # a row an arm
    c = s.where("arm <> 'R'").join(ref, "item").join(primary, "arm").withColumn("delta", F.col("rm") - F.col("m")).withColumn("half", 1.96 * F.sqrt(F.col("rv") + F.col("v") / F.col("n")))
    c = c.withColumn("category", audits.contrast_category(F.col("prim"), F.col("delta"), F.col("delta") - F.col("half"), F.col("delta") + F.col("half")))
    return c.groupBy("item").agg(F.count("*").alias("contrasts"), F.count_if(F.col("category") == "same_sign").alias("same"), audits.verdict(F.col("category")).alias("verdict"))


def arms(spark, sf_dir):
    """The sums of three arms of the embeddings (the first half of a vector, the second half, all) against the label, by fold."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null and label is not null")
    e = e.select("embedding", F.array(F.col("label").cast("double")).alias("y"), F.pmod(F.xxhash64("vec_id"), F.lit(5)).cast("int").alias("fold"))
    half = (F.size("embedding") / 2).cast("int")
    parts = {"first": F.slice("embedding", F.lit(1), half), "second": F.slice("embedding", half + 1, half), "all": F.col("embedding")}
    return {name: probes.sums(e.withColumn("x", c), "x", "y", "fold") for name, c in parts.items()}


@query("me24_growing_grid")
def _(spark, sf_dir):
    """Ridge of all arms on one grid of penalties, which grows while any arm picks its ends."""
    grid, done, _fits, reports = audits.ridge_on_growing_grid(arms(spark, sf_dir), (0.01, 0.1, 1.0))
    rows = [(name, done, min(grid), max(grid), r["n"], r["at_min"], r["at_max"]) for name, r in reports.items()]
    return spark.createDataFrame(rows, "arm string, extensions int, lowest double, highest double, n int, at_min double, at_max double")


@query("ag20_effective_ranks")
def _(spark, sf_dir):
    """Effective ranks of the embeddings' halves, as they are and centred."""
    rows = [(name, centred, *(round(v, 5) for v in audits.effective_ranks(parts, centred).values())) for name, parts in arms(spark, sf_dir).items() for centred in (False, True)]
    return spark.createDataFrame(rows, "arm string, centred boolean, participation double, entropy_rank double")
