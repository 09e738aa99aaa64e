"""Queries of aggregation, splits, sampling and matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import maths
from marlstone.operators import lookups, ordered, pair_space, splits
from marlstone.plans.registry import query
from marlstone.session import table

#: lineitem as a long matrix: samples are suppliers, loci are parts, the measurement is ten times the discount.
BETA = "SELECT l_suppkey AS sample, l_partkey AS locus, avg(l_discount * 10) AS beta FROM lineitem GROUP BY 1, 2"


def beta(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("sample"), F.col("l_partkey").alias("locus")).agg(F.avg(F.col("l_discount") * 10).alias("beta"))


SPLIT_SQL = """s AS (SELECT sample, row_number() OVER (ORDER BY sha256(CAST(sample AS STRING) || ':17')) - 1 AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT l_suppkey AS sample FROM lineitem)),
    g AS (SELECT sample, CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM s)"""


@query(
    "ag1_ag4_prior_reconstruction",
    f"""WITH b AS ({BETA}), {SPLIT_SQL}, t AS (SELECT * FROM b JOIN g USING (sample)),
    p AS (SELECT locus, avg(beta) AS m FROM t WHERE split = 'train' GROUP BY 1), a AS (SELECT avg(beta) AS m FROM t WHERE split = 'train'),
    x AS (SELECT t.split, t.beta, coalesce(p.m, a.m) AS prior, a.m AS base FROM t LEFT JOIN p USING (locus), a WHERE split <> 'train')
    SELECT split, count(*) AS n, round(avg(pow(beta - prior, 2)), 6) AS mse, round(avg(abs(beta - prior)), 6) AS mae, round(avg(pow(beta - base, 2)), 6) AS prior_mse,
    round(1 - avg(pow(beta - prior, 2)) / avg(pow(beta - base, 2)), 6) AS skill,
    round(avg(ln(least(greatest(prior, 0.001), 0.999)) - ln(1 - least(greatest(prior, 0.001), 0.999))), 6) AS mean_logit FROM x GROUP BY 1""",
)
def _(spark, sf_dir):
    b = beta(spark, sf_dir)
    t = b.join(splits.group_split(b.select("sample").distinct(), "sample", seed=17), "sample")
    train = t.where("split = 'train'")
    priors = train.groupBy("locus").agg(F.avg("beta").alias("m"))
    base = train.agg(F.avg("beta").alias("base"))  # one row
    x = t.where("split <> 'train'").join(priors, "locus", "left").crossJoin(F.broadcast(base)).withColumn("prior", F.coalesce("m", "base"))
    se, base_se = F.pow(F.col("beta") - F.col("prior"), 2), F.pow(F.col("beta") - F.col("base"), 2)
    return x.groupBy("split").agg(
        F.count("*").alias("n"),
        F.round(F.avg(se), 6).alias("mse"),
        F.round(F.avg(F.abs(F.col("beta") - F.col("prior"))), 6).alias("mae"),
        F.round(F.avg(base_se), 6).alias("prior_mse"),
        F.round(1 - F.avg(se) / F.avg(base_se), 6).alias("skill"),
        F.round(F.avg(maths.to_logit(F.col("prior"))), 6).alias("mean_logit"),
    )


@query(
    "ag2_two_sided_priors",
    """WITH t AS (SELECT l_partkey AS locus, l_returnflag = 'N' AS obs, l_discount AS x FROM lineitem), a AS (SELECT avg(x) AS g FROM t WHERE obs)
    SELECT locus, round(coalesce(avg(x) FILTER (WHERE obs), g), 6) AS observed, round(coalesce(avg(x) FILTER (WHERE NOT obs), g), 6) AS target, round(stddev_pop(x), 6) AS sd FROM t, a GROUP BY locus, g""",
)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("locus"), (F.col("l_returnflag") == "N").alias("obs"), F.col("l_discount").alias("x"))
    g = t.where("obs").agg(F.avg("x").alias("g"))
    m = t.groupBy("locus").agg(F.avg(F.when(F.col("obs"), F.col("x"))).alias("o"), F.avg(F.when(~F.col("obs"), F.col("x"))).alias("t"), F.stddev_pop("x").alias("s"))
    return m.crossJoin(F.broadcast(g)).select("locus", F.round(F.coalesce("o", "g"), 6).alias("observed"), F.round(F.coalesce("t", "g"), 6).alias("target"), F.round("s", 6).alias("sd"))


@query("ag3_streaming_moments", "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(greatest(var_samp(value), 0), 5) AS variance FROM events GROUP BY 1")
def _(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(v).alias("n"), F.round(F.avg(v), 6).alias("mean"), F.round(F.greatest(F.var_samp(v), F.lit(0.0)), 5).alias("variance"))


@query(
    "ag5_mean_of_correlations",
    """WITH s AS (SELECT l_suppkey AS k, covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0) AS r FROM lineitem GROUP BY 1),
    p AS (SELECT l_partkey AS k, covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0) AS r FROM lineitem GROUP BY 1)
    SELECT 'MAS' AS metric, round(avg(r), 6) AS value FROM s UNION ALL SELECT 'MAC', round(avg(r), 6) FROM p""",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    r = maths.safe_corr(F.col("l_quantity"), F.col("l_extendedprice")).alias("r")
    one = lambda key, name: li.groupBy(key).agg(r).agg(F.round(F.avg("r"), 6).alias("value")).select(F.lit(name).alias("metric"), "value")
    return one("l_suppkey", "MAS").unionByName(one("l_partkey", "MAC"))


@query(
    "ag6_per_sample_table",
    """SELECT l_suppkey AS sample, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN covar_pop(l_discount, l_tax) / nullif(stddev_pop(l_discount) * stddev_pop(l_tax), 0) END, 6) AS r,
    round(avg(CASE WHEN abs(l_discount - l_tax) <= 0.02 THEN 1.0 ELSE 0.0 END), 6) AS close_share FROM lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(
        F.count("*").alias("n"),
        F.round(F.when(F.count("*") >= 3, maths.safe_corr(d, t)), 6).alias("r"),
        F.round(F.avg(F.when(F.abs(d - t) <= 0.02, 1.0).otherwise(0.0)), 6).alias("close_share"),
    )


@query("ag7_ag9_repeated_cells", f"SELECT count(*) AS cells, round(avg(beta), 6) AS mean FROM ({BETA})")
def _(spark, sf_dir):
    return beta(spark, sf_dir).agg(F.count("*").alias("cells"), F.round(F.avg("beta"), 6).alias("mean"))


@query(
    "ag8_two_level_mean",
    """WITH d AS (SELECT n_regionkey, c_nationkey, avg(c_acctbal) AS m FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1, 2)
    SELECT n_regionkey, count(m) AS donors, CASE WHEN count(m) >= least(2, count(*)) THEN round(avg(m), 4) END AS mean FROM d GROUP BY 1""",
)
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    d = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("m")).join(n, "c_nationkey")
    return d.groupBy("n_regionkey").agg(F.count("m").alias("donors"), F.when(F.count("m") >= F.least(F.lit(2), F.count("*")), F.round(F.avg("m"), 4)).alias("mean"))


@query("ag10_collapsed_activity", "SELECT p_brand, round(avg(log2(p_retailprice + 1)), 6) AS activity, count(*) FILTER (WHERE p_size >= 10) AS n_expressed FROM part GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg(F.log2(F.col("p_retailprice") + 1)), 6).alias("activity"), F.count_if(F.col("p_size") >= 10).alias("n_expressed"))


PIXELS = "SELECT least(l_partkey % 50, l_suppkey % 50) AS i, greatest(l_partkey % 50, l_suppkey % 50) AS j, sum(l_linenumber) AS n FROM lineitem GROUP BY 1, 2"


def pixels(spark, sf_dir):
    a, b = F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    return table(spark, sf_dir, "lineitem").groupBy(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).agg(F.sum("l_linenumber").alias("n"))


@query(
    "ag11_ag12_bin_coverage",
    f"WITH p AS ({PIXELS}), c AS (SELECT i AS b, n FROM p UNION ALL SELECT j, n FROM p WHERE i <> j), t AS (SELECT b, CAST(sum(n) AS BIGINT) AS coverage FROM c GROUP BY 1), q AS (SELECT quantile_cont(coverage, 0.1) AS q FROM t) SELECT b AS bin, coverage, coverage >= q AS valid FROM t, q",
)
def _(spark, sf_dir):
    p = pixels(spark, sf_dir)
    c = p.select(F.col("i").alias("bin"), "n").unionByName(p.where("i <> j").select(F.col("j").alias("bin"), "n")).groupBy("bin").agg(F.sum("n").alias("coverage"))
    return c.crossJoin(F.broadcast(c.agg(F.percentile("coverage", 0.1).alias("q")))).select("bin", "coverage", (F.col("coverage") >= F.col("q")).alias("valid"))


@query(
    "ag13_distance_expected",
    f"WITH p AS ({PIXELS}), d AS (SELECT j - i AS d, sum(n) / (50 - (j - i)) AS expected FROM p GROUP BY 1) SELECT i, j, round(n / expected, 6) AS oe FROM p JOIN d ON d.d = j - i",
)
def _(spark, sf_dir):
    p = pixels(spark, sf_dir).withColumn("d", F.col("j") - F.col("i"))
    d = p.groupBy("d").agg((F.sum("n") / (50 - F.col("d"))).alias("expected"))  # every pair of the 50 bins counts, zero or not
    return p.join(d, "d").select("i", "j", F.round(F.col("n") / F.col("expected"), 6).alias("oe"))


@query(
    "ag14_prefix_sum_windows",
    "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 4) AS window_sum FROM events",
)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, 5)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.sum("value").over(w), 4).alias("window_sum"))


@query("ag15_value_counts", "SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("ag16_seed_summary", "SELECT p_brand, round(avg(p_retailprice), 4) AS mean, round(stddev_samp(p_retailprice), 4) AS sd, min(p_retailprice) AS lo, max(p_retailprice) AS hi, count(*) FILTER (WHERE p_retailprice > 1400) AS wins FROM part GROUP BY 1")
def _(spark, sf_dir):
    v = F.col("p_retailprice")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.count_if(v > 1400).alias("wins"))


@query(
    "ag17_across_strata",
    """SELECT 'flag' AS axis, l_returnflag AS stratum, round(avg(l_discount), 6) AS gain FROM lineitem GROUP BY 2 UNION ALL
    SELECT 'status', l_linestatus, round(avg(l_discount), 6) FROM lineitem GROUP BY 2 UNION ALL SELECT 'line', CAST(l_linenumber AS STRING), round(avg(l_discount), 6) FROM lineitem GROUP BY 2""",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.sum("l_discount").alias("s"), F.count("l_discount").alias("n"))
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), F.col(c).cast("string").alias("stratum")) for a, c in (("flag", "l_returnflag"), ("status", "l_linestatus"), ("line", "l_linenumber"))))
    long = cells.select("s", "n", F.inline(axes))
    return long.groupBy("axis", "stratum").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("gain"))


@query(
    "ag18_common_universe",
    "SELECT k FROM (SELECT c_nationkey AS k, 'c' AS o FROM customer UNION SELECT s_nationkey, 's' FROM supplier UNION SELECT n_nationkey, 'n' FROM nation) GROUP BY 1 HAVING count(*) = 3",
)
def _(spark, sf_dir):
    each = [table(spark, sf_dir, t).select(F.col(c).alias("k"), F.lit(t[0]).alias("o")).distinct() for t, c in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey"))]
    return each[0].union(each[1]).union(each[2]).groupBy("k").agg(F.count("*").alias("n")).where("n = 3").select("k")


@query(
    "ag19_distribution_quality",
    "SELECT l_returnflag, round(quantile_cont(l_discount, 0.05), 6) AS q05, round(quantile_cont(l_discount, 0.5), 6) AS q50, round(quantile_cont(l_discount, 0.95), 6) AS q95, round(avg(CASE WHEN l_discount = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero, round(avg(CASE WHEN l_discount < 0 OR l_discount > 1 THEN 1.0 ELSE 0.0 END), 6) AS outside FROM lineitem GROUP BY 1",
)
def _(spark, sf_dir):
    d = F.col("l_discount")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_discount")
    q = ordered.quantiles(li, "l_discount", [0.05, 0.5, 0.95], ("l_returnflag",)).withColumnRenamed("quantiles", "q")
    q = q.join(F.broadcast(li.groupBy("l_returnflag").agg(share(d == 0).alias("zero"), share((d < 0) | (d > 1)).alias("outside"))), "l_returnflag")  # a row a flag
    return q.select("l_returnflag", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q05", "q50", "q95"))), "zero", "outside")


@query("ag20_energy_share", "WITH e AS (SELECT label, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS e FROM embeddings) SELECT label, round(sum(e) / (SELECT sum(e) FROM e), 6) AS share FROM e GROUP BY 1")
def _(spark, sf_dir):
    from marlstone.functions import vectors

    e = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sum(vectors.dot(F.col("embedding"), F.col("embedding"))).alias("e"))
    return e.crossJoin(F.broadcast(e.agg(F.sum("e").alias("total")))).select("label", F.round(F.col("e") / F.col("total"), 6).alias("share"))


@query("ag21_weighted_mean", "SELECT l_returnflag, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 6).alias("mean"))


@query(
    "ag22_correlation_ratio_smd",
    """WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1), t AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS ss FROM customer),
    a AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer WHERE c_nationkey < 12), b AS (SELECT avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer WHERE c_nationkey >= 12)
    SELECT round((SELECT sum(n * pow(g.m - t.m, 2)) FROM g, t) / (SELECT ss FROM t), 6) AS eta2, round((a.m - b.m) / nullif(sqrt((a.v + b.v) / 2), 0), 6) AS smd FROM a, b""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    g = c.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    t = c.agg(F.avg("c_acctbal").alias("tm"), (F.var_pop("c_acctbal") * F.count("*")).alias("ss"))
    eta = g.crossJoin(F.broadcast(t)).agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("tm"), 2)) / F.first("ss")).alias("eta2"))
    x = F.when(F.col("c_nationkey") < 12, F.col("c_acctbal"))
    y = F.when(F.col("c_nationkey") >= 12, F.col("c_acctbal"))
    smd = c.agg(((F.avg(x) - F.avg(y)) / F.nullif(F.sqrt((F.var_pop(x) + F.var_pop(y)) / 2), F.lit(0.0))).alias("smd"))
    return eta.crossJoin(F.broadcast(smd)).select(F.round("eta2", 6).alias("eta2"), F.round("smd", 6).alias("smd"))


@query(
    "ag22_ks_distance",
    """WITH c AS (SELECT c_acctbal AS x, sum(CASE WHEN c_nationkey < 12 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN c_nationkey < 12 THEN 0 ELSE 1 END) AS b FROM customer GROUP BY 1),
    f AS (SELECT sum(a) OVER (ORDER BY x) / sum(a) OVER () - sum(b) OVER (ORDER BY x) / sum(b) OVER () AS d FROM c) SELECT round(max(abs(d)), 6) AS ks FROM f""",
)
def _(spark, sf_dir):
    return ordered.ks_distance(table(spark, sf_dir, "customer"), "c_acctbal", F.col("c_nationkey") < 12).select(F.round("ks", 6).alias("ks"))


@query(
    "ag24_block_statistics",
    "SELECT l_linenumber AS block, count(*) AS n, round(sum(l_quantity), 4) AS sx, round(sum(l_quantity * l_quantity), 4) AS sxx, round(sum(l_quantity * l_tax), 4) AS sxy FROM lineitem GROUP BY 1",
)
def _(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("block")).agg(F.count("*").alias("n"), F.round(F.sum(q), 4).alias("sx"), F.round(F.sum(q * q), 4).alias("sxx"), F.round(F.sum(q * F.col("l_tax")), 4).alias("sxy"))


@query("ag25_per_type_counts", "SELECT p_type, count(*) AS n, count(*) >= 10 AS enough FROM part GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n"), (F.count("*") >= 10).alias("enough"))


@query("ag26_pivot", "SELECT l_returnflag, round(avg(l_tax) FILTER (WHERE l_linestatus = 'F'), 6) AS f, round(avg(l_tax) FILTER (WHERE l_linestatus = 'O'), 6) AS o FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_tax"))
    return p.select("l_returnflag", F.round("F", 6).alias("f"), F.round("O", 6).alias("o"))


@query(
    "ag27_difference_in_differences",
    "SELECT l_linenumber, round((avg(l_tax) FILTER (WHERE l_returnflag = 'A' AND l_quantity > 25) - avg(l_tax) FILTER (WHERE l_returnflag = 'A' AND l_quantity <= 25)) - (avg(l_tax) FILTER (WHERE l_returnflag = 'R' AND l_quantity > 25) - avg(l_tax) FILTER (WHERE l_returnflag = 'R' AND l_quantity <= 25)), 6) AS did FROM lineitem GROUP BY 1",
)
def _(spark, sf_dir):
    m = lambda flag, big: F.avg(F.when((F.col("l_returnflag") == flag) & ((F.col("l_quantity") > 25) == big), F.col("l_tax")))
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round((m("A", True) - m("A", False)) - (m("R", True) - m("R", False)), 6).alias("did"))


@query(
    "ag28_coverage_matrix",
    "SELECT p_brand, CASE WHEN count(*) FILTER (WHERE p_size > 45) > 0 THEN 'HAVE' WHEN count(*) FILTER (WHERE p_size > 40) > 0 THEN 'PROXY' ELSE 'MISSING' END AS large, arg_max(p_partkey, (p_size, p_partkey)) AS preferred FROM part GROUP BY 1",
)
def _(spark, sf_dir):
    s = F.col("p_size")
    state = F.when(F.count_if(s > 45) > 0, "HAVE").when(F.count_if(s > 40) > 0, "PROXY").otherwise("MISSING")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(state.alias("large"), F.max_by("p_partkey", F.struct("p_size", "p_partkey")).alias("preferred"))


# ---- splits and sampling ---------------------------------------------------------------------------------------


@query("sp1_group_split", f"WITH {SPLIT_SQL} SELECT sample, split FROM g")
def _(spark, sf_dir):
    return splits.group_split(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample")).distinct(), "sample", seed=17)


@query(
    "sp2_sp12_held_out_loci",
    "WITH r AS (SELECT p_partkey, row_number() OVER (ORDER BY sha256(CAST(p_partkey AS STRING) || ':17')) AS rn, count(*) OVER () AS n FROM part) SELECT p_partkey, rn <= greatest(round_even(n * 0.1, 0), 1) AS held_out FROM r",
)
def _(spark, sf_dir):
    return splits.held_out(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 0.1, seed=17)


@query(
    "sp5_round_robin_folds",
    "SELECT n_name AS block, CAST((row_number() OVER (ORDER BY sha256(n_name || ':17')) - 1) % 5 AS INTEGER) AS fold FROM nation",
)
def _(spark, sf_dir):
    return splits.block_folds(table(spark, sf_dir, "nation").select(F.col("n_name").alias("block")), "block", 5, seed=17)


@query("sp6_leave_one_group_out", "SELECT a.r_name AS held_out, b.r_name AS train FROM region a JOIN region b ON a.r_name <> b.r_name")
def _(spark, sf_dir):
    r = table(spark, sf_dir, "region")
    groups = r.agg(F.collect_set("r_name").alias("all"))  # the fixed list of regions
    return r.crossJoin(F.broadcast(groups)).select(F.col("r_name").alias("held_out"), F.explode("all").alias("train")).where("held_out <> train")


@query(
    "sp7_pair_folds",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 5 = l_suppkey % 5 THEN CAST(l_partkey % 5 AS INTEGER) ELSE -1 END AS fold FROM lineitem",
)
def _(spark, sf_dir):
    a, b = F.col("l_partkey") % 5, F.col("l_suppkey") % 5
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(a == b, a.cast("int")).otherwise(F.lit(-1)).alias("fold"))


@query(
    "sp8_stratified_largest_remainder",
    """WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS STRING) || ':17')) AS rn FROM customer),
    q AS (SELECT c_mktsegment, count(*) * 0.2 AS want, floor(count(*) * 0.2) AS base FROM customer GROUP BY 1),
    t AS (SELECT CAST(round_even(sum(want), 0) - sum(base) AS BIGINT) AS extra FROM q),
    k AS (SELECT c_mktsegment, base + CASE WHEN row_number() OVER (ORDER BY want - base DESC, c_mktsegment) <= extra THEN 1 ELSE 0 END AS quota FROM q, t)
    SELECT c_custkey, CASE WHEN rn <= quota THEN 'test' ELSE 'train' END AS split FROM r JOIN k USING (c_mktsegment)""",
)
def _(spark, sf_dir):
    return splits.stratified(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", "c_mktsegment", 0.2, seed=17)


@query(
    "sp10_observed_and_target_panels",
    """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY sha256(CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':23')) AS rn FROM lineitem WHERE l_discount IS NOT NULL)
    SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN rn <= 8 THEN 'observed' ELSE 'target' END AS role FROM r WHERE rn <= 12""",
)
def _(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(lookups.hash_rank("l_orderkey", "l_linenumber", seed=23))
    r = table(spark, sf_dir, "lineitem").where("l_discount is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 12")
    return r.select("l_suppkey", "l_orderkey", "l_linenumber", F.when(F.col("rn") <= 8, "observed").otherwise("target").alias("role"))


@query("sp11_fraction_per_batch", "SELECT o_orderkey, CASE CAST(('0x' || substr(sha256(CAST(o_orderkey AS STRING) || ':17'), 1, 4)) AS BIGINT) % 3 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 ELSE 0.75 END::DOUBLE AS fraction FROM orders")
def _(spark, sf_dir):
    k = F.conv(F.substring(lookups.hash_rank("o_orderkey", seed=17), 1, 4), 16, 10).cast("long") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, 0.25).when(k == 1, 0.5).otherwise(0.75).alias("fraction"))


@query(
    "sp14_split_half",
    """WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER w AS rn, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY sha256(CAST(c_custkey AS STRING) || ':5')))
    SELECT c_custkey, CASE WHEN rn <= n // 2 THEN 0 ELSE 1 END AS half FROM r WHERE rn <= 2 * (n // 2)""",
)
def _(spark, sf_dir):
    r = splits.hash_positions(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", 5, ("c_nationkey",))
    r = r.select("c_custkey", (F.col("_rn") + 1).alias("rn"), F.floor(F.col("_n") / 2).alias("h"))
    return r.where(F.col("rn") <= 2 * F.col("h")).select("c_custkey", F.when(F.col("rn") <= F.col("h"), 0).otherwise(1).alias("half"))


@query(
    "sp17_label_permutation",
    """WITH o AS (SELECT c_custkey, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS a, row_number() OVER (PARTITION BY c_nationkey ORDER BY sha256(CAST(c_custkey AS STRING) || ':3')) AS b FROM customer)
    SELECT x.c_custkey, y.c_mktsegment AS permuted FROM o x JOIN o y ON x.c_nationkey = y.c_nationkey AND x.a = y.b""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    o = pair_space.places(c, "c_custkey", ("c_nationkey",), "a", "n")
    y = splits.hash_positions(c, "c_custkey", 3, ("c_nationkey",)).select("c_nationkey", F.col("_rn").alias("a"), F.col("c_mktsegment").alias("permuted"))
    return o.select("c_custkey", "c_nationkey", "a").join(y, ["c_nationkey", "a"]).select("c_custkey", "permuted")
