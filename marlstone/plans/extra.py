"""Further queries of the inventory: liftover, residuals, matching variants, samples, audits, composites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import maths, vectors
from marlstone.operators import bootstrap, graph, linear, lookups, matching, neighbours, ordered, pair_space, splits
from marlstone.plans.registry import query
from marlstone.session import table


@query(
    "pr8_liftover",
    """WITH c AS (SELECT c_nationkey AS chrom, CAST(floor(c_acctbal) AS BIGINT) AS start, CAST(floor(c_acctbal) AS BIGINT) + c_custkey % 40 AS stop, c_custkey AS shift FROM customer),
    p AS (SELECT s_suppkey, s_nationkey AS chrom, CAST(floor(s_acctbal) AS BIGINT) AS pos FROM supplier),
    h AS (SELECT p.s_suppkey, count(c.shift) AS n, max(p.pos + c.shift) AS lifted FROM p LEFT JOIN c ON c.chrom = p.chrom AND p.pos BETWEEN c.start AND c.stop GROUP BY 1)
    SELECT s_suppkey, CASE WHEN n = 0 THEN 'unmapped' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN lifted END AS lifted FROM h""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("chrom"), F.floor("c_acctbal").cast("long").alias("start"), (F.floor("c_acctbal") + F.col("c_custkey") % 40).cast("long").alias("stop"), F.col("c_custkey").alias("shift")
    )
    p = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("chrom"), F.floor("s_acctbal").cast("long").alias("start"))
    p = p.withColumn("stop", F.col("start"))
    hits = lookups.overlapping(p, c, 64, ("chrom",)).groupBy("s_suppkey").agg(F.count("*").alias("n"), F.max(F.col("start") + F.col("r_shift")).alias("lifted"))
    n = F.coalesce("n", F.lit(0))
    status = F.when(n == 0, "unmapped").when(n == 1, "ok").otherwise("ambiguous")
    return p.select("s_suppkey").join(hits, "s_suppkey", "left").select("s_suppkey", status.alias("status"), F.when(n == 1, F.col("lifted")).alias("lifted"))


@query(
    "ar8_residual_pearson",
    """WITH x AS (SELECT a.vec_id, unnest(a.embedding)::DOUBLE AS x, unnest(b.embedding)::DOUBLE AS y, generate_subscripts(a.embedding, 1)::DOUBLE AS z FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    s AS (SELECT vec_id, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz FROM x GROUP BY 1)
    SELECT vec_id, round((xy - xz * yz / zz) / sqrt((xx - xz * xz / zz) * (yy - yz * yz / zz)), 6) AS residual_pearson FROM s""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x = e.join(b, "vec_id").select("vec_id", F.posexplode(F.arrays_zip(F.col("embedding").alias("x"), F.col("other").alias("y"))).alias("z", "p"))
    cov = lambda a, b, n: F.covar_pop(a, b).alias(n)
    c = {"x": F.col("p.x").cast("double"), "y": F.col("p.y").cast("double"), "z": (F.col("z") + 1).cast("double")}
    s = x.groupBy("vec_id").agg(*(cov(c[i], c[j], i + j) for i, j in ("xy", "xz", "yz", "xx", "yy", "zz")))
    f = F.col
    r = (f("xy") - f("xz") * f("yz") / f("zz")) / F.sqrt((f("xx") - f("xz") * f("xz") / f("zz")) * (f("yy") - f("yz") * f("yz") / f("zz")))
    return s.select("vec_id", F.round(r, 6).alias("residual_pearson"))


@query(
    "ar11_breadth",
    """WITH w AS (SELECT p_brand, 1.0 / count(*) AS w FROM part GROUP BY 1) SELECT l_suppkey, p_brand, round(sum(w), 6) AS breadth FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN w USING (p_brand) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    w = p.groupBy("p_brand").agg((1 / F.count("*")).alias("w"))
    hits = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(p, "l_partkey").join(w, "p_brand")
    return hits.groupBy("l_suppkey", "p_brand").agg(F.round(F.sum("w"), 6).alias("breadth"))


@query(
    "jn24_far_neighbours",
    """WITH d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS s
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) <= 10)
    SELECT query, count(*) AS far FROM k WHERE abs(query - neighbour) >= 50 GROUP BY 1""",
)
def _(spark, sf_dir):
    n = neighbours.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)
    return n.where(F.abs(F.col("query") - F.col("neighbour")) >= 50).groupBy("query").agg(F.count("*").alias("far"))


@query(
    "jn26_matched_pairs",
    """WITH t AS (SELECT o_orderkey, o_orderpriority AS g, least(CAST(floor(o_totalprice / 50000) AS BIGINT), 9) AS b, o_orderstatus = 'F' AS pos, sha256(CAST(o_orderkey AS STRING) || ':17') AS h FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY g, b, pos ORDER BY h) AS rn FROM t) SELECT p.o_orderkey AS a, n.o_orderkey AS b FROM r p JOIN r n ON p.g = n.g AND p.b = n.b AND p.rn = n.rn AND p.pos AND NOT n.pos""",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("g"), F.least(F.floor(F.col("o_totalprice") / 50000), F.lit(9)).alias("bin"), (F.col("o_orderstatus") == "F").alias("pos"))
    r = splits.hash_positions(o, "o_orderkey", 17, ("g", "bin", "pos")).withColumnRenamed("_rn", "rn")
    side = lambda pos, name: r.where(F.col("pos") == pos).select("g", "bin", "rn", F.col("o_orderkey").alias(name))
    return side(True, "a").join(side(False, "b"), ["g", "bin", "rn"]).select("a", "b")


@query(
    "jn29_prevalence_matched",
    """WITH p AS (SELECT l_partkey, l_returnflag = 'R' AS g, CAST(floor(ln(count(*)) / ln(2)) AS BIGINT) AS bin, sha256(CAST(l_partkey AS STRING) || ':3') AS h FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY 1, 2),
    k AS (SELECT bin, least(count(*) FILTER (WHERE g), count(*) FILTER (WHERE NOT g)) AS k FROM p GROUP BY 1)
    SELECT l_partkey, g FROM p JOIN k USING (bin) QUALIFY row_number() OVER (PARTITION BY bin, g ORDER BY h) <= max(k) OVER (PARTITION BY bin, g)""",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("R", "A"))
    p = li.groupBy("l_partkey", (F.col("l_returnflag") == "R").alias("g")).agg(F.floor(F.log(F.count("*")) / F.log(F.lit(2.0))).alias("bin"))
    k = p.groupBy("bin").agg(F.least(F.count_if("g"), F.count_if(~F.col("g"))).alias("k"))
    r = splits.hash_positions(p, "l_partkey", 3, ("bin", "g")).join(k, "bin")
    return r.where("_rn < k").select("l_partkey", "g")


@query(
    "ag23_cq15_partial_spearman",
    """WITH t AS (SELECT c_mktsegment AS s, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y, CAST(c_custkey AS DOUBLE) AS z FROM customer),
    r AS (SELECT s, rank() OVER (PARTITION BY s ORDER BY x) + (count(*) OVER (PARTITION BY s, x) - 1) / 2 AS x, rank() OVER (PARTITION BY s ORDER BY y) + (count(*) OVER (PARTITION BY s, y) - 1) / 2 AS y, rank() OVER (PARTITION BY s ORDER BY z) + (count(*) OVER (PARTITION BY s, z) - 1) / 2 AS z FROM t),
    c AS (SELECT s, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS xy, covar_pop(x, z) / nullif(stddev_pop(x) * stddev_pop(z), 0) AS xz, covar_pop(y, z) / nullif(stddev_pop(y) * stddev_pop(z), 0) AS yz FROM r GROUP BY 1)
    SELECT s AS stratum, round(xy, 6) AS raw, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) AS partial FROM c""",
)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("stratum"), "c_acctbal", "c_nationkey", "c_custkey")
    for c, n in (("c_acctbal", "x"), ("c_nationkey", "y"), ("c_custkey", "z")):
        t = ordered.mid_ranks(t, c, n, by=("stratum",))
    r = lambda a, b: maths.safe_corr(F.col(a), F.col(b)).alias(a + b)
    c = t.groupBy("stratum").agg(r("x", "y"), r("x", "z"), r("y", "z"))
    xy, xz, yz = F.col("xy"), F.col("xz"), F.col("yz")
    return c.select("stratum", F.round(xy, 6).alias("raw"), F.round((xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz)), 6).alias("partial"))


@query("wn18_greedy_selection")
def _(spark, sf_dir):
    """Four of the fifty brands' sizes: relevance less redundancy, one at a time over a small matrix of tracks."""
    li = table(spark, sf_dir, "lineitem")
    m = li.groupBy((F.col("l_suppkey") % 50).alias("s"), (F.col("l_linenumber")).cast("string").alias("track")).agg(F.avg("l_extendedprice").alias("v"))
    pair = m.join(m.select("s", F.col("track").alias("b"), F.col("v").alias("w")), "s").where("track < b").groupBy(F.col("track").alias("a"), "b").agg(maths.safe_corr(F.col("v"), F.col("w")).alias("r"))
    relevance = m.groupBy("track").agg((F.stddev_pop("v") / F.avg("v")).alias("relevance"))
    chosen = matching.greedy_redundancy(relevance, pair, 4)
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(chosen)], "place int, track string")


@query("wn19_sp16_seeded_controls", "SELECT vec_id, substr(sha256(CAST(vec_id AS STRING) || ':29'), 1, 16) AS control FROM embeddings")
def _(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.substring(lookups.hash_rank("vec_id", seed=29), 1, 16).alias("control"))


@query(
    "so10_threshold_components",
    """WITH RECURSIVE n AS (SELECT DISTINCT p_partkey AS id FROM part), e AS (SELECT p_partkey AS a, p_partkey + 7 AS b FROM part WHERE p_size > 30 AND p_partkey + 7 IN (SELECT id FROM n)),
    s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT id, id AS c FROM n UNION SELECT s.b, r.c FROM r JOIN s ON s.a = r.id WHERE r.c < s.b)
    SELECT id, min(c) AS component FROM r GROUP BY 1""",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    e = p.where("p_size > 30").select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    return graph.components(p, e.join(p.select(F.col("id").alias("b")), "b", "left_semi"))


@query(
    "sp9_split_by_running_size",
    """WITH g AS (SELECT c_nationkey AS g, count(*) AS n FROM customer GROUP BY 1), r AS (SELECT g, n, sum(n) OVER (ORDER BY sha256(CAST(g AS STRING) || ':11') ROWS UNBOUNDED PRECEDING) - n AS before, sum(n) OVER () AS total FROM g),
    t AS (SELECT min(before) FILTER (WHERE before >= 0.1 * total) AS filled FROM r)
    SELECT g, CASE WHEN before < 0.1 * total THEN 'test' WHEN before - filled < 0.1 * total THEN 'validation' ELSE 'train' END AS split FROM r, t""",
)
def _(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.count("*").alias("n"))
    w = Window.orderBy(lookups.hash_rank("g", seed=11))  # a row a study, a few dozen
    r = g.select("g", (F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    # test takes studies until it is filled, then validation does, whatever test has taken too much
    r = r.withColumn("filled", F.min(F.when(F.col("before") >= 0.1 * F.col("total"), F.col("before"))).over(Window.partitionBy(F.lit(0))))
    split = F.when(F.col("before") < 0.1 * F.col("total"), "test").when(F.col("before") - F.col("filled") < 0.1 * F.col("total"), "validation").otherwise("train")
    return r.select("g", split.alias("split"))


#: The first `wanted` different draws of each group g (k, total), or hash order where that is half the space or more.
PICKED = """d AS (SELECT k, t AS o, ('0x' || substr(sha256('17:' || k || ':' || t), 1, 12))::BIGINT % total AS r FROM g, range(4 * {wanted} + 64) x(t) WHERE total > 2 * {wanted}
      UNION ALL SELECT k, ('0x' || substr(sha256('17:order:' || k || ':' || t), 1, 12))::BIGINT % 1099511627776, t FROM g, range(2 * {wanted}) x(t) WHERE total <= 2 * {wanted} AND t < total),
    f AS (SELECT k, r FROM (SELECT k, r, min(o) AS o FROM d GROUP BY k, r) QUALIFY row_number() OVER (PARTITION BY k ORDER BY o, r) <= {wanted})"""


@query(
    "sp13_distance_binned_pairs",
    f"""WITH p AS (SELECT p_partkey AS id, p_brand AS chrom, CAST(floor(p_retailprice) AS BIGINT) AS pos FROM part),
    c AS (SELECT a.id AS a, b.id AS b, CAST((b.pos - a.pos) // 5 AS BIGINT) AS k, b.pos - a.pos AS distance, row_number() OVER (PARTITION BY (b.pos - a.pos) // 5 ORDER BY a.id, b.pos, b.id) - 1 AS r
      FROM p a JOIN p b ON a.chrom = b.chrom AND (b.pos > a.pos OR b.pos = a.pos AND b.id > a.id) AND b.pos - a.pos < 20),
    g AS (SELECT k, count(*) AS total FROM c GROUP BY 1), {PICKED.format(wanted=40)}
    SELECT least(a, b) AS i, greatest(a, b) AS j, CAST(k AS INTEGER) AS bin, distance FROM c JOIN f USING (k, r)""",
)
def _(spark, sf_dir):
    """Forty sampled pairs a distance bin; only they are looked up."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chrom"), F.floor("p_retailprice").cast("long").alias("pos"))
    return pair_space.binned_pairs(p, [0, 5, 10, 15, 20], 40, seed=17, stretch=100.0)


@query(
    "sp13_crossing_pairs",
    f"""WITH c AS (SELECT 0 AS k, a.p_partkey AS a, b.p_partkey AS b, row_number() OVER (ORDER BY a.p_brand, a.p_partkey, b.p_brand, b.p_partkey) - 1 AS r FROM part a JOIN part b ON b.p_brand > a.p_brand),
    g AS (SELECT k, count(*) AS total FROM c GROUP BY 1), {PICKED.format(wanted=100)}
    SELECT least(a, b) AS i, greatest(a, b) AS j FROM c JOIN f USING (k, r)""",
)
def _(spark, sf_dir):
    """A hundred sampled pairs of different chromosomes."""
    return pair_space.crossing_pairs(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("chrom")), 100, seed=17)


@query(
    "sp15_negative_pools",
    """WITH k AS (SELECT DISTINCT l_suppkey % 40 AS a, l_partkey % 40 AS b FROM lineitem WHERE l_discount > 0.09), g AS (SELECT x.v AS a, y.v AS b FROM range(40) x(v), range(40) y(v))
    SELECT a, b, b - a AS distance FROM g ANTI JOIN k USING (a, b) WHERE b > a QUALIFY row_number() OVER (PARTITION BY b - a ORDER BY sha256(CAST(a AS STRING) || ':' || CAST(b AS STRING) || ':17')) <= 5""",
)
def _(spark, sf_dir):
    seen = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b")).distinct()
    grid = spark.range(40).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"))).alias("b")).where("b > a")
    free = grid.join(seen, ["a", "b"], "left_anti").withColumn("distance", F.col("b") - F.col("a"))
    w = Window.partitionBy("distance").orderBy(lookups.hash_rank("a", "b", seed=17))
    return free.withColumn("rn", F.row_number().over(w)).where("rn <= 5").drop("rn")


@query(
    "sp18_stratified_folds",
    "SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY sha256(CAST(c_custkey AS STRING) || ':17')) - 1) % 5 AS INTEGER) AS fold FROM customer",
)
def _(spark, sf_dir):
    c = splits.hash_positions(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 17, ("c_mktsegment",))
    return c.select("c_custkey", (F.col("_rn") % 5).cast("int").alias("fold"))


@query("me15_sample_bootstrap")
def _(spark, sf_dir):
    """Resampled R2 of price on quantity from five sums a sample: rows are added up first, samples are drawn after."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    s = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(*(F.sum(e).alias(n) for n, e in (("n", F.lit(1.0)), ("x", x), ("y", y), ("xx", x * x), ("yy", y * y), ("xy", x * y))))
    d = s.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(199))))
    u = F.pmod(F.xxhash64("r", "l_suppkey", F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    w = -F.log(u + 1e-12)
    t = d.groupBy("r").agg(*(F.sum(w * F.col(c)).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    f = F.col
    r2 = F.pow(f("xy") - f("x") * f("y") / f("n"), 2) / ((f("xx") - f("x") * f("x") / f("n")) * (f("yy") - f("y") * f("y") / f("n")))
    return t.select(r2.alias("r2")).agg(F.round(F.percentile("r2", 0.025), 5).alias("lo"), F.round(F.percentile("r2", 0.5), 5).alias("mid"), F.round(F.percentile("r2", 0.975), 5).alias("hi"))


@query(
    "me16_paired_mixture_bootstrap",
    """WITH n AS (SELECT l_linenumber % 3 AS ms, l_returnflag AS block, l_orderkey * 8 + l_linenumber AS pair, l_discount AS pa, l_tax AS na, l_quantity / 500 AS pb, l_tax AS nb, row_number() OVER (PARTITION BY l_linenumber % 3, l_returnflag ORDER BY l_orderkey * 8 + l_linenumber) - 1 AS k, count(*) OVER (PARTITION BY l_linenumber % 3, l_returnflag) AS m
      FROM (SELECT l_linenumber, l_returnflag, l_orderkey, max(l_discount) AS l_discount, max(l_tax) AS l_tax, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2, 3)),
    s AS (SELECT ms, row_number() OVER (ORDER BY ms) - 1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT ms FROM n)),
    h AS (SELECT r, ms FROM range(24) t(r), s WHERE i = ('0x' || substr(sha256('5:seed:' || r), 1, 12))::BIGINT % c),
    w AS (SELECT r, ms, block, ('0x' || substr(sha256('5:' || r || ':' || block || ':' || k), 1, 12))::BIGINT % m AS k, count(*) AS w FROM n JOIN h USING (ms) GROUP BY ALL UNION ALL SELECT -1 - ms, ms, block, k, 1 FROM n),
    p AS (SELECT r, w, pa, na, pb, nb FROM w JOIN n USING (ms, block, k)),
    l AS (SELECT 'one' AS arm, r, pa AS x, w AS p, 0 AS q FROM p UNION ALL SELECT 'one', r, na, 0, w FROM p UNION ALL SELECT 'two', r, pb, w, 0 FROM p UNION ALL SELECT 'two', r, nb, 0, w FROM p),
    g AS (SELECT arm, r, x, sum(p) AS p, sum(q) AS q, sum(sum(q)) OVER (PARTITION BY arm, r ORDER BY x) - sum(q) / 2 AS below FROM l GROUP BY arm, r, x),
    a AS (SELECT arm, r, sum(p * below) / (sum(p) * sum(q)) AS v FROM g GROUP BY arm, r),
    t AS (SELECT 'auc' AS kind, arm, '' AS comparison, r, v FROM a UNION ALL SELECT 'delta', 'one', 'one - two', x.r, x.v - y.v FROM a x JOIN a y ON x.r = y.r AND x.arm = 'one' AND y.arm = 'two')
    SELECT kind, arm, comparison, round(avg(v) FILTER (WHERE r < 0), 5) AS estimate, round(stddev_samp(v) FILTER (WHERE r < 0), 5) AS between_seed_sd, round(min(v) FILTER (WHERE r < 0), 5) AS seed_min, round(max(v) FILTER (WHERE r < 0), 5) AS seed_max,
    round(quantile_cont(v, 0.025) FILTER (WHERE r >= 0), 5) AS ci_lo, round(quantile_cont(v, 0.975) FILTER (WHERE r >= 0), 5) AS ci_hi,
    CASE WHEN kind = 'delta' THEN round(least(1, 2 * (least(count(*) FILTER (WHERE r >= 0 AND v <= 0), count(*) FILTER (WHERE r >= 0 AND v >= 0)) / count(*) FILTER (WHERE r >= 0) + 1 / (count(*) FILTER (WHERE r >= 0) + 1))), 5) END AS p FROM t GROUP BY kind, arm, comparison""",
)
def _(spark, sf_dir):
    """Two scores of matched pairs; a replicate takes one match seed, and draws its pairs within each block."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag", "l_orderkey").agg(*(F.max(c).alias(c) for c in ("l_discount", "l_tax", "l_quantity")))
    pairs = li.select((F.col("l_linenumber") % 3).alias("ms"), F.col("l_returnflag").alias("block"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pair"), F.col("l_discount").alias("pa"), F.col("l_tax").alias("na"), (F.col("l_quantity") / 500).alias("pb"))
    told = bootstrap.mixture_report(pairs, "ms", "block", "pair", {"one": ("pa", "na"), "two": ("pb", "na")}, 24, 5, [("one", "two")])
    return told.select("kind", "arm", "comparison", *(F.round(c, 5).alias(c) for c in ("estimate", "between_seed_sd", "seed_min", "seed_max", "ci_lo", "ci_hi", "p")))


@query("me25_concordance", "SELECT l_linenumber, count(*) AS n, round(covar_pop(l_discount, l_tax) / nullif(stddev_pop(l_discount) * stddev_pop(l_tax), 0), 6) AS r, round(avg(abs(l_discount - l_tax)), 6) AS mae FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(maths.safe_corr(d, t), 6).alias("r"), F.round(F.avg(F.abs(d - t)), 6).alias("mae"))


@query("ml5_ml10_residual_profiles")
def _(spark, sf_dir):
    """Cross-fitted residuals of a label on vectors, by label: what the fit leaves on rows it hasn't seen."""
    e = table(spark, sf_dir, "embeddings").withColumn("fold", (F.col("vec_id") % 4).cast("int")).withColumn("y", F.col("label").cast("double"))
    b, _a = linear.blocked_ridge(e, "embedding", "y", "fold", [1.0, 10.0])
    p = linear.out_of_fold(e, "embedding", "fold", b)
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("y") - F.col("prediction")), 4).alias("residual"))


@query(
    "cq1_profile_similarity",
    """WITH p AS (SELECT a.vec_id, a.label AS s, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS x, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    r AS (SELECT s, rank() OVER (PARTITION BY s ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY s, round(x, 9)) - 1) / 2 AS p, rank() OVER (PARTITION BY s ORDER BY y) + (count(*) OVER (PARTITION BY s, y) - 1) / 2 AS q FROM p)
    SELECT s AS label, count(*) AS n, round(covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0), 5) AS spearman FROM r GROUP BY 1""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("o"), F.col("label").alias("m"))
    t = e.join(b, "vec_id").select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("o")), 9).alias("x"), (F.col("label") == F.col("m")).cast("double").alias("y"))
    r = ordered.mid_ranks(ordered.mid_ranks(t, "x", "p", ("label",)), "y", "q", ("label",))
    return r.groupBy("label").agg(F.count("*").alias("n"), F.round(maths.safe_corr(F.col("p"), F.col("q")), 5).alias("spearman"))


@query(
    "cq14_stratum_comparison",
    """WITH g AS (SELECT c_mktsegment AS s, avg(c_acctbal) AS m, var_samp(c_acctbal) AS v FROM customer GROUP BY 1) SELECT a.s AS a, b.s AS b, round((a.m - b.m) / nullif(sqrt((a.v + b.v) / 2), 0), 6) AS smd FROM g a JOIN g b ON a.s < b.s""",
)
def _(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("s")).agg(F.avg("c_acctbal").alias("m"), F.var_samp("c_acctbal").alias("v"))
    rest = g.agg(F.collect_list(F.struct("s", "m", "v")).alias("all"))  # the handful of strata
    p = g.crossJoin(F.broadcast(rest)).select(F.col("s").alias("a"), "m", "v", F.explode("all").alias("o")).where("a < o.s")
    return p.select("a", F.col("o.s").alias("b"), F.round((F.col("m") - F.col("o.m")) / F.nullif(F.sqrt((F.col("v") + F.col("o.v")) / 2), F.lit(0.0)), 6).alias("smd"))


@query("cq17_overlaps_by_assay", "SELECT l_suppkey, count(DISTINCT l_partkey) FILTER (WHERE p_size < 25) AS small, count(DISTINCT l_partkey) FILTER (WHERE p_size >= 25) AS large FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    t = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().join(p, "l_partkey")
    return t.groupBy("l_suppkey").agg(F.sum(F.when(F.col("p_size") < 25, 1).otherwise(0)).alias("small"), F.sum(F.when(F.col("p_size") >= 25, 1).otherwise(0)).alias("large"))


@query(
    "cq26_cq28_support_gated_contrast",
    "WITH a AS (SELECT avg(l_tax) AS g FROM lineitem) SELECT l_linenumber, round(avg(l_tax) - max(g), 6) AS contrast, round(avg(abs(l_tax - g)) FILTER (WHERE l_discount = 0), 6) AS zero_error, round(avg(abs(l_tax - g)) FILTER (WHERE l_discount <> 0), 6) AS other_error FROM lineitem, a GROUP BY 1 HAVING count(*) >= 30",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    t = li.crossJoin(F.broadcast(li.agg(F.avg("l_tax").alias("g"))))
    err = F.abs(F.col("l_tax") - F.col("g"))
    out = t.groupBy("l_linenumber").agg(
        F.count("*").alias("n"),
        F.round(F.avg("l_tax") - F.max("g"), 6).alias("contrast"),
        F.round(F.avg(F.when(F.col("l_discount") == 0, err)), 6).alias("zero_error"),
        F.round(F.avg(F.when(F.col("l_discount") != 0, err)), 6).alias("other_error"),
    )
    return out.where("n >= 30").drop("n")


@query(
    "cq29_last_epochs_gap",
    """WITH t AS (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE event_type IN ('click', 'view')),
    m AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b FROM t WHERE r <= 10 GROUP BY 1) SELECT user_id, round(a - b, 6) AS gap FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    t = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).withColumn("r", F.row_number().over(w)).where("r <= 10")
    m = t.groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"))
    return m.where("a is not null and b is not null").select("user_id", F.round(F.col("a") - F.col("b"), 6).alias("gap"))


@query("cube_rollup_beyond", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
