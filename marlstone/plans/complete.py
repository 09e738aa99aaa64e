"""Second halves of operators whose first query covers one form only, and the readers and sinks as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import maths
from marlstone.operators import lookups, ordered, splits
from marlstone.plans.analysis import PIXELS, pixels
from marlstone.plans.registry import query
from marlstone.session import table
from marlstone.sources import readers, sinks


@query(
    "ag12_coverage_per_chromosome",
    f"""WITH p AS ({PIXELS}), c AS (SELECT i AS b, n FROM p UNION ALL SELECT j, n FROM p WHERE i <> j), t AS (SELECT b, b // 10 AS chrom, CAST(sum(n) AS BIGINT) AS coverage FROM c GROUP BY 1),
    q AS (SELECT chrom, quantile_cont(coverage, 0.25) AS q FROM t GROUP BY 1) SELECT b AS bin, coverage, coverage >= q AS valid FROM t JOIN q USING (chrom)""",
)
def _(spark, sf_dir):
    p = pixels(spark, sf_dir)
    c = p.select(F.col("i").alias("bin"), "n").unionByName(p.where("i <> j").select(F.col("j").alias("bin"), "n")).groupBy("bin").agg(F.sum("n").alias("coverage"))
    c = c.withColumn("chrom", F.expr("bin DIV 10"))
    q = ordered.quantiles(c, "coverage", [0.25], ("chrom",)).select("chrom", F.col("quantiles")[0].alias("q"))
    return c.join(q, "chrom").select("bin", "coverage", (F.col("coverage") >= F.col("q")).alias("valid"))


@query(
    "ag13_trans_expected",
    f"WITH p AS (SELECT * FROM ({PIXELS}) WHERE i < 25 AND j >= 25), x AS (SELECT sum(n) / (25 * 25) AS expected FROM p) SELECT i, j, round(n / expected, 6) AS oe FROM p, x",
)
def _(spark, sf_dir):
    p = pixels(spark, sf_dir).where("i < 25 and j >= 25")  # the two halves of the bins are two chromosomes
    return p.crossJoin(F.broadcast(p.agg((F.sum("n") / (25 * 25)).alias("expected")))).select("i", "j", F.round(F.col("n") / F.col("expected"), 6).alias("oe"))


@query(
    "ag14_text_windows",
    """WITH w AS (SELECT doc_id, k, substr(text, CAST(k * 100 + 1 AS BIGINT), 100) AS s FROM documents, range(0, 100000) r(k) WHERE k * 100 < length(text))
    SELECT doc_id, k AS win, (length(s) - length(replace(s, 'th', ''))) // 2 AS pairs, length(s) - length(replace(s, 'e', '')) AS letters, length(s) AS n FROM w""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.expr("(length(text) - 1) DIV 100").cast("int"))).alias("k", "at"))
    w = d.select("doc_id", F.col("k").cast("long").alias("win"), F.substring(F.col("text"), F.col("k") * 100 + 1, F.lit(100)).alias("s"))
    less = lambda x: F.length("s") - F.length(F.replace(F.col("s"), F.lit(x), F.lit("")))
    return w.select("doc_id", "win", (less("th") / 2).cast("long").alias("pairs"), less("e").cast("long").alias("letters"), F.length("s").cast("long").alias("n"))


@query(
    "ag16_across_seeds",
    """WITH s AS (SELECT l_linenumber AS seed, round(avg(l_tax) FILTER (WHERE l_returnflag = 'A') - avg(l_tax) FILTER (WHERE l_returnflag = 'R'), 9) AS d FROM lineitem GROUP BY 1)
    SELECT count(d) AS seeds, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, round(min(d), 6) AS lo, round(max(d), 6) AS hi, count(*) FILTER (WHERE d > 0) AS positive, count(*) FILTER (WHERE d < 0) AS negative FROM s""",
)
def _(spark, sf_dir):
    side = lambda f: F.avg(F.when(F.col("l_returnflag") == f, F.col("l_tax")))
    d = F.col("d")
    s = table(spark, sf_dir, "lineitem").groupBy("l_linenumber").agg(F.round(side("A") - side("R"), 9).alias("d"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return s.agg(F.count(d).alias("seeds"), r(F.avg(d), "mean"), r(F.stddev_samp(d), "sd"), r(F.min(d), "lo"), r(F.max(d), "hi"), F.count_if(d > 0).alias("positive"), F.count_if(d < 0).alias("negative"))


@query(
    "ag18_progressive_universe",
    """WITH h AS (SELECT c_custkey AS k, count(*) FILTER (WHERE o_orderstatus = 'F') > 0 AS f, count(*) FILTER (WHERE o_orderstatus = 'O') > 0 AS o, count(*) FILTER (WHERE o_orderstatus = 'P') > 0 AS p FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
    SELECT 'F' AS representation, round(avg(CASE WHEN f THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) FILTER (WHERE f) AS common FROM h UNION ALL
    SELECT 'O', round(avg(CASE WHEN o THEN 1.0 ELSE 0.0 END), 6), count(*) FILTER (WHERE f AND o) FROM h UNION ALL SELECT 'P', round(avg(CASE WHEN p THEN 1.0 ELSE 0.0 END), 6), count(*) FILTER (WHERE f AND o AND p) FROM h""",
)
def _(spark, sf_dir):
    order = ("F", "O", "P")
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderstatus").alias("has"))  # at most a handful of kinds
    h = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select(F.coalesce("has", F.array().cast("array<string>")).alias("has"))
    all_of = lambda k: F.size(F.array_except(F.array(*map(F.lit, order[: k + 1])), F.col("has"))) == 0
    s = h.agg(F.count("*").alias("n"), *(F.count_if(F.array_contains("has", r)).alias(f"own{k}") for k, r in enumerate(order)), *(F.count_if(all_of(k)).alias(f"all{k}") for k in range(3)))
    rows = F.array(*(F.struct(F.lit(r).alias("representation"), F.round(F.col(f"own{k}") / F.col("n"), 6).alias("coverage"), F.col(f"all{k}").alias("common")) for k, r in enumerate(order)))
    return s.select(F.inline(rows))


@query(
    "ag21_weighted_fit",
    """WITH w AS (SELECT l_discount AS y, l_tax AS p, 1.0 / count(*) OVER (PARTITION BY l_returnflag) AS w FROM lineitem), m AS (SELECT sum(w * y) / sum(w) AS my, sum(w * p) / sum(w) AS mp FROM w)
    SELECT round(sum(w * (y - my) * (p - mp)) / sqrt(sum(w * pow(y - my, 2)) * sum(w * pow(p - mp, 2))), 6) AS pearson, round(1 - sum(w * pow(y - p, 2)) / sum(w * pow(y - my, 2)), 6) AS r2 FROM w, m""",
)
def _(spark, sf_dir):
    y, p = F.col("l_discount"), F.col("l_tax")
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*(F.avg(c).alias(n) for n, c in (("y", y), ("p", p), ("yy", y * y), ("pp", p * p), ("yp", y * p))))
    t = s.agg(*(F.avg(c).alias(c) for c in ("y", "p", "yy", "pp", "yp")))  # each stratum weighs the same
    f = F.col
    vy = f("yy") - f("y") * f("y")
    r = (f("yp") - f("y") * f("p")) / F.sqrt(vy * (f("pp") - f("p") * f("p")))
    return t.select(F.round(r, 6).alias("pearson"), F.round(1 - (f("yy") - 2 * f("yp") + f("pp")) / vy, 6).alias("r2"))


@query(
    "sp8_terciles",
    "WITH q AS (SELECT quantile_cont(p_retailprice, 1 / 3.0) AS a, quantile_cont(p_retailprice, 2 / 3.0) AS b FROM part) SELECT p_partkey, CAST(p_retailprice > a AS INTEGER) + CAST(p_retailprice > b AS INTEGER) AS tercile FROM part, q",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    q = ordered.quantiles(p, "p_retailprice", [1 / 3, 2 / 3])
    return p.crossJoin(F.broadcast(q)).select("p_partkey", ((F.col("p_retailprice") > F.col("quantiles")[0]).cast("int") + (F.col("p_retailprice") > F.col("quantiles")[1]).cast("int")).alias("tercile"))


@query(
    "sp15_capped_pools",
    """WITH k AS (SELECT DISTINCT l_suppkey % 90 AS a, l_partkey % 90 AS b FROM lineitem WHERE l_discount > 0.09), g AS (SELECT x.v AS a, y.v AS b FROM range(90) x(v), range(90) y(v) WHERE y.v > x.v),
    c AS (SELECT b - a AS d, greatest(10 * count(*), 20) AS cap FROM k WHERE b > a GROUP BY 1)
    SELECT g.a, g.b, g.b - g.a AS distance FROM g ANTI JOIN k ON k.a = g.a AND k.b = g.b LEFT JOIN c ON c.d = g.b - g.a QUALIFY row_number() OVER (PARTITION BY g.b - g.a ORDER BY sha256(CAST(g.a AS STRING) || ':' || CAST(g.b AS STRING) || ':17')) <= coalesce(cap, 20)""",
)
def _(spark, sf_dir):
    # the rule is max(multiple x contacts, least); the pools are generated pairs of bins, a few thousand
    seen = table(spark, sf_dir, "lineitem").where("l_discount > 0.09").select((F.col("l_suppkey") % 90).alias("a"), (F.col("l_partkey") % 90).alias("b")).distinct()
    caps = seen.where("b > a").groupBy((F.col("b") - F.col("a")).alias("distance")).agg(F.greatest(10 * F.count("*"), F.lit(20)).alias("cap"))
    grid = spark.range(90).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"))).alias("b")).where("b > a")
    free = grid.join(seen, ["a", "b"], "left_anti").withColumn("distance", F.col("b") - F.col("a")).join(caps, "distance", "left")
    w = Window.partitionBy("distance").orderBy(lookups.hash_rank("a", "b", seed=17))
    return free.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.coalesce("cap", F.lit(20))).select("a", "b", "distance")


U = "CAST(('0x' || substr(sha256(CAST(vec_id AS STRING) || ':' || CAST(k AS STRING) || ':31'), {at}, 8)) AS BIGINT)"


@query(
    "sp16_random_vectors",
    f"SELECT vec_id, CAST(k AS INTEGER) AS k, round(sqrt(-2 * ln(({U.format(at=1)} + 0.5) / 4294967296)) * cos(2 * pi() * {U.format(at=9)} / 4294967296), 6) AS normal, 0.5::DOUBLE AS constant FROM embeddings, range(4) r(k)",
)
def _(spark, sf_dir):
    """Control vectors of four standard normals, stable by id and place, and constant ones."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    h = lookups.hash_rank("vec_id", "k", seed=31)
    u = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("double")
    normal = F.sqrt(-2 * F.log((u(1) + 0.5) / 4294967296.0)) * F.cos(2 * F.pi() * u(9) / 4294967296.0)
    return e.select("vec_id", "k", F.round(normal, 6).alias("normal"), F.lit(0.5).alias("constant"))


@query(
    "sp18_plain_and_group_folds",
    """WITH r AS (SELECT c_custkey, c_nationkey, (row_number() OVER (ORDER BY sha256(CAST(c_custkey AS STRING) || ':19')) - 1) % 5 AS fold FROM customer),
    g AS (SELECT c_nationkey, (row_number() OVER (ORDER BY n DESC, c_nationkey) - 1) AS k FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1))
    SELECT c_custkey, CAST(fold AS INTEGER) AS fold, CAST(CASE WHEN (k // 5) % 2 = 0 THEN k % 5 ELSE 4 - k % 5 END AS INTEGER) AS group_fold FROM r JOIN g USING (c_nationkey)""",
)
def _(spark, sf_dir):
    """KFold in hash order; GroupKFold deals whole groups, largest first, to and fro over the folds."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    plain = splits.block_folds(c.select("c_custkey"), "c_custkey", 5, seed=19)
    g = c.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "c_nationkey")) - 1  # a row a group
    g = g.withColumn("k", k).select("c_nationkey", F.when(F.expr("(k DIV 5) % 2 = 0"), F.col("k") % 5).otherwise(4 - F.col("k") % 5).cast("int").alias("group_fold"))
    return c.join(g, "c_nationkey").join(plain, "c_custkey").select("c_custkey", "fold", "group_fold")


@query(
    "me11_random_pairing",
    """WITH r AS (SELECT p_partkey, p_retailprice AS v, row_number() OVER (ORDER BY sha256(CAST(p_partkey AS STRING) || ':23')) AS k FROM part),
    a AS (SELECT avg(abs(x.v - y.v)) AS near FROM r x JOIN r y ON y.p_partkey = x.p_partkey + 1), b AS (SELECT avg(abs(x.v - y.v)) AS random FROM r x JOIN r y ON y.k = x.k + 1)
    SELECT round(near, 4) AS near, round(random, 4) AS random, round(random / nullif(near, 0), 5) AS enrichment FROM a, b""",
)
def _(spark, sf_dir):
    p = splits.hash_positions(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("v")), "p_partkey", seed=23).select("p_partkey", "v", F.col("_rn").alias("k"))

    def gap(key, name):
        after = p.select((F.col(key) - 1).alias(key), F.col("v").alias("w"))
        return p.join(after, key).agg(F.avg(F.abs(F.col("v") - F.col("w"))).alias(name))

    both = gap("p_partkey", "near").crossJoin(F.broadcast(gap("k", "random")))  # one row each
    return both.select(F.round("near", 4).alias("near"), F.round("random", 4).alias("random"), F.round(F.col("random") / F.nullif(F.col("near"), F.lit(0.0)), 5).alias("enrichment"))


@query(
    "me22_pairing_identity",
    """WITH a AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R')
    SELECT count(*) AS ids, count(*) FILTER (WHERE r.l_suppkey IS NULL) AS only_a, count(*) FILTER (WHERE a.l_suppkey IS NULL) AS only_r FROM a FULL JOIN r ON a.l_suppkey = r.l_suppkey AND a.l_linenumber = r.l_linenumber""",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R"))
    # ids of either arm, each with the arms that have it
    arms = li.groupBy("l_suppkey", "l_linenumber").agg(F.bool_or(F.col("l_returnflag") == "A").alias("a"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    return arms.agg(F.count("*").alias("ids"), F.count_if(~F.col("r")).alias("only_a"), F.count_if(~F.col("a")).alias("only_r"))


@query("wn19_first_of_permutation", "WITH r AS (SELECT vec_id, row_number() OVER (ORDER BY sha256(CAST(vec_id AS STRING) || ':29')) AS place FROM embeddings) SELECT place, vec_id FROM r WHERE place <= 25")
def _(spark, sf_dir):
    r = splits.hash_positions(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", seed=29)
    return r.where("_rn < 25").select((F.col("_rn") + 1).cast("long").alias("place"), "vec_id")  # the first n of the order are the operator


@query(
    "ma11_detrended_noise",
    """WITH t AS (SELECT user_id, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events), k AS (SELECT user_id, y, -r::DOUBLE AS x FROM t WHERE r <= 10)
    SELECT user_id, round(sqrt(greatest(var_pop(y) - pow(covar_pop(x, y), 2) / nullif(var_pop(x), 0), 0)), 5) AS noise FROM k WHERE y IS NOT NULL GROUP BY 1""",
)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    k = table(spark, sf_dir, "events").withColumn("r", F.row_number().over(w)).where("r <= 10 and value is not null").select("user_id", F.col("value").alias("y"), (-F.col("r")).cast("double").alias("x"))
    left = F.var_pop("y") - F.pow(F.covar_pop("x", "y"), 2) / F.nullif(F.var_pop("x"), F.lit(0.0))
    # greatest() passes nulls over in both engines: one point has no trend and no noise
    return k.groupBy("user_id").agg(F.round(F.sqrt(F.greatest(left, F.lit(0.0))), 5).alias("noise"))


@query(
    "ar4_weighted_cosine",
    """WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey % 200 AS p FROM lineitem), w AS (SELECT p, 1.0 / count(*) AS w FROM s GROUP BY 1), n AS (SELECT s, sqrt(sum(w * w)) AS n FROM s JOIN w USING (p) GROUP BY 1),
    c AS (SELECT a.s AS a, b.s AS b, sum(w * w) AS c FROM s a JOIN s b ON b.s = a.s + 1 AND b.p = a.p JOIN w ON w.p = a.p GROUP BY 1, 2) SELECT a, b, round(c / (x.n * y.n), 6) AS cosine FROM c JOIN n x ON x.s = a JOIN n y ON y.s = b""",
)
def _(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 200).alias("p")).distinct()
    x = s.join(s.groupBy("p").agg((1 / F.count("*")).alias("w")), "p")
    n = x.groupBy("s").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("n"))
    c = x.select(F.col("s").alias("a"), "p", "w").join(s.select((F.col("s") - 1).alias("a"), "p"), ["a", "p"]).groupBy("a").agg(F.sum(F.col("w") * F.col("w")).alias("c"))
    both = c.join(n.select(F.col("s").alias("a"), F.col("n").alias("x")), "a").join(n.select((F.col("s") - 1).alias("a"), F.col("n").alias("y")), "a")
    return both.select("a", (F.col("a") + 1).alias("b"), F.round(F.col("c") / (F.col("x") * F.col("y")), 6).alias("cosine"))


@query(
    "jn31_unmapped_rows",
    "SELECT c_custkey, o.n IS NOT NULL AS mapped, coalesce(o.n, 0) AS orders FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").select("c_custkey", F.col("n").isNotNull().alias("mapped"), F.coalesce("n", F.lit(0)).alias("orders"))


@query(
    "pr8_interval_liftover",
    """WITH c AS (SELECT c_nationkey AS chrom, CAST(floor(c_acctbal) AS BIGINT) AS start, CAST(floor(c_acctbal) AS BIGINT) + 400 AS stop, c_custkey AS shift FROM customer),
    p AS (SELECT s_suppkey, s_nationkey AS chrom, CAST(floor(s_acctbal) AS BIGINT) AS a, CAST(floor(s_acctbal) AS BIGINT) + 1 + s_suppkey % 50 AS b FROM supplier),
    x AS (SELECT s_suppkey, count(shift) AS n, max(p.a + shift) AS lifted FROM p LEFT JOIN c ON c.chrom = p.chrom AND p.a BETWEEN c.start AND c.stop GROUP BY 1),
    y AS (SELECT s_suppkey, count(shift) AS n, max(p.b + shift) AS lifted FROM p LEFT JOIN c ON c.chrom = p.chrom AND p.b BETWEEN c.start AND c.stop GROUP BY 1)
    SELECT p.s_suppkey, CASE WHEN x.n = 0 OR y.n = 0 THEN 'unmapped' WHEN x.n > 1 OR y.n > 1 THEN 'ambiguous' WHEN y.lifted <= x.lifted OR y.lifted - x.lifted > 2 * (p.b - p.a) THEN 'size' ELSE 'ok' END AS status
    FROM p JOIN x USING (s_suppkey) JOIN y USING (s_suppkey)""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("chrom"), F.floor("c_acctbal").cast("long").alias("start"), (F.floor("c_acctbal") + 400).cast("long").alias("stop"), F.col("c_custkey").alias("shift"))
    at = F.floor("s_acctbal").cast("long")
    p = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("chrom"), at.alias("a"), (at + 1 + F.col("s_suppkey") % 50).alias("b"))

    def lifted(end):
        points = p.select("s_suppkey", "chrom", F.col(end).alias("start"), F.col(end).alias("stop"))
        hits = lookups.overlapping(points, c, 512, ("chrom",))
        return hits.groupBy("s_suppkey").agg(F.count("*").alias(f"n_{end}"), F.max(F.col("start") + F.col("r_shift")).alias(f"to_{end}"))

    t = p.join(lifted("a"), "s_suppkey", "left").join(lifted("b"), "s_suppkey", "left")
    size = (F.col("to_b") <= F.col("to_a")) | (F.col("to_b") - F.col("to_a") > 2 * (F.col("b") - F.col("a")))
    status = F.when(F.col("n_a").isNull() | F.col("n_b").isNull(), "unmapped").when((F.col("n_a") > 1) | (F.col("n_b") > 1), "ambiguous").when(size, "size").otherwise("ok")
    return t.select("s_suppkey", status.alias("status"))


# ---- readers and sinks -----------------------------------------------------------------------------------------


@query(
    "sc2_row_column_gather",
    "SELECT p_partkey AS locus, beta FROM (SELECT l_partkey AS locus, avg(l_discount * 10) AS beta FROM lineitem WHERE l_suppkey = 1 GROUP BY 1) b JOIN part ON p_partkey = locus WHERE p_size > 20",
)
def _(spark, sf_dir):
    from marlstone.plans.analysis import beta

    wanted = table(spark, sf_dir, "part").where("p_size > 20").select(F.col("p_partkey").alias("locus"))
    return readers.row_column_gather(beta(spark, sf_dir), 1, wanted)


@query(
    "sc7_sparse_and_dense",
    """WITH r AS (SELECT vec_id AS row, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT row, count(*) FILTER (WHERE v > 0) AS stored, round(sum(v) FILTER (WHERE v > 0), 5) AS sparse_sum, round(sum(v), 5) AS dense_sum, TRUE AS valid FROM r GROUP BY 1""",
)
def _(spark, sf_dir):
    """The positive entries of a vector are its sparse row, the vector its dense one."""
    e = table(spark, sf_dir, "embeddings")
    kept = F.filter(F.transform("embedding", lambda v, i: F.struct(i.alias("i"), v.cast("double").alias("v"))), lambda p: p["v"] > 0)
    f = e.select(F.col("vec_id").alias("row"), F.transform(kept, lambda p: p["i"]).alias("indices"), F.transform(kept, lambda p: p["v"]).alias("data"), F.col("embedding").alias("dense"))
    checked = readers.sparse_features(f, width=F.size("dense"))
    return checked.select("row", F.size("indices").cast("long").alias("stored"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 5).alias("sparse_sum"), F.round(F.aggregate("dense", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("dense_sum"), "valid")


@query("sc8_restricted_features", "SELECT vec_id, label FROM embeddings")
def _(spark, sf_dir):
    return readers.restricted(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "dense"), ("vec_id", "label"), refused=("dense",))


@query(
    "sk3_matrix_of_unique_loci",
    "SELECT l_linenumber AS chrom, l_suppkey AS sample, l_partkey AS locus, round(avg(l_discount), 9) AS beta, count(*) AS probes FROM lineitem GROUP BY 1, 2, 3",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), F.col("l_linenumber").alias("chrom"), F.col("l_partkey").alias("locus"), F.col("l_discount").alias("beta"))
    path = sinks.fresh_folder(spark)
    sinks.write_matrix(li, path)
    return spark.read.parquet(path).select("chrom", "sample", "locus", F.round("beta", 9).alias("beta"), "probes")


@query("sk8_markdown_table", "SELECT '| ' || l_returnflag || ' | ' || CAST(count(*) AS STRING) || ' |' AS line FROM lineitem GROUP BY l_returnflag UNION ALL SELECT '| l_returnflag | n |' UNION ALL SELECT '|-|-|'")
def _(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(x,) for x in sinks.markdown(t, most_rows=100).split("\n")], "line string")


@query("sk2_sk9_text_tables", "SELECT r_regionkey, r_name, 'csv' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'tsv' FROM region")
def _(spark, sf_dir):
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    out = None
    for kind, sep in (("csv", ","), ("tsv", "\t")):
        path = sinks.fresh_folder(spark)
        sinks.text_table(r, path, sep)
        back = spark.read.schema(r.schema).option("header", True).option("sep", sep).csv(path).withColumn("kind", F.lit(kind))
        out = back if out is None else out.unionByName(back)
    return out
