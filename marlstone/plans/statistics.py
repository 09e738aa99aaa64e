"""Queries of metrics, inference, estimators, neighbours, reports and composite analyses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import maths, vectors
from marlstone.operators import bootstrap, case_control, inference, linear, lookups, neighbours, ordered
from marlstone.plans.registry import query
from marlstone.session import table

ALPHAS = [0.1, 1.0, 10.0, 100.0]
RANKED = """SELECT {by} x, y, rank() OVER ({part} ORDER BY x) + (count(*) OVER (PARTITION BY {key} x) - 1) / 2 AS r FROM t"""


@query(
    "me1_auroc",
    """WITH t AS (SELECT n_chars AS x, quality = 1 AS y FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS r FROM t),
    s AS (SELECT sum(r) FILTER (WHERE y) AS sr, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r) SELECT round((sr - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM s""",
)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return ordered.auroc(t, "n_chars", F.col("quality") == 1).select(F.round("auroc", 6).alias("auroc"))


@query(
    "me2_weighted_auroc",
    """WITH g AS (SELECT l_extendedprice AS x, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS p, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS n FROM lineitem GROUP BY 1),
    c AS (SELECT p, n, sum(n) OVER (ORDER BY x) - n / 2 AS below FROM g) SELECT round(sum(p * below) / (sum(p) * sum(n)), 6) AS auroc FROM c""",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return ordered.auroc(li, "l_extendedprice", F.col("l_returnflag") == "R", weight=F.col("l_quantity")).select(F.round("auroc", 6).alias("auroc"))


@query(
    "me3_me9_auroc_by_bin",
    """WITH t AS (SELECT l_linenumber AS b, l_extendedprice AS x, l_returnflag = 'R' AS y FROM lineitem), r AS (SELECT b, y, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2 AS r FROM t),
    s AS (SELECT b, sum(r) FILTER (WHERE y) AS sr, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM r GROUP BY 1) SELECT b AS l_linenumber, round((sr - p * (p + 1) / 2) / (p * n), 6) AS auroc FROM s""",
)
def _(spark, sf_dir):
    a = ordered.auroc(table(spark, sf_dir, "lineitem"), "l_extendedprice", F.col("l_returnflag") == "R", by=("l_linenumber",))
    return a.select("l_linenumber", F.round("auroc", 6).alias("auroc"))


@query(
    "me4_average_precision",
    """WITH t AS (SELECT quality = 1 AS y, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM labels JOIN documents USING (doc_id)), c AS (SELECT y, k, sum(CASE WHEN y THEN 1 ELSE 0 END) OVER (ORDER BY k) AS hits FROM t)
    SELECT round(sum(CASE WHEN y THEN hits / k ELSE 0 END) / sum(CASE WHEN y THEN 1 ELSE 0 END), 6) AS average_precision FROM c""",
)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    # a total order by length (descending), then id, as one long key, so the running sums go through ranges
    keyed = t.select((-F.col("n_chars") * F.lit(1 << 32) + F.col("doc_id")).alias("k"), (F.col("quality") == 1).cast("int").alias("y")).withColumn("one", F.lit(1))
    c = ordered.running(keyed, "k", ["y", "one"])
    hit = F.when(F.col("y") == 1, (F.col("before_y") + 1) / (F.col("before_one") + 1))
    return c.agg(F.round(F.sum(hit) / F.sum("y"), 6).alias("average_precision"))


@query(
    "me5_threshold_metrics",
    """WITH t AS (SELECT toxic = 1 AS y, n_chars > 1500 AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn FROM t)
    SELECT round((n - fp - fn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c""",
)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    y, p = F.col("toxic") == 1, F.col("n_chars") > 1500
    c = t.agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    safe = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    n, tp, fp, fn = (F.col(x) for x in ("n", "tp", "fp", "fn"))
    return c.select(safe(n - fp - fn, n).alias("accuracy"), safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(
    "me6_regression_metrics",
    "SELECT l_linestatus, count(*) AS n, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) AS mae, round(covar_pop(l_extendedprice, l_quantity) / nullif(stddev_pop(l_extendedprice) * stddev_pop(l_quantity), 0), 6) AS pearson, round(1 - avg(pow(l_extendedprice - 1500 * l_quantity, 2)) / var_pop(l_extendedprice), 6) AS r2 FROM lineitem GROUP BY 1",
)
def _(spark, sf_dir):
    y, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(y - 1500 * q)), 4).alias("mae"), F.round(maths.safe_corr(y, q), 6).alias("pearson"), F.round(1 - F.avg(F.pow(y - 1500 * q, 2)) / F.var_pop(y), 6).alias("r2")
    )


@query(
    "me7_me8_pooled_spearman",
    """WITH t AS (SELECT c_mktsegment AS s, c_acctbal AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer), r AS (SELECT s, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS p, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS q, 1.0 / count(*) OVER (PARTITION BY s) AS w FROM t),
    m AS (SELECT sum(w * p) / sum(w) AS mp, sum(w * q) / sum(w) AS mq FROM r)
    SELECT round(sum(w * (p - mp) * (q - mq)) / sqrt(sum(w * pow(p - mp, 2)) * sum(w * pow(q - mq, 2))), 6) AS spearman FROM r, m""",
)
def _(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    r = ordered.mid_ranks(ordered.mid_ranks(t, "c_acctbal", "p"), "c_nationkey", "q")
    r = r.join(t.groupBy("c_mktsegment").agg((1 / F.count("*")).alias("w")), "c_mktsegment")
    p, q, w = F.col("p"), F.col("q"), F.col("w")
    s = r.agg(*(F.sum(e).alias(n) for n, e in (("w", w), ("p", w * p), ("q", w * q), ("pp", w * p * p), ("qq", w * q * q), ("pq", w * p * q))))
    c = lambda a, b, ab: F.col(ab) - F.col(a) * F.col(b) / F.col("w")
    return s.select(F.round(c("p", "q", "pq") / F.sqrt(c("p", "p", "pp") * c("q", "q", "qq")), 6).alias("spearman"))


@query(
    "me10_me11_neighbour_enrichment",
    """WITH e AS (SELECT vec_id, label, list_transform_norm.e FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) list_transform_norm),
    d AS (SELECT a.vec_id AS q, a.label AS l, b.vec_id AS n, b.label AS m, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC, n) <= 5), p AS (SELECT label, count(*) / (SELECT count(*) FROM e) AS share FROM e GROUP BY 1)
    SELECT l AS label, round(avg(CASE WHEN l = m THEN 1.0 ELSE 0.0 END), 6) AS observed, round(avg(CASE WHEN l = m THEN 1.0 ELSE 0.0 END) / max(share), 6) AS enrichment FROM k JOIN p ON p.label = k.l GROUP BY 1""",
)
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    near = neighbours.nearest_vectors(e, "vec_id", "embedding", 5)
    l = e.select(F.col("vec_id").alias("query"), "label")  # noqa: E741
    m = e.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("other"))
    share = e.groupBy("label").agg(F.count("*").alias("c")).crossJoin(F.broadcast(e.agg(F.count("*").alias("n")))).select("label", (F.col("c") / F.col("n")).alias("share"))
    k = near.join(l, "query").join(m, "neighbour").groupBy("label").agg(F.avg((F.col("label") == F.col("other")).cast("double")).alias("o"))
    return k.join(share, "label").select("label", F.round("o", 6).alias("observed"), F.round(F.col("o") / F.col("share"), 6).alias("enrichment"))


@query(
    "jn22_exact_neighbours",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, neighbour) AS rank FROM d) SELECT query, rank, neighbour, round(s, 6) AS similarity FROM r WHERE rank <= 3""",
)
def _(spark, sf_dir):
    return neighbours.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3).withColumn("similarity", F.round("similarity", 6))


@query(
    "jn23_euclidean_neighbours",
    """WITH d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS rank FROM d) SELECT query, rank, neighbour, round(d, 5) AS distance FROM r WHERE rank <= 3""",
)
def _(spark, sf_dir):
    n = neighbours.nearest_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 3, metric="euclidean")
    return n.select("query", "rank", "neighbour", F.round(-F.col("similarity"), 5).alias("distance"))


def customer_matching(spark, sf_dir):
    """(cases, pool, matches): customers of five nations with two others of their segment each, near in balance and nation number."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", F.col("c_acctbal").cast("double").alias("balance"))
    cases, pool = c.where("c_nationkey < 5"), c.where("c_nationkey >= 5")
    return cases, pool, case_control.match_controls(cases, pool, "c_custkey", ("c_mktsegment",), {"balance": 400.0, "c_nationkey": None}, n=2, seed=17)


@query("jn25_greedy_matching")
def _(spark, sf_dir):
    pairs = customer_matching(spark, sf_dir)[2].pairs
    return pairs.select(F.col("case").alias("case_id"), F.col("control").alias("control_id"), "rank", F.round("distance", 6).alias("distance"))


@query("jn25_unmatched_cases")
def _(spark, sf_dir):
    cases, _, m = customer_matching(spark, sf_dir)
    told = cases.select(F.col("c_custkey").alias("case")).join(m.unmatched, "case", "left").join(m.pairs.select("case").distinct().withColumn("matched", F.lit(True)), "case", "left")
    return told.groupBy(F.coalesce("reason", F.when(F.col("matched"), "matched")).alias("outcome")).agg(F.count("*").alias("cases"))


@query("cq33_matching_balance")
def _(spark, sf_dir):
    cases, pool, m = customer_matching(spark, sf_dir)
    b = case_control.balance(cases, pool, m.pairs, "c_custkey", ["balance", "c_nationkey"], ["c_mktsegment"])
    return b.select("covariate", "level", F.round("smd_before", 6).alias("smd_before"), F.round("smd_after", 6).alias("smd_after"))


@query("me12_me13_block_bootstrap")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    cells = li.groupBy(F.col("l_returnflag").alias("arm"), F.col("s_nationkey").alias("block")).agg(F.sum("l_discount").alias("total"), F.count("l_discount").alias("n"))
    reps = inference.block_bootstrap(cells, "arm", "block", "total", "n", 500, seed=17)
    return reps.groupBy("arm").agg(F.round(F.avg("mean"), 6).alias("mean"), F.round(F.percentile("mean", 0.025), 6).alias("lo"), F.round(F.percentile("mean", 0.975), 6).alias("hi"))


#: A number below n from the leading 48 bits of a sha256, as operators.bootstrap draws it.
DRAWN = "(('0x' || substr(sha256({text}), 1, 12))::BIGINT % {n})"


@query(
    "me13_rank_bootstrap",
    f"""WITH d AS (SELECT r, {DRAWN.format(text="'17:block:' || r || ':' || k", n=25)} AS b FROM range(200) a(r), range(25) c(k)), m AS (SELECT r, b, count(*) AS w FROM d GROUP BY ALL UNION ALL SELECT -1, b, 1 FROM range(25) t(b)),
    c AS (SELECT l_returnflag AS arm, s_nationkey AS b, l_discount AS x, l_tax AS y, count(*) FILTER (WHERE l_quantity > 25) AS p, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL),
    w AS (SELECT r, arm, x, y, sum(w * p) AS p, sum(w * n) AS n FROM c JOIN m USING (b) GROUP BY ALL),
    g AS (SELECT r, arm, x, sum(p) AS p, sum(n) - sum(p) AS q, sum(sum(n)) OVER (PARTITION BY r, arm ORDER BY x) - sum(n) / 2 AS u, sum(sum(n) - sum(p)) OVER (PARTITION BY r, arm ORDER BY x) - (sum(n) - sum(p)) / 2 AS below FROM w GROUP BY r, arm, x),
    h AS (SELECT r, arm, y, sum(sum(n)) OVER (PARTITION BY r, arm ORDER BY y) - sum(n) / 2 AS v FROM w GROUP BY r, arm, y),
    s AS (SELECT r, arm, sum(n) AS t, sum(n * u) / sum(n) AS mu, sum(n * v) / sum(n) AS mv, sum(n * u * v) / sum(n) AS uv, sum(n * u * u) / sum(n) AS uu, sum(n * v * v) / sum(n) AS vv FROM w JOIN g USING (r, arm, x) JOIN h USING (r, arm, y) GROUP BY r, arm),
    z AS (SELECT r, arm, 'auroc' AS statistic, sum(p * below) / nullif(sum(p) * sum(q), 0) AS z FROM g GROUP BY r, arm UNION ALL SELECT r, arm, 'spearman', (uv - mu * mv) / sqrt((uu - mu * mu) * (vv - mv * mv)) FROM s)
    SELECT arm, statistic, round(max(z) FILTER (WHERE r = -1), 5) AS value, round(quantile_cont(z, 0.025) FILTER (WHERE r >= 0), 5) AS lo, round(quantile_cont(z, 0.975) FILTER (WHERE r >= 0), 5) AS hi FROM z GROUP BY arm, statistic""",
)
def _(spark, sf_dir):
    """Shared draws of 25 blocks: both statistics of three arms under 200 draws from one ordering of each column."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("arm"), F.col("l_discount").cast("double").alias("x"), F.col("l_tax").cast("double").alias("y"), "l_quantity").join(s, "l_suppkey")
    draws, blocks = bootstrap.hash_draws(spark, 25, 200, 17), list(range(25))
    found = {"auroc": bootstrap.auroc_replicates(li, "arm", "x", F.col("l_quantity") > 25, "s_nationkey", blocks, draws), "spearman": bootstrap.spearman_replicates(li, "arm", "x", "y", "s_nationkey", blocks, draws)}
    rows = [(arm, name, round(v, 5), *(round(c, 5) for c in bootstrap.interval(reps))) for name, arms in found.items() for arm, (v, reps) in arms.items()]
    return spark.createDataFrame(rows, "arm string, statistic string, value double, lo double, hi double")


@query(
    "me14_crossed_bootstrap",
    f"""WITH l AS (SELECT l_suppkey % 50 AS patient, l_partkey AS item, l_linenumber AS block, avg(l_discount) AS target, avg(power(l_discount - 0.05, 2)) AS r, avg(power(l_discount - l_tax, 2)) AS a, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
    c AS (SELECT patient, block, sum(n * (a - r)) AS d, sum(n * r) AS base, sum(n) AS n, count(*) AS pairs FROM l GROUP BY 1, 2),
    pu AS (SELECT patient, row_number() OVER (ORDER BY sha256(patient || ':17')) - 1 AS u, count(*) OVER () AS k FROM (SELECT DISTINCT patient FROM c)), bu AS (SELECT block, row_number() OVER (ORDER BY sha256(block || ':17')) - 1 AS u, count(*) OVER () AS k FROM (SELECT DISTINCT block FROM c)),
    pw AS (SELECT r, {DRAWN.format(text="'17:unit:' || r || ':' || u", n="k")} AS u, count(*) AS wp FROM range(200) t(r), pu GROUP BY ALL), bw AS (SELECT r, {DRAWN.format(text="'17:block:' || r || ':' || u", n="k")} AS u, count(*) AS wb FROM range(200) t(r), bu GROUP BY ALL),
    e AS (SELECT pw.r, sum(wp * wb * d) / nullif(sum(wp * wb * n), 0) AS e, sum(wp * wb * d) / nullif(sum(wp * wb * base), 0) AS q FROM c JOIN pu USING (patient) JOIN bu USING (block) JOIN pw ON pw.u = pu.u JOIN bw ON bw.u = bu.u AND bw.r = pw.r GROUP BY 1),
    t AS (SELECT sum(d) / sum(n) AS point, sum(d) / sum(base) AS relative, sum(pairs) AS n_pairs, sum(n) AS n_observations FROM c)
    SELECT round(point, 6) AS delta_mse, round(relative, 6) AS relative_delta_mse, CAST(n_pairs AS BIGINT) AS n_pairs, CAST(n_observations AS BIGINT) AS n_observations, round(quantile_cont(e, 0.025), 6) AS ci_lo, round(quantile_cont(e, 0.975), 6) AS ci_hi,
    round(quantile_cont(q, 0.025), 6) AS relative_ci_lo, round(quantile_cont(q, 0.975), 6) AS relative_ci_hi, round((1 + count(*) FILTER (WHERE abs(e - point) >= abs(point))) / (1 + count(e)), 6) AS p,
    (SELECT count(*) FROM pu) AS n_units, (SELECT count(*) FROM bu) AS n_blocks FROM e, t GROUP BY point, relative, n_pairs, n_observations""",
)
def _(spark, sf_dir):
    """Panel evaluations of a cell are averaged, then two predictions are compared under crossed multinomial draws."""
    d, key = F.col("l_discount").cast("double"), ["patient", "item", "block"]
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("patient"), F.col("l_partkey").alias("item"), F.col("l_linenumber").alias("block"), d.alias("d"), F.col("l_tax").cast("double").alias("t"))
    arm = lambda prediction: li.groupBy(*key).agg(F.avg("d").alias("target"), F.avg(F.pow(F.col("d") - prediction, F.lit(2.0))).alias("squared_error"), F.count("*").alias("n"))
    out = bootstrap.paired_crossed(arm(F.lit(0.05)), arm(F.col("t")), *key, replicates=200, seed=17)
    return out.select(*(F.round(c, 6).alias(c) for c in ("delta_mse", "relative_delta_mse", "ci_lo", "ci_hi", "relative_ci_lo", "relative_ci_hi", "p")), *(F.col(c).cast("long").alias(c) for c in ("n_pairs", "n_observations", "n_units", "n_blocks")))


@query(
    "me17_me18_two_sided_p",
    """SELECT l_suppkey, round(least(1.0, 2 * least((1 + count(*) FILTER (WHERE l_discount - l_tax <= 0)) / (1 + count(*)), (1 + count(*) FILTER (WHERE l_discount - l_tax >= 0)) / (1 + count(*)))), 6) AS p,
    round(quantile_cont(l_discount - l_tax, 0.025), 6) AS lo, round(quantile_cont(l_discount - l_tax, 0.975), 6) AS hi FROM lineitem GROUP BY 1""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") - F.col("l_tax")).alias("d"))
    return d.groupBy("l_suppkey").agg(F.round(inference.two_sided_p("d"), 6).alias("p"), F.round(F.percentile("d", 0.025), 6).alias("lo"), F.round(F.percentile("d", 0.975), 6).alias("hi"))


P_SQL = "SELECT r_name AS family, n_name AS name, round((n_nationkey * 37 % 100 + 1) / 1000.0, 6) AS p FROM nation JOIN region ON r_regionkey = n_regionkey"


def p_values(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("family")), "n_regionkey")
    return n.select("family", F.col("n_name").alias("name"), F.round((F.col("n_nationkey") * 37 % 100 + 1) / 1000.0, 6).alias("p"))


@query(
    "me19_holm",
    f"WITH t AS ({P_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS rn, count(*) OVER (PARTITION BY family) AS m FROM t) SELECT family, name, round(least(max((m - rn + 1) * p) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING), 1), 6) AS p_holm FROM r",
)
def _(spark, sf_dir):
    return inference.holm(p_values(spark, sf_dir), "p", "name", ("family",)).select("family", "name", F.round("p_holm", 6).alias("p_holm"))


@query(
    "me20_benjamini_hochberg",
    f"WITH t AS ({P_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, name) AS rn, count(*) OVER (PARTITION BY family) AS m FROM t) SELECT family, name, round(least(min(p * m / rn) OVER (PARTITION BY family ORDER BY p, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 6) AS q FROM r",
)
def _(spark, sf_dir):
    return inference.benjamini_hochberg(p_values(spark, sf_dir), "p", "name", ("family",)).select("family", "name", F.round("q", 6).alias("q"))


@query("me21_me22_paired_contrast", "SELECT a.l_suppkey, round(a.m - b.m, 6) AS contrast, a.n = b.n AS same_n FROM (SELECT l_suppkey, avg(l_tax) AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) a JOIN (SELECT l_suppkey, avg(l_tax) AS m, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (l_suppkey)")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    arm = lambda f, s: li.where(F.col("l_returnflag") == f).groupBy("l_suppkey").agg(F.avg("l_tax").alias("m" + s), F.count("*").alias("n" + s))
    return arm("A", "1").join(arm("R", "2"), "l_suppkey").select("l_suppkey", F.round(F.col("m1") - F.col("m2"), 6).alias("contrast"), F.col("n1").eqNullSafe(F.col("n2")).alias("same_n"))


@query("me23_verdicts", "SELECT p_brand, CASE WHEN avg(p_size) > 27 AND count(*) >= 10 THEN 'PASS' WHEN avg(p_size) > 25 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM part GROUP BY 1")
def _(spark, sf_dir):
    m = F.avg("p_size")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.when((m > 27) & (F.count("*") >= 10), "PASS").when(m > 25, "PARTIAL").otherwise("FAIL").alias("verdict"))


@query("me24_alpha_edges", "SELECT p_brand, round(avg(CASE WHEN p_size = 50 THEN 1.0 ELSE 0.0 END), 6) AS at_edge FROM part GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg((F.col("p_size") == 50).cast("double")), 6).alias("at_edge"))


@query(
    "me26_bands",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.99) AS hi, quantile_cont(o_totalprice, 0.01) AS lo FROM orders) SELECT CASE WHEN o_totalprice >= hi THEN 'top' WHEN o_totalprice <= lo THEN 'bottom' ELSE 'middle' END AS band, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS share FROM orders, q GROUP BY 1",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_totalprice", "o_orderstatus")
    q = ordered.quantiles(o, "o_totalprice", [0.99, 0.01]).select(F.col("quantiles")[0].alias("hi"), F.col("quantiles")[1].alias("lo"))
    band = F.when(F.col("o_totalprice") >= F.col("hi"), "top").when(F.col("o_totalprice") <= F.col("lo"), "bottom").otherwise("middle")
    return o.crossJoin(F.broadcast(q)).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("share"))


@query(
    "me27_null_summary",
    """WITH r AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER (ORDER BY sha256(CAST(vec_id AS STRING) || ':17'), vec_id) AS k, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
    s AS (SELECT list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) AS s FROM r a JOIN r b ON a.i = b.k) SELECT round(avg(s), 6) AS mean, round(quantile_cont(s, 0.975), 6) AS null_hi FROM s""",
)
def _(spark, sf_dir):
    from marlstone.operators.splits import hash_positions

    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    order = ordered.running(e.select("vec_id").withColumn("one", F.lit(1)), "vec_id", ["one"]).select("vec_id", F.col("before_one").alias("i"))
    mixed = hash_positions(e, "vec_id", 17).select(F.col("_rn").alias("i"), F.col("embedding").alias("other"))
    s = e.join(order, "vec_id").join(mixed, "i").select(vectors.cosine(F.col("embedding"), F.col("other")).alias("s"))
    high = ordered.quantiles(s, "s", [0.975]).select(F.round(F.col("quantiles")[0], 6).alias("null_hi"))
    return s.agg(F.round(F.avg("s"), 6).alias("mean")).crossJoin(F.broadcast(high))  # a row each


# ---- estimators ------------------------------------------------------------------------------------------------


@query("ml1_blocked_ridge")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("fold", (F.col("vec_id") % 5).cast("int")).withColumn("y", F.col("label").cast("double"))
    b, _alphas = linear.blocked_ridge(e, "embedding", "y", "fold", ALPHAS)
    p = linear.out_of_fold(e, "embedding", "fold", b)
    return p.groupBy("fold").agg(F.count("*").alias("n"), F.round(maths.safe_corr(F.col("prediction"), F.col("y")), 4).alias("r"))


@query("ml2_blocked_logistic")
def _(spark, sf_dir):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 5).cast("int").alias("fold"), array_to_vector(F.col("embedding").cast("array<double>")).alias("x"), (F.col("label") % 2).cast("double").alias("y"))
    out = None
    for fold in range(5):
        train = e.where(F.col("fold") != fold)
        n = train.count()
        model = LogisticRegression(featuresCol="x", labelCol="y", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=50).fit(train)
        p = model.transform(e.where(F.col("fold") == fold)).select("vec_id", "fold", "y", vector_to_array("probability")[1].alias("p"))
        out = p if out is None else out.unionByName(p)
    return ordered.auroc(out, "p", F.col("y") == 1, by=("fold",)).select("fold", F.round("auroc", 4).alias("auroc"))


@query("ml6_ml9_principal_axes")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean, axes, values = linear.principal_axes(e, "embedding", 4)
    p = linear.project(e, "embedding", mean, axes)
    return p.select(F.posexplode("scores").alias("axis", "v")).groupBy("axis").agg(F.round(F.var_pop("v"), 6).alias("variance"), F.round(F.avg("v"), 6).alias("mean"))


@query("ar3_axes_removed")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mean, axes, _v = linear.principal_axes(e, "embedding", 1)
    u, m = F.array(*(F.lit(float(v)) for v in axes[0])), F.array(*(F.lit(float(v)) for v in mean))
    clean = e.select("vec_id", vectors.without_axis(vectors.minus(F.col("embedding"), m), u).alias("e"))
    other = clean.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("o"))
    return clean.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("e"), F.col("o")), 5).alias("cosine"))


# ---- reports, audits, composites -------------------------------------------------------------------------------


@query("ca2_arm_specs", "SELECT n_regionkey, 'only' AS kind, string_agg(n_name, ',' ORDER BY n_name) AS members FROM nation GROUP BY 1 UNION ALL SELECT r.n_regionkey, 'drop', string_agg(n.n_name, ',' ORDER BY n.n_name) FROM (SELECT DISTINCT n_regionkey FROM nation) r JOIN nation n ON n.n_regionkey <> r.n_regionkey GROUP BY 1")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = lambda c: F.array_join(F.array_sort(F.collect_list(c)), ",").alias("members")
    only = n.groupBy("n_regionkey").agg(names("n_name")).select("n_regionkey", F.lit("only").alias("kind"), "members")
    whole = n.agg(F.collect_list(F.struct("n_regionkey", "n_name")).alias("all"))  # the fixed list of nations
    drop = n.select("n_regionkey").distinct().crossJoin(F.broadcast(whole))
    drop = drop.select("n_regionkey", F.lit("drop").alias("kind"), F.array_join(F.array_sort(F.transform(F.filter("all", lambda x: x["n_regionkey"] != F.col("n_regionkey")), lambda x: x["n_name"])), ",").alias("members"))
    return only.unionByName(drop)


@query("ca9_flat_results", "SELECT l_returnflag AS arm, m.metric, round(m.value, 6) AS value FROM (SELECT l_returnflag, avg(l_discount) AS mean, min(l_discount) AS lo, max(l_discount) AS hi FROM lineitem GROUP BY 1) UNPIVOT (value FOR metric IN (mean, lo, hi)) m")
def _(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.avg("l_discount").alias("mean"), F.min("l_discount").alias("lo"), F.max("l_discount").alias("hi"))
    return r.unpivot("arm", ["mean", "lo", "hi"], "metric", "value").withColumn("value", F.round("value", 6))


@query(
    "cq7_consensus_z",
    """WITH s AS (SELECT l_returnflag AS line, avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS sd FROM lineitem GROUP BY 1), z AS (SELECT l_partkey, l_returnflag, avg((l_extendedprice - m) / sd) AS z FROM lineitem JOIN s ON s.line = l_returnflag GROUP BY 1, 2)
    SELECT l_partkey, count(*) AS n_lines, CASE WHEN count(*) >= 3 THEN round(avg(z), 6) END AS consensus FROM z GROUP BY 1""",
)
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s = li.groupBy("l_returnflag").agg(F.avg("l_extendedprice").alias("m"), F.stddev_pop("l_extendedprice").alias("sd"))
    z = li.join(s, "l_returnflag").groupBy("l_partkey", "l_returnflag").agg(F.avg((F.col("l_extendedprice") - F.col("m")) / F.col("sd")).alias("z"))
    return z.groupBy("l_partkey").agg(F.count("*").alias("n_lines"), F.when(F.count("*") >= 3, F.round(F.avg("z"), 6)).alias("consensus"))


@query("cq8_recurrence", "SELECT l_partkey, round(count(*) FILTER (WHERE l_returnflag = 'R') / nullif(count(*) FILTER (WHERE l_returnflag <> 'N'), 0), 6) AS fraction, count(*) FILTER (WHERE l_returnflag = 'R') > 0 AS any_flag FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.count_if(f == "R") / F.nullif(F.count_if(f != "N"), F.lit(0)), 6).alias("fraction"), (F.count_if(f == "R") > 0).alias("any_flag"))


@query(
    "cq10_overlapping_cells",
    """SELECT cell, count(*) AS n, round(avg(l_discount), 6) AS mean FROM (SELECT l_discount, 'large' AS cell FROM lineitem WHERE l_quantity > 40 UNION ALL SELECT l_discount, 'returned' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_discount, 'first' FROM lineitem WHERE l_linenumber = 1) GROUP BY 1""",
)
def _(spark, sf_dir):
    cells = F.array_compact(F.array(F.when(F.col("l_quantity") > 40, "large"), F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_linenumber") == 1, "first")))
    return table(spark, sf_dir, "lineitem").select("l_discount", F.explode(cells).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean"))


@query(
    "cq12_split_half_reliability",
    """WITH h AS (SELECT l_partkey, CAST(('0x' || substr(sha256(CAST(l_suppkey AS STRING) || ':5'), 1, 8)) AS BIGINT) % 2 AS half, avg(l_extendedprice / l_quantity) AS m FROM lineitem GROUP BY 1, 2),
    p AS (SELECT max(m) FILTER (WHERE half = 0) AS a, max(m) FILTER (WHERE half = 1) AS b FROM h GROUP BY l_partkey), r AS (SELECT covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0) AS r FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
    SELECT round(r, 6) AS r, round(2 * r / nullif(1 + r, 0), 6) AS reliability FROM r""",
)
def _(spark, sf_dir):
    half = F.conv(F.substring(lookups.hash_rank("l_suppkey", seed=5), 1, 8), 16, 10).cast("long") % 2
    h = table(spark, sf_dir, "lineitem").groupBy("l_partkey", half.alias("half")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("m"))
    p = h.groupBy("l_partkey").agg(F.max(F.when(F.col("half") == 0, F.col("m"))).alias("a"), F.max(F.when(F.col("half") == 1, F.col("m"))).alias("b")).where("a is not null and b is not null")
    return p.agg(maths.safe_corr(F.col("a"), F.col("b")).alias("r")).select(F.round("r", 6).alias("r"), F.round(maths.spearman_brown(F.col("r")), 6).alias("reliability"))


@query("cq13_profile_semantics", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance, round(max(x) - min(x), 6) AS range, count(x) AS n FROM x GROUP BY 1")
def _(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("vec_id").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.var_pop("x"), 6).alias("variance"), F.round(F.max("x") - F.min("x"), 6).alias("range"), F.count("x").alias("n"))


@query(
    "cq18_structural_audit",
    "SELECT source, count(*) AS n, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (WHERE text IS NULL) AS missing, count(*) FILTER (WHERE length(text) <> n_chars) AS wrong_length FROM documents GROUP BY 1",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(
        F.count("*").alias("n"), (F.count("*") - F.countDistinct("doc_id")).alias("repeated"), F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(F.length("text") != F.col("n_chars")).alias("wrong_length")
    )


@query(
    "cq19_cq20_cq21_snapshot_diff",
    """WITH a AS (SELECT p_partkey AS k, p_size AS v FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS v FROM part WHERE p_partkey % 11 <> 0)
    SELECT CASE WHEN b.k IS NULL THEN 'removed' WHEN a.k IS NULL THEN 'added' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' ELSE 'same' END AS state, count(*) AS n, max(abs(a.v - b.v)) AS max_diff FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    a = p.where("k % 10 <> 0").withColumn("in_a", F.lit(True))
    b = p.where("k % 11 <> 0").select("k", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")).alias("w"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "removed").when(F.col("in_a").isNull(), "added").when(~F.col("v").eqNullSafe(F.col("w")), "changed").otherwise("same")
    return a.join(b, "k", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.max(F.abs(F.col("v") - F.col("w"))).alias("max_diff"))


@query("cq23_global_ordinal", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS ordinal FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    before = ordered.running(e.groupBy("t").agg(F.count("*").alias("n")), "t", ["n"]).select("t", "before_n")
    w = Window.partitionBy("t").orderBy("event_id")
    return e.join(before, "t").select("event_id", (F.col("before_n") + F.row_number().over(w) - 1).alias("ordinal"))


@query("cq27_trait_sets", "SELECT DISTINCT p_type AS trait, l_suppkey AS probe FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_type LIKE 'PROMO%' AND l_discount >= 0.09")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").where(F.col("p_type").startswith("PROMO")).select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("trait"))
    return table(spark, sf_dir, "lineitem").where("l_discount >= 0.09").join(p, "l_partkey").select("trait", F.col("l_suppkey").alias("probe")).distinct()


@query("cq32_count_audit", "SELECT r_name, count(n_nationkey) AS n, count(n_nationkey) = 5 AS as_expected FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def _(spark, sf_dir):
    n = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.count("*").alias("n"))
    r = table(spark, sf_dir, "region").join(n, "r_regionkey", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return r.select("r_name", "n", (F.col("n") == 5).alias("as_expected"))


@query(
    "cq34_wins_per_block",
    """WITH m AS (SELECT l_suppkey % 22 AS chrom, avg(abs(l_discount - 0.05)) AS a, avg(abs(l_tax - 0.04)) AS b FROM lineitem GROUP BY 1) SELECT count(*) FILTER (WHERE a < b) AS wins, count(*) AS blocks, round(avg(b - a), 6) AS gain FROM m""",
)
def _(spark, sf_dir):
    m = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 22).alias("chrom")).agg(F.avg(F.abs(F.col("l_discount") - 0.05)).alias("a"), F.avg(F.abs(F.col("l_tax") - 0.04)).alias("b"))
    return m.agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count("*").alias("blocks"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("gain"))


@query(
    "streaming_windowed_moments",
    "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(value) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2",
)
def _(spark, sf_dir):
    from marlstone.streaming.moments import windowed_moments

    m = windowed_moments(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return m.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))
