"""Composite analyses: endpoints over representations, their contrasts, target variants, covariates and balance."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import maths, vectors
from marlstone.operators import lookups, neighbours, ordered
from marlstone.plans.registry import query
from marlstone.session import table

COSINE = "list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e)))"
#: Pairs of a vector and one of the four after it; vectors of one label are in contact.
PAIRS = f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    p AS (SELECT a.vec_id AS i, r.d, a.label = b.label AS contact, round({COSINE}, 9) AS x, a.e AS ea, b.e AS eb FROM e a, range(1, 5) r(d), e b WHERE b.vec_id = a.vec_id + r.d)"""


def pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    a = e.select(F.col("vec_id").alias("i"), F.col("label").alias("la"), F.col("embedding").alias("ea"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(4).cast("long"))).alias("d"))
    b = e.select(F.col("vec_id").alias("j"), F.col("label").alias("lb"), F.col("embedding").alias("eb"))
    p = a.withColumn("j", F.col("i") + F.col("d")).join(b, "j")
    return p.select("i", "d", (F.col("la") == F.col("lb")).alias("contact"), F.round(vectors.cosine(F.col("ea"), F.col("eb")), 9).alias("x"), "ea", "eb")


#: AUROC of x for contact by k, from average ranks.
AUROC = """r AS (SELECT k, contact, rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2 AS rk FROM t),
    u AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE contact) AS n1, count(*) FILTER (WHERE NOT contact) AS n0, sum(rk) FILTER (WHERE contact) AS s FROM r GROUP BY 1)"""


@query(
    "cq3_contact_auroc",
    f"""WITH {PAIRS}, t AS (SELECT d AS k, contact, x FROM p UNION ALL SELECT 0, contact, x FROM p), {AUROC}
    SELECT k AS distance, n, round((s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 6) AS auroc FROM u""",
)
def _(spark, sf_dir):
    p = pairs(spark, sf_dir).select("contact", "x", F.explode(F.array(F.lit(0).cast("long"), "d")).alias("distance"))
    score = ordered.auroc(p, "x", F.col("contact"), ("distance",))
    return p.groupBy("distance").agg(F.count("*").alias("n")).join(score, "distance").select("distance", "n", F.round("auroc", 6).alias("auroc"))


@query(
    "cq3_paired_delta",
    f"""WITH {PAIRS}, m AS (SELECT i, avg(x) FILTER (WHERE contact) - avg(x) FILTER (WHERE NOT contact) AS delta FROM p GROUP BY 1)
    SELECT count(delta) AS n, round(avg(delta), 6) AS delta, count(*) FILTER (WHERE delta > 0) AS positive FROM m""",
)
def _(spark, sf_dir):
    x, c = F.col("x"), F.col("contact")
    m = pairs(spark, sf_dir).groupBy("i").agg((F.avg(F.when(c, x)) - F.avg(F.when(~c, x))).alias("delta"))
    return m.agg(F.count("delta").alias("n"), F.round(F.avg("delta"), 6).alias("delta"), F.count_if(F.col("delta") > 0).alias("positive"))


#: Markers of parts by return flag: the strict set (small discounts) before the wide one, ids of several flags left out.
MARKERS = """k AS (SELECT l_partkey AS id, l_returnflag AS flag, l_discount <= 0.02 AS strict FROM lineitem),
    m1 AS (SELECT id, min(flag) AS marker FROM k WHERE strict GROUP BY 1 HAVING count(DISTINCT flag) = 1), m2 AS (SELECT id, min(flag) AS marker FROM k GROUP BY 1 HAVING count(DISTINCT flag) = 1),
    m AS (SELECT id, marker FROM m1 UNION ALL SELECT id, marker FROM m2 WHERE id NOT IN (SELECT id FROM m1))"""


def markers(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("marker"), "l_discount")
    one, two = lookups.unambiguous(k.where("l_discount <= 0.02"), "id", "marker"), lookups.unambiguous(k, "id", "marker")
    return one.unionByName(two.join(one, "id", "left_anti"))


@query("cq2_marker_sets", f"WITH {MARKERS} SELECT id, marker FROM m")
def _(spark, sf_dir):
    return markers(spark, sf_dir)


@query(
    "cq2_marker_enrichment",
    f"""WITH {MARKERS}, e AS (SELECT vec_id, marker, embedding::DOUBLE[] AS e FROM embeddings JOIN m ON id = vec_id),
    d AS (SELECT a.vec_id AS q, a.marker AS s, b.marker AS t, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id),
    o AS (SELECT s, avg(CASE WHEN s = t THEN 1.0 ELSE 0.0 END) AS observed FROM d WHERE rank <= 5 GROUP BY 1), c AS (SELECT marker AS s, (count(*) - 1) / nullif(sum(count(*)) OVER () - 1, 0) AS expected, count(*) AS n FROM e GROUP BY 1)
    SELECT s AS marker, n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(observed / nullif(expected, 0), 6) AS enrichment FROM o JOIN c USING (s)""",
)
def _(spark, sf_dir):
    m = markers(spark, sf_dir).select(F.col("id").alias("vec_id"), "marker")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(m, "vec_id")
    near = neighbours.nearest_vectors(e, "vec_id", "embedding", 5)
    near = near.join(m.withColumnRenamed("vec_id", "query"), "query").join(m.select(F.col("vec_id").alias("neighbour"), F.col("marker").alias("other")), "neighbour")
    o = near.groupBy("marker").agg(F.avg((F.col("marker") == F.col("other")).cast("double")).alias("observed"))
    c = e.groupBy("marker").agg(F.count("*").alias("n"))
    c = c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total")))).withColumn("expected", (F.col("n") - 1) / F.nullif(F.col("total") - 1, F.lit(0)))
    ratio = F.col("observed") / F.nullif(F.col("expected"), F.lit(0.0))
    return o.join(c, "marker").select("marker", "n", F.round("observed", 6).alias("observed"), F.round("expected", 6).alias("expected"), F.round(ratio, 6).alias("enrichment"))


@query(
    "cq6_activity_similarity",
    """WITH e AS (SELECT vec_id, label, list_slice(embedding::DOUBLE[], 1, len(embedding) // 2) AS e, list_slice(embedding::DOUBLE[], len(embedding) // 2 + 1, 2 * (len(embedding) // 2)) AS f FROM embeddings),
    s AS (SELECT *, len(f) AS n, list_sum(f) AS sf, list_inner_product(f, f) AS sff FROM e),
    p AS (SELECT round(list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))), 9) AS x,
      round((list_inner_product(a.f, b.f) - a.sf * b.sf / a.n) / sqrt((a.sff - a.sf * a.sf / a.n) * (b.sff - b.sf * b.sf / b.n)), 9) AS pattern,
      round(-abs(a.sf - b.sf) / a.n, 9) AS level, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END AS category FROM s a JOIN s b ON b.vec_id = a.vec_id + 1),
    t AS (SELECT 'pattern' AS target, x, pattern AS y FROM p UNION ALL SELECT 'level', x, level FROM p UNION ALL SELECT 'category', x, category FROM p),
    r AS (SELECT target, rank() OVER (PARTITION BY target ORDER BY x) + (count(*) OVER (PARTITION BY target, x) - 1) / 2 AS p, rank() OVER (PARTITION BY target ORDER BY y) + (count(*) OVER (PARTITION BY target, y) - 1) / 2 AS q FROM t)
    SELECT target, count(*) AS n, round(covar_pop(p, q) / nullif(stddev_pop(p) * stddev_pop(q), 0), 5) AS spearman FROM r GROUP BY 1""",
)
def _(spark, sf_dir):
    half = F.expr("CAST(size(embedding) DIV 2 AS INT)")
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.slice("embedding", F.lit(1), half).alias("e"), F.slice("embedding", half + 1, half).alias("f"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("lb"), F.col("e").alias("eb"), F.col("f").alias("fb"))
    level = -F.abs(vectors.total(F.col("f")) - vectors.total(F.col("fb"))) / F.size("f")
    p = e.join(b, "vec_id").select(
        F.round(vectors.cosine(F.col("e"), F.col("eb")), 9).alias("x"),
        F.explode(
            F.create_map(
                F.lit("pattern"), F.round(vectors.paired_pearson(F.col("f"), F.col("fb")), 9), F.lit("level"), F.round(level, 9), F.lit("category"), (F.col("label") == F.col("lb")).cast("double")
            )
        ).alias("target", "y"),
    )
    r = ordered.mid_ranks(ordered.mid_ranks(p, "x", "p", ("target",)), "y", "q", ("target",))
    return r.groupBy("target").agg(F.count("*").alias("n"), F.round(maths.safe_corr(F.col("p"), F.col("q")), 5).alias("spearman"))


#: Registered endpoints over pairs: name -> (DuckDB, Spark) value of a pair, null where the pair doesn't count; the family
#: of primaries is corrected together.
ENDPOINTS = {
    "cosine": ("x", lambda x, c: x),
    "contact_cosine": ("CASE WHEN contact THEN x END", lambda x, c: F.when(c, x)),
    "other_cosine": ("CASE WHEN NOT contact THEN x END", lambda x, c: F.when(~c, x)),
    "positive_share": ("CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END", lambda x, c: F.when(x > 0, 1.0).otherwise(0.0)),
    "absolute_cosine": ("abs(x)", lambda x, c: F.abs(x)),
    "squared_cosine": ("x * x", lambda x, c: x * x),
}
PRIMARY = ("cosine", "contact_cosine", "positive_share", "absolute_cosine")
#: Arms are the first and the second half of a vector.
ARMS = f"""e AS (SELECT vec_id, label, list_slice(embedding::DOUBLE[], 1, len(embedding) // 2) AS one, list_slice(embedding::DOUBLE[], len(embedding) // 2 + 1, len(embedding)) AS two FROM embeddings),
    w AS (SELECT vec_id, label, 'first' AS arm, one AS e FROM e UNION ALL SELECT vec_id, label, 'second', two FROM e),
    p AS (SELECT a.arm, a.label AS block, a.label = b.label AS contact, round({COSINE}, 9) AS x FROM w a JOIN w b ON b.arm = a.arm AND b.vec_id = a.vec_id + 1),
    v AS ({" UNION ALL ".join(f"SELECT '{k}' AS endpoint, arm, block, {sql} AS y FROM p" for k, (sql, _) in ENDPOINTS.items())})"""


def endpoint_values(spark, sf_dir):
    """(endpoint, arm, block, y): every registered endpoint of every pair, in one pass over the pairs."""
    size = F.size("embedding")
    half = F.expr("CAST(size(embedding) DIV 2 AS INT)")
    arms = F.create_map(F.lit("first"), F.slice("embedding", F.lit(1), half), F.lit("second"), F.slice("embedding", half + 1, size))
    w = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode(arms).alias("arm", "e"))
    b = w.select((F.col("vec_id") - 1).alias("vec_id"), "arm", F.col("label").alias("lb"), F.col("e").alias("eb"))
    p = w.join(b, ["vec_id", "arm"]).select("arm", F.col("label").alias("block"), (F.col("label") == F.col("lb")).alias("contact"), F.round(vectors.cosine(F.col("e"), F.col("eb")), 9).alias("x"))
    values = F.create_map(*(c for k, (_, f) in ENDPOINTS.items() for c in (F.lit(k), f(F.col("x"), F.col("contact")).cast("double"))))
    return p.select("arm", "block", F.explode(values).alias("endpoint", "y"))


@query(
    "ca5_endpoint_registry",
    f"WITH {ARMS} SELECT endpoint, arm, endpoint IN {PRIMARY} AS is_primary, count(y) AS n, round(avg(y), 6) AS value FROM v GROUP BY 1, 2",
)
def _(spark, sf_dir):
    v = endpoint_values(spark, sf_dir)
    return v.groupBy("endpoint", "arm").agg(F.count("y").alias("n"), F.round(F.avg("y"), 6).alias("value")).withColumn("is_primary", F.col("endpoint").isin(*PRIMARY))


@query(
    "ca10_contrasts_holm",
    f"""WITH {ARMS}, b AS (SELECT endpoint, block, round(avg(y) FILTER (WHERE arm = 'first') - avg(y) FILTER (WHERE arm = 'second'), 9) AS d FROM v WHERE endpoint IN {PRIMARY} GROUP BY 1, 2),
    c AS (SELECT endpoint, avg(d) AS delta, least(1, 2 * least((1 + count(*) FILTER (WHERE d <= 0)) / (1 + count(d)), (1 + count(*) FILTER (WHERE d >= 0)) / (1 + count(d)))) AS p FROM b GROUP BY 1),
    o AS (SELECT *, row_number() OVER (ORDER BY p, endpoint) AS k, count(*) OVER () AS m FROM c)
    SELECT endpoint, round(delta, 6) AS delta, round(p, 6) AS p, round(max(least(1, (m - k + 1) * p)) OVER (ORDER BY k), 6) AS p_holm FROM o""",
)
def _(spark, sf_dir):
    v = endpoint_values(spark, sf_dir).where(F.col("endpoint").isin(*PRIMARY))
    side = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("y")))
    b = v.groupBy("endpoint", "block").agg(F.round(side("first") - side("second"), 9).alias("d"))
    tail = lambda c: (1 + F.count_if(c)) / (1 + F.count("d"))
    c = b.groupBy("endpoint").agg(F.avg("d").alias("delta"), F.least(F.lit(1.0), 2 * F.least(tail(F.col("d") <= 0), tail(F.col("d") >= 0))).alias("p"))
    # four rows
    order = Window.partitionBy(F.lit(0)).orderBy("p", "endpoint")
    o = c.withColumn("k", F.row_number().over(order)).withColumn("m", F.count("*").over(Window.partitionBy(F.lit(0))))
    holm = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("k") + 1) * F.col("p"))).over(order)
    return o.select("endpoint", F.round("delta", 6).alias("delta"), F.round("p", 6).alias("p"), F.round(holm, 6).alias("p_holm"))


#: Similarity definitions of a pair.
GEOMETRY = f"""{PAIRS}, mu AS (SELECT list(m ORDER BY k) AS mu FROM (SELECT k, avg(v) AS m FROM (SELECT unnest(e) AS v, generate_subscripts(e, 1) AS k FROM e) GROUP BY 1)),
    g AS (SELECT i, d, contact, x AS cosine, round(-list_distance(ea, eb), 9) AS euclidean,
      round((list_inner_product(ea, eb) - list_inner_product(ea, mu) - list_inner_product(eb, mu) + list_inner_product(mu, mu)) / (sqrt(list_inner_product(ea, ea) - 2 * list_inner_product(ea, mu) + list_inner_product(mu, mu)) * sqrt(list_inner_product(eb, eb) - 2 * list_inner_product(eb, mu) + list_inner_product(mu, mu))), 9) AS centred FROM p, mu),
    l AS (SELECT 'cosine' AS similarity, d, contact, cosine AS x FROM g UNION ALL SELECT 'euclidean', d, contact, euclidean FROM g UNION ALL SELECT 'centred', d, contact, centred FROM g),
    t AS (SELECT similarity || '/all' AS k, contact, x FROM l UNION ALL SELECT similarity || '/near', contact, x FROM l WHERE d <= 2 UNION ALL SELECT similarity || '/far', contact, x FROM l WHERE d >= 2)"""


@query("cq11_geometry_comparison", f"WITH {GEOMETRY}, {AUROC} SELECT k AS cell, n, round((s - n1 * (n1 + 1) / 2) / nullif(n1 * n0, 0), 5) AS auroc FROM u")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    m = e.select(F.posexplode("embedding").alias("k", "v")).groupBy("k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    mu = m.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("mu"))  # one row, as wide as a vector
    p = pairs(spark, sf_dir).crossJoin(F.broadcast(mu))
    a, b, u = F.col("ea"), F.col("eb"), F.col("mu")
    similar = F.create_map(F.lit("cosine"), F.col("x"), F.lit("euclidean"), F.round(vectors.negative_euclidean(a, b), 9), F.lit("centred"), F.round(vectors.cosine(vectors.minus(a, u), vectors.minus(b, u)), 9))
    cells = F.array_compact(F.array(F.lit("/all"), F.when(F.col("d") <= 2, "/near"), F.when(F.col("d") >= 2, "/far")))  # a pair is in every cell it fits
    t = p.select("contact", "d", F.explode(similar).alias("s", "x")).select("contact", "x", "s", F.explode(cells).alias("c")).select("contact", "x", F.concat("s", "c").alias("cell"))
    return t.groupBy("cell").agg(F.count("*").alias("n")).join(ordered.auroc(t, "x", F.col("contact"), ("cell",)), "cell").select("cell", "n", F.round("auroc", 5).alias("auroc"))


@query(
    "cq9_target_variants",
    """WITH d AS (SELECT c_nationkey AS g, c_custkey AS donor, o_orderpriority AS locus, avg(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
    n AS (SELECT g, count(DISTINCT donor) AS donors FROM d GROUP BY 1), c AS (SELECT d.g, locus, count(v) AS nval, avg(v) AS m, max(donors) AS donors FROM d JOIN n ON n.g = d.g GROUP BY 1, 2)
    SELECT 'frozen' AS variant, count(*) AS cells, round(avg(m), 4) AS mean FROM c WHERE nval >= least(2, donors) UNION ALL SELECT 'lenient', count(*), round(avg(m), 4) FROM c WHERE nval >= 1
    UNION ALL SELECT 'no_single_donor_groups', count(*), round(avg(m), 4) FROM c WHERE nval >= least(2, donors) AND donors > 1""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("g"))
    d = table(spark, sf_dir, "orders").join(c, "o_custkey").groupBy("g", F.col("o_custkey").alias("donor"), F.col("o_orderpriority").alias("locus")).agg(F.avg("o_totalprice").alias("v"))
    n = d.groupBy("g").agg(F.countDistinct("donor").alias("donors"))
    cells = d.groupBy("g", "locus").agg(F.count("v").alias("nval"), F.avg("v").alias("m")).join(n, "g")
    strict = F.col("nval") >= F.least(F.lit(2), F.col("donors"))
    kinds = F.array_compact(F.array(F.when(strict, "frozen"), F.when(F.col("nval") >= 1, "lenient"), F.when(strict & (F.col("donors") > 1), "no_single_donor_groups")))
    return cells.select("m", F.explode(kinds).alias("variant")).groupBy("variant").agg(F.count("*").alias("cells"), F.round(F.avg("m"), 4).alias("mean"))


@query(
    "cq22_motif_at_offsets",
    """WITH p AS (SELECT text, k, strpos(text, 'th') AS pos FROM documents, range(-1, 2) r(k))
    SELECT CAST(k AS INTEGER) AS shift, count(*) AS n, round(avg(CASE WHEN pos + k >= 1 AND substr(text, CAST(greatest(pos + k, 1) AS BIGINT), 2) = 'th' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM p WHERE pos > 0 GROUP BY 1""",
)
def _(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text", F.instr("text", "th").alias("pos")).where("pos > 0")
    shifts = [F.struct(F.lit(k).alias("shift"), F.when((F.col("pos") + k >= 1) & (F.substring(F.col("text"), F.greatest(F.col("pos") + k, F.lit(1)), F.lit(2)) == "th"), 1.0).otherwise(0.0).alias("hit")) for k in (-1, 0, 1)]
    return d.select(F.inline(F.array(*shifts))).groupBy("shift").agg(F.count("*").alias("n"), F.round(F.avg("hit"), 6).alias("rate"))


@query(
    "cq24_covariates",
    """WITH p AS (SELECT p_partkey, p_brand, CAST(floor(p_retailprice) AS BIGINT) AS pos, p_name FROM part), m AS (SELECT DISTINCT CAST(floor(s_acctbal) AS BIGINT) AS at FROM supplier),
    l AS (SELECT p.*, m.at AS lower FROM p ASOF LEFT JOIN m ON p.pos >= m.at), u AS (SELECT l.*, m.at AS upper FROM l ASOF LEFT JOIN m ON l.pos <= m.at),
    f AS (SELECT l_partkey, min(l_returnflag) AS design FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1)
    SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY pos RANGE BETWEEN 20 PRECEDING AND 20 FOLLOWING) - 1 AS density,
    round((length(p_name) - length(replace(p_name, 'a', ''))) / nullif(length(p_name), 0), 6) AS share_a, least(coalesce(pos - lower, upper - pos), coalesce(upper - pos, pos - lower)) AS distance,
    coalesce(design, 'unknown') AS design, CASE WHEN design IS NULL THEN 'design: none or several' ELSE '' END AS note FROM u LEFT JOIN f ON l_partkey = p_partkey""",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.floor("p_retailprice").cast("long").alias("pos"), "p_name")
    m = table(spark, sf_dir, "supplier").select(F.floor("s_acctbal").cast("long").alias("pos")).distinct()
    low = lookups.last_at_or_before(p, m.withColumn("lower", F.col("pos")), "pos", ["lower"], width=100.0).drop("mark_at").withColumn("pos", -F.col("pos"))
    both = lookups.last_at_or_before(low, m.select((-F.col("pos")).alias("pos"), F.col("pos").alias("upper")), "pos", ["upper"], width=100.0).withColumn("pos", -F.col("pos"))
    w = Window.partitionBy("p_brand").orderBy("pos").rangeBetween(-20, 20)
    f = lookups.unambiguous(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("design")), "p_partkey", "design")
    share = (F.length("p_name") - F.length(F.replace(F.col("p_name"), F.lit("a"), F.lit("")))) / F.nullif(F.length("p_name"), F.lit(0))
    return both.join(f, "p_partkey", "left").select(
        "p_partkey",
        (F.count("*").over(w) - 1).alias("density"),
        F.round(share, 6).alias("share_a"),
        F.least(F.col("pos") - F.col("lower"), F.col("upper") - F.col("pos")).alias("distance"),
        F.coalesce("design", F.lit("unknown")).alias("design"),
        F.when(F.col("design").isNull(), "design: none or several").otherwise("").alias("note"),
    )


#: Cases (customers in debt) and controls with covariates; what a customer without an order is like is unknown.
BALANCE = """o AS (SELECT o_custkey, count(*) AS orders, min(o_orderstatus) AS status FROM orders GROUP BY 1),
    x AS (SELECT c_custkey, c_mktsegment, c_acctbal < 0 AS is_case, coalesce(orders, 0)::DOUBLE AS orders, coalesce(status, 'unknown') AS status, abs(c_acctbal) AS balance FROM customer LEFT JOIN o ON o_custkey = c_custkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, is_case ORDER BY sha256(CAST(c_custkey AS STRING) || ':41')) AS rn FROM x),
    k AS (SELECT c_mktsegment, least(count(*) FILTER (WHERE is_case), count(*) FILTER (WHERE NOT is_case)) AS n FROM x GROUP BY 1),
    l AS (SELECT is_case, rn <= n AS matched, unnest(['orders', 'balance', 'status=F', 'status=O', 'status=P', 'status=unknown']) AS covariate,
      unnest([orders, balance, CASE WHEN status = 'F' THEN 1.0 ELSE 0.0 END, CASE WHEN status = 'O' THEN 1.0 ELSE 0.0 END, CASE WHEN status = 'P' THEN 1.0 ELSE 0.0 END, CASE WHEN status = 'unknown' THEN 1.0 ELSE 0.0 END]::DOUBLE[]) AS v FROM r JOIN k USING (c_mktsegment))"""


@query(
    "cq33_balance_table",
    f"""WITH {BALANCE} SELECT covariate, round((avg(v) FILTER (WHERE is_case) - avg(v) FILTER (WHERE NOT is_case)) / nullif(sqrt((var_pop(v) FILTER (WHERE is_case) + var_pop(v) FILTER (WHERE NOT is_case)) / 2), 0), 6) AS before,
    round((avg(v) FILTER (WHERE is_case AND matched) - avg(v) FILTER (WHERE NOT is_case AND matched)) / nullif(sqrt((var_pop(v) FILTER (WHERE is_case AND matched) + var_pop(v) FILTER (WHERE NOT is_case AND matched)) / 2), 0), 6) AS after FROM l GROUP BY 1""",
)
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.min("o_orderstatus").alias("status"))
    x = table(spark, sf_dir, "customer").join(o, "c_custkey", "left").select(
        "c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("is_case"), F.coalesce("orders", F.lit(0)).cast("double").alias("orders"), F.coalesce("status", F.lit("unknown")).alias("status"), F.abs("c_acctbal").alias("balance")
    )
    r = x.withColumn("rn", F.row_number().over(Window.partitionBy("c_mktsegment", "is_case").orderBy(lookups.hash_rank("c_custkey", seed=41))))
    k = x.groupBy("c_mktsegment").agg(F.least(F.count_if(F.col("is_case")), F.count_if(~F.col("is_case"))).alias("n"))
    values = F.create_map(F.lit("orders"), F.col("orders"), F.lit("balance"), F.col("balance"), *(c for s in ("F", "O", "P", "unknown") for c in (F.lit(f"status={s}"), (F.col("status") == s).cast("double"))))
    v = r.join(k, "c_mktsegment").select("is_case", (F.col("rn") <= F.col("n")).alias("matched"), F.explode(values).alias("covariate", "v"))

    def smd(inside):
        a, b = F.when(F.col("is_case") & inside, F.col("v")), F.when(~F.col("is_case") & inside, F.col("v"))
        return F.round((F.avg(a) - F.avg(b)) / F.nullif(F.sqrt((F.var_pop(a) + F.var_pop(b)) / 2), F.lit(0.0)), 6)

    return v.groupBy("covariate").agg(smd(F.lit(True)).alias("before"), smd(F.col("matched")).alias("after"))


#: Evaluation subsets (unions of cohorts) and views of loci.
SUBSETS = {"A": "A", "N": "N", "R": "R", "A+R": "AR", "all": "ANR"}
VIEWS = {"all": (1, 7), "head": (1, 3), "tail": (4, 7)}


@query(
    "cq30_evaluation_subsets",
    "WITH s(subset, flags) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in SUBSETS.items()) + "), w(view, lo, hi) AS (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in VIEWS.items()) + """)
    SELECT subset, view, count(*) AS n, round(avg(abs(l_discount - l_tax)), 6) AS mae, round(covar_pop(l_discount, l_tax) / nullif(stddev_pop(l_discount) * stddev_pop(l_tax), 0), 5) AS pearson
    FROM lineitem JOIN s ON contains(flags, l_returnflag) JOIN w ON l_linenumber BETWEEN lo AND hi GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    d, t = F.col("l_discount"), F.col("l_tax")
    # sums of the finest cells first: every subset and view is a union of them
    cells = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linenumber").agg(
        F.count("*").alias("n"), F.sum(F.abs(d - t)).alias("e"), F.sum(d).alias("x"), F.sum(t).alias("y"), F.sum(d * d).alias("xx"), F.sum(t * t).alias("yy"), F.sum(d * t).alias("xy")
    )
    inside = [F.when(F.lit(flags).contains(F.col("l_returnflag")), F.lit(k)) for k, flags in SUBSETS.items()]
    seen = [F.when(F.col("l_linenumber").between(a, b), F.lit(k)) for k, (a, b) in VIEWS.items()]
    long = cells.withColumn("subset", F.explode(F.array_compact(F.array(*inside)))).withColumn("view", F.explode(F.array_compact(F.array(*seen))))
    s = long.groupBy("subset", "view").agg(*(F.sum(c).alias(c) for c in ("n", "e", "x", "y", "xx", "yy", "xy")))
    f = F.col
    r = (f("xy") - f("x") * f("y") / f("n")) / F.nullif(F.sqrt((f("xx") - f("x") * f("x") / f("n")) * (f("yy") - f("y") * f("y") / f("n"))), F.lit(0.0))
    return s.select("subset", "view", "n", F.round(f("e") / f("n"), 6).alias("mae"), F.round(r, 5).alias("pearson"))


#: Brands of the held-out protocol, the others are for fitting.
HELD_OUT = ("Brand#1", "Brand#12", "Brand#23", "Brand#5")


@query("cq31_fit_and_held_out", f"SELECT p_partkey, CASE WHEN p_brand IN {HELD_OUT} THEN 'held_out' ELSE 'fit' END AS role FROM part WHERE p_brand IS NOT NULL")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_brand is not null")
    return p.select("p_partkey", F.when(F.col("p_brand").isin(*HELD_OUT), "held_out").otherwise("fit").alias("role"))


@query(
    "ca3_discovery_selection",
    """WITH x AS (SELECT p_type, p_brand, p_retailprice AS v, substr(sha256(CAST(p_partkey AS STRING) || ':13'), 1, 1) < '8' AS discovery FROM part),
    s AS (SELECT p_type, p_brand, round(avg(v) FILTER (WHERE discovery), 6) AS screen, round(avg(v) FILTER (WHERE NOT discovery), 6) AS confirmation FROM x GROUP BY 1, 2)
    SELECT p_type, p_brand, screen, confirmation FROM s WHERE screen IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY screen DESC, p_brand) <= 2""",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("discovery", F.substring(lookups.hash_rank("p_partkey", seed=13), 1, 1) < "8")
    v = F.col("p_retailprice")
    s = p.groupBy("p_type", "p_brand").agg(F.round(F.avg(F.when(F.col("discovery"), v)), 6).alias("screen"), F.round(F.avg(F.when(~F.col("discovery"), v)), 6).alias("confirmation"))
    w = Window.partitionBy("p_type").orderBy(F.desc("screen"), "p_brand")  # a row an arm
    return s.where("screen is not null").withColumn("rn", F.row_number().over(w)).where("rn <= 2").drop("rn")


#: Sensitivity drivers: name -> condition, the same text for both engines.
DRIVERS = {
    "all": "TRUE",
    "no_zero_discount": "l_discount > 0",
    "no_zero_tax": "l_tax > 0",
    "small": "l_quantity <= 10",
    "large": "l_quantity >= 40",
    "first_line": "l_linenumber = 1",
    "later_lines": "l_linenumber > 1",
    "open": "l_linestatus = 'O'",
    "filled": "l_linestatus = 'F'",
    "returned": "l_returnflag = 'R'",
    "not_returned": "l_returnflag <> 'R'",
    "cheap": "l_extendedprice < 20000",
}


@query(
    "ca6_sensitivity_drivers",
    " UNION ALL ".join(f"SELECT '{k}' AS driver, count(*) AS n, round(avg(l_discount - l_tax), 6) AS gap FROM lineitem WHERE {c}" for k, c in DRIVERS.items()),
)
def _(spark, sf_dir):
    names = F.array_compact(F.array(*(F.when(F.expr(c), k) for k, c in DRIVERS.items())))
    li = table(spark, sf_dir, "lineitem").select((F.col("l_discount") - F.col("l_tax")).alias("d"), F.explode(names).alias("driver"))
    return li.groupBy("driver").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("gap"))


@query(
    "sp4_patient_protocol",
    """WITH s AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256(CAST(c_custkey AS STRING) || ':20260925')) - 1 AS rn, count(*) OVER () AS n FROM customer),
    g AS (SELECT c_custkey, CASE WHEN rn < floor(n * 0.8) THEN 'train' WHEN rn < floor(n * 0.8) + floor(n * 0.1) THEN 'validation' ELSE 'test' END AS split FROM s)
    SELECT split, count(*) AS n, 0 AS leaked FROM g GROUP BY 1""",
)
def _(spark, sf_dir):
    from marlstone.operators import splits

    g = splits.group_split(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", seed=20260925)
    shared = g.groupBy("c_custkey").agg(F.countDistinct("split").alias("k"))
    return g.join(shared, "c_custkey").groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).cast("int").alias("leaked"))
