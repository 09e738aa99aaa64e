"""Queries of joins by key and position, windows and sorts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import contracts, lookups, ordered, pair_space, splits, stopping
from marlstone.operators import intervals as spans
from marlstone.plans.registry import query
from marlstone.session import table
from marlstone.sources import sinks


@query("jn1_strict_lookup", "SELECT l_orderkey, l_linenumber, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("p_partkey"))
    return lookups.strict_lookup(ids, table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey").drop("p_partkey")


@query("jn2_lenient_lookup", "SELECT doc_id, quality, quality IS NOT NULL AS found FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf_dir):
    return lookups.lenient_lookup(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query("jn3_inverse_lookup", "SELECT c_custkey, coalesce(min(o_orderkey), -1) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf_dir):
    first = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("k"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(first, "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(-1)).alias("first_order"))


@query(
    "jn4_join_with_rule",
    """SELECT coalesce(s.ctx, CASE WHEN c_acctbal < 0 THEN 'sea' ELSE 'shelf' END) AS context, count(*) AS n, count(s.ctx) AS from_table
    FROM customer LEFT JOIN (SELECT s_nationkey, max(s_name) AS ctx FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON s_nationkey = c_nationkey GROUP BY 1""",
)
def _(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.max("s_name").alias("ctx"))
    c = table(spark, sf_dir, "customer").join(s, "c_nationkey", "left")
    rule = F.when(F.col("c_acctbal") < 0, "sea").otherwise("shelf")
    return c.groupBy(F.coalesce("ctx", rule).alias("context")).agg(F.count("*").alias("n"), F.count("ctx").alias("from_table"))


@query("jn5_jn6_one_to_one", "SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def _(spark, sf_dir):
    return lookups.one_to_one(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")


@query(
    "jn7_full_outer_indicator",
    "SELECT CASE WHEN c.k IS NULL THEN 'right_only' WHEN s.k IS NULL THEN 'left_only' ELSE 'both' END AS side, count(*) AS n FROM (SELECT DISTINCT c_nationkey AS k FROM customer) c FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) s ON c.k = s.k GROUP BY 1",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).distinct().withColumn("l", F.lit(1))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")).distinct().withColumn("r", F.lit(1))
    side = F.when(F.col("l").isNull(), "right_only").when(F.col("r").isNull(), "left_only").otherwise("both")
    return c.join(s, "k", "full").groupBy(side.alias("side")).agg(F.count("*").alias("n"))


@query("jn8_unambiguous", "SELECT l_partkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1")
def _(spark, sf_dir):
    return lookups.unambiguous(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query("jn9_collapsed_codes", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, '' ORDER BY l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return lookups.collapsed(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag")


@query("jn10_semi_anti", "SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END AS label FROM part")
def _(spark, sf_dir):
    hit = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("label", F.lit(1))
    return table(spark, sf_dir, "part").select("p_partkey").join(hit, "p_partkey", "left").select("p_partkey", F.coalesce("label", F.lit(0)).alias("label"))


#: Each order opens a closed interval of some days at its customer's nation; suppliers' shipments are points there.
INTERVALS = "SELECT o_orderkey, CAST(o_custkey % 25 AS INTEGER) AS chrom, {day} AS start, {day} + o_orderkey % 9 AS stop FROM orders"
DAY_DUCK, DAY_SPARK = "CAST(epoch(o_orderdate) // 86400 AS BIGINT)", "CAST(unix_seconds(CAST(o_orderdate AS TIMESTAMP)) div 86400 AS BIGINT)"


def intervals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.expr(DAY_SPARK))
    return o.select("o_orderkey", F.expr("CAST(o_custkey % 25 AS INT)").alias("chrom"), F.col("day").alias("start"), F.expr("day + o_orderkey % 9").alias("stop"))


def ship_points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("CAST(l_suppkey % 25 AS INT)").alias("chrom"), F.expr("CAST(unix_seconds(CAST(l_shipdate AS TIMESTAMP)) div 86400 AS BIGINT)").alias("pos"))
    return li


POINTS = "SELECT l_orderkey, l_linenumber, CAST(l_suppkey % 25 AS INTEGER) AS chrom, CAST(epoch(l_shipdate) // 86400 AS BIGINT) AS pos FROM lineitem"


@query(
    "jn11_interval_containment",
    f"""WITH i AS (SELECT chrom, start, max(stop) AS stop FROM ({INTERVALS.format(day=DAY_DUCK)}) GROUP BY 1, 2), p AS ({POINTS})
    SELECT l_orderkey, l_linenumber, CASE WHEN i.stop >= p.pos THEN i.start END AS start FROM p ASOF LEFT JOIN i ON p.chrom = i.chrom AND p.pos >= i.start""",
)
def _(spark, sf_dir):
    marks = intervals(spark, sf_dir).groupBy("chrom", F.col("start").alias("pos")).agg(F.max("stop").alias("stop"))
    got = lookups.last_at_or_before(ship_points(spark, sf_dir), marks, "pos", ["stop"], ("chrom",), width=365.0)
    return got.select("l_orderkey", "l_linenumber", F.when(F.col("stop") >= F.col("pos"), F.col("mark_at")).alias("start"))


@query(
    "jn12_covered_by_any",
    f"""WITH i AS ({INTERVALS.format(day=DAY_DUCK)}), p AS ({POINTS}), d AS (SELECT DISTINCT chrom, pos FROM p),
    c AS (SELECT DISTINCT d.chrom, d.pos FROM d JOIN i ON i.chrom = d.chrom AND d.pos BETWEEN i.start AND i.stop)
    SELECT p.chrom, count(*) AS n, count(c.pos) AS covered FROM p LEFT JOIN c ON c.chrom = p.chrom AND c.pos = p.pos GROUP BY 1""",
)
def _(spark, sf_dir):
    # running maximum of ends up to each start: a point is covered if the furthest end so far reaches it
    starts = intervals(spark, sf_dir).groupBy("chrom", F.col("start").alias("pos")).agg(F.max("stop").alias("stop"))
    w = Window.partitionBy("chrom").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marks = starts.withColumn("reach", F.max("stop").over(w)).drop("stop")
    got = lookups.last_at_or_before(ship_points(spark, sf_dir), marks, "pos", ["reach"], ("chrom",), width=365.0)
    return got.groupBy("chrom").agg(F.count("*").alias("n"), F.count_if(F.col("reach") >= F.col("pos")).alias("covered"))


NEAR = f"""WITH m AS (SELECT DISTINCT chrom, start AS at FROM ({INTERVALS.format(day=DAY_DUCK)})), p AS ({POINTS}),
    l AS (SELECT p.*, m.at AS lower FROM p ASOF LEFT JOIN m ON p.chrom = m.chrom AND p.pos >= m.at),
    u AS (SELECT l.*, m.at AS upper FROM l ASOF LEFT JOIN m ON l.chrom = m.chrom AND l.pos <= m.at)"""


def nearest(spark, sf_dir):
    marks = intervals(spark, sf_dir).select("chrom", F.col("start").alias("pos")).distinct()
    p = ship_points(spark, sf_dir)
    low = lookups.last_at_or_before(p, marks.withColumn("lower", F.col("pos")), "pos", ["lower"], ("chrom",), width=365.0)
    flipped = low.drop("mark_at").withColumn("pos", -F.col("pos"))
    high = lookups.last_at_or_before(flipped, marks.select("chrom", (-F.col("pos")).alias("pos"), F.col("pos").alias("upper")), "pos", ["upper"], ("chrom",), width=365.0)
    return high.withColumn("pos", -F.col("pos"))


@query("jn14_nearest_point", f"{NEAR} SELECT l_orderkey, l_linenumber, least(coalesce(pos - lower, upper - pos), coalesce(upper - pos, pos - lower)) AS distance FROM u")
def _(spark, sf_dir):
    return nearest(spark, sf_dir).select("l_orderkey", "l_linenumber", F.least(F.col("pos") - F.col("lower"), F.col("upper") - F.col("pos")).alias("distance"))


@query(
    "jn15_distance_class",
    f"""{NEAR}, d AS (SELECT least(coalesce(pos - lower, upper - pos), coalesce(upper - pos, pos - lower)) AS d FROM u)
    SELECT CASE WHEN d = 0 THEN 'island' WHEN d <= 2 THEN 'shore' WHEN d <= 4 THEN 'shelf' ELSE 'sea' END AS class, count(*) AS n FROM d GROUP BY 1""",
)
def _(spark, sf_dir):
    d = F.least(F.col("pos") - F.col("lower"), F.col("upper") - F.col("pos"))
    n = nearest(spark, sf_dir).select(F.when(d == 0, "island").when(d <= 2, "shore").when(d <= 4, "shelf").otherwise("sea").alias("class"))
    return n.groupBy("class").agg(F.count("*").alias("n"))


#: Candidates on each side of a point, by start.
SIDE = 6


@query(
    "jn13_nearest_interval",
    f"""WITH i AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start, o_orderkey) AS k FROM ({INTERVALS.format(day=DAY_DUCK)})), p AS (SELECT DISTINCT chrom, pos FROM ({POINTS})),
    s AS (SELECT chrom, start, max(k) AS k FROM i GROUP BY 1, 2), a AS (SELECT p.chrom, p.pos, coalesce(s.k, 0) AS r FROM p ASOF LEFT JOIN s ON p.chrom = s.chrom AND p.pos >= s.start),
    c AS (SELECT a.chrom, a.pos, i.o_orderkey, greatest(i.start - a.pos, a.pos - i.stop, 0) AS distance, abs(2 * a.pos - i.start - i.stop) AS m FROM a JOIN i ON i.chrom = a.chrom AND i.k BETWEEN a.r - {SIDE - 1} AND a.r + {SIDE})
    SELECT chrom, pos, o_orderkey, distance FROM c QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY distance, m, o_orderkey) = 1""",
)
def _(spark, sf_dir):
    """The nearest of the six intervals that start last before a point and the six that start first after it; ties by midpoint.

    Intervals are numbered along each chromosome by running totals; a point finds its place by an as-of join and its
    candidates by number, so no distance is out of reach.
    """
    i = intervals(spark, sf_dir)
    starts = ordered.running(i.groupBy("chrom", "start").agg(F.count("*").alias("n")), "start", ["n"], ("chrom",)).select("chrom", "start", "n", "before_n")
    within_start = F.row_number().over(Window.partitionBy("chrom", "start").orderBy("o_orderkey"))
    numbered = i.join(starts, ["chrom", "start"]).withColumn("k", F.col("before_n") + within_start).select("chrom", "k", "o_orderkey", "start", "stop")
    marks = starts.select("chrom", F.col("start").alias("pos"), (F.col("before_n") + F.col("n")).alias("last"))
    p = lookups.last_at_or_before(ship_points(spark, sf_dir).select("chrom", "pos").distinct(), marks, "pos", ["last"], ("chrom",), width=365.0)
    last = F.coalesce("last", F.lit(0))
    c = p.select("chrom", "pos", F.explode(F.sequence(last - (SIDE - 1), last + SIDE)).alias("k")).join(numbered, ["chrom", "k"])
    distance = F.greatest(F.col("start") - F.col("pos"), F.col("pos") - F.col("stop"), F.lit(0))
    middle = F.abs(2 * F.col("pos") - F.col("start") - F.col("stop"))
    best = c.groupBy("chrom", "pos").agg(F.min(F.struct(distance.alias("distance"), middle.alias("m"), "o_orderkey")).alias("b"))
    return best.select("chrom", "pos", F.col("b.o_orderkey").alias("o_orderkey"), F.col("b.distance").alias("distance"))


@query(
    "jn16_band_join",
    """WITH a AS (SELECT c_custkey, c_nationkey AS k, CAST(floor(c_acctbal) AS BIGINT) AS pos FROM customer), b AS (SELECT s_suppkey, s_nationkey AS k, CAST(floor(s_acctbal) AS BIGINT) AS pos FROM supplier)
    SELECT 'customer' AS side, c_custkey AS id, count(b.pos) AS near FROM a LEFT JOIN b ON a.k = b.k AND abs(a.pos - b.pos) <= 50 GROUP BY 2
    UNION ALL SELECT 'supplier', s_suppkey, count(a.pos) FROM b LEFT JOIN a ON a.k = b.k AND abs(a.pos - b.pos) <= 50 GROUP BY 2""",
)
def _(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.floor("c_acctbal").cast("long").alias("pos"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"), F.floor("s_acctbal").cast("long").alias("pos"))
    # equal positions are added up before they meet: a popular one is one row
    counts = [x.groupBy("k", "pos").agg(F.count("*").alias("n")) for x in (a, b)]

    def near(rows, own, other, side):
        hits = lookups.within(own, other, 50, ("k",)).groupBy("k", "pos").agg(F.sum("r_n").alias("near"))
        return rows.join(hits, ["k", "pos"], "left").select(F.lit(side).alias("side"), "id", F.coalesce("near", F.lit(0)).alias("near"))

    return near(a, *counts, "customer").unionByName(near(b, *counts[::-1], "supplier"))


@query(
    "jn17_overlapping_intervals",
    f"""WITH i AS ({INTERVALS.format(day=DAY_DUCK)})
    SELECT a.o_orderkey, count(*) - 1 AS overlaps FROM i a JOIN i b ON a.chrom = b.chrom AND a.start <= b.stop AND b.start <= a.stop GROUP BY 1""",
)
def _(spark, sf_dir):
    """Other intervals that overlap each one: those that start by its end less those that ended before its start."""
    i = intervals(spark, sf_dir)

    def so_far(end, name):
        g = ordered.running(i.groupBy("chrom", F.col(end).alias("pos")).agg(F.count("*").alias("n")), "pos", ["n"], ("chrom",))
        return g.select("chrom", "pos", (F.col("before_n") + F.col("n")).alias(name))

    started = lookups.last_at_or_before(i.withColumn("pos", F.col("stop")), so_far("start", "started"), "pos", ["started"], ("chrom",), width=365.0)
    ended = lookups.last_at_or_before(started.drop("mark_at").withColumn("pos", F.col("start") - 1), so_far("stop", "ended"), "pos", ["ended"], ("chrom",), width=365.0)
    return ended.select("o_orderkey", (F.col("started") - F.coalesce("ended", F.lit(0)) - 1).alias("overlaps"))


@query("jn18_window_density", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND 86400 FOLLOWING) - 1 AS density FROM events")
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("s").rangeBetween(-86400, 86400)
    e = table(spark, sf_dir, "events").select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    return e.select("event_id", (F.count("*").over(w) - 1).alias("density"))


@query("jn19_bin_join", "SELECT l_orderkey, l_linenumber, o_orderpriority FROM lineitem JOIN (SELECT o_orderkey AS b, o_orderpriority FROM orders) ON b = l_orderkey // 1")
def _(spark, sf_dir):
    bins = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bin"), "o_orderpriority")
    return table(spark, sf_dir, "lineitem").withColumn("bin", F.floor(F.col("l_orderkey") / 1).cast("long")).join(bins, "bin").select("l_orderkey", "l_linenumber", "o_orderpriority")


#: Intervals with their order's priority as type; those of filled orders are the other side.
TYPED = f"i AS (SELECT n.*, o_orderpriority AS type, o_orderstatus = 'F' AS filled FROM ({INTERVALS.format(day=DAY_DUCK)}) n JOIN orders USING (o_orderkey))"
MEET = "a.chrom = b.chrom AND a.type = b.type AND a.start <= b.stop AND b.start <= a.stop"


def typed_intervals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("type"), (F.col("o_orderstatus") == "F").alias("filled"))
    return intervals(spark, sf_dir).join(o, "o_orderkey")


@query("jn17_overlap_pairs", f"WITH {TYPED} SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM i a JOIN i b ON {MEET} WHERE NOT a.filled AND b.filled")
def _(spark, sf_dir):
    i = typed_intervals(spark, sf_dir)
    got = spans.overlap_pairs(i.where("not filled"), i.where("filled"), ("chrom", "type"))
    return got.select(F.col("o_orderkey").alias("a"), F.col("r_o_orderkey").alias("b"))


@query("jn17_typed_exists", f"WITH {TYPED} SELECT a.o_orderkey, EXISTS (SELECT 1 FROM i b WHERE b.filled AND {MEET}) AS overlaps FROM i a WHERE NOT a.filled")
def _(spark, sf_dir):
    i = typed_intervals(spark, sf_dir)
    return spans.with_overlap_flag(i.where("not filled"), i.where("filled"), ("chrom", "type"), 365.0).select("o_orderkey", "overlaps")


@query(
    "jn17_block_loci",
    f"""WITH i AS ({INTERVALS.format(day=DAY_DUCK)}), p AS (SELECT chrom, pos, count(*) AS n FROM ({POINTS}) GROUP BY 1, 2)
    SELECT o_orderkey, pos, n FROM i JOIN p ON p.chrom = i.chrom AND pos BETWEEN start AND stop""",
)
def _(spark, sf_dir):
    """Each interval with every shipment day inside it."""
    loci = ship_points(spark, sf_dir).groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    return spans.expand_blocks(intervals(spark, sf_dir), loci, ("chrom",)).select("o_orderkey", F.col("r_pos").alias("pos"), F.col("r_n").alias("n"))


def _floyd(most: int) -> str:
    """SQL of Floyd's sampling: a step a wanted number, from the groups z (k, m, t) with more pairs than that."""
    text = f"f0 AS (SELECT k, m, t, CAST([] AS BIGINT[]) AS p FROM z WHERE t > {most})"
    for s in range(most):
        at = f"(t - {most - s})"
        text += f""",
    f{s + 1} AS (SELECT k, m, t, CASE WHEN list_contains(p, d) THEN list_append(p, {at}) ELSE list_append(p, d) END AS p FROM (SELECT *, ('0x' || substr(sha256('17:' || k || ':' || {at}), 1, 12))::BIGINT % ({at} + 1) AS d FROM f{s}))"""
    return text


@query(
    "jn20_capped_pairs",
    f"""WITH a AS (SELECT s_nationkey AS k, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
    b AS (SELECT c_nationkey AS k, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS j, count(*) OVER (PARTITION BY c_nationkey) AS m FROM customer),
    z AS (SELECT k, m, CAST(n * m AS BIGINT) AS t FROM (SELECT DISTINCT k, n FROM a) JOIN (SELECT DISTINCT k, m FROM b) USING (k)), {_floyd(5)},
    c AS (SELECT k, m, unnest(p) AS q FROM f5 UNION ALL SELECT k, m, unnest(range(t)) FROM z WHERE t <= 5)
    SELECT c.k, s_suppkey, c_custkey FROM c JOIN a ON a.k = c.k AND a.i = q // c.m JOIN b ON b.k = c.k AND b.j = q % c.m""",
)
def _(spark, sf_dir):
    """At most five projected pairs a bin, drawn from the numbered products of its two sides."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), "s_suppkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    return pair_space.capped_products(s, c, "k", "s_suppkey", "c_custkey", 5, seed=17)


@query("jn21_self_reference", "SELECT a.p_partkey, b.p_retailprice - a.p_retailprice AS delta FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    matched = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_retailprice").alias("other"))
    return p.join(matched, "p_partkey").select("p_partkey", (F.col("other") - F.col("p_retailprice")).alias("delta"))


@query(
    "jn27_jn28_rank_pairing",
    """WITH r AS (SELECT c_custkey, c_mktsegment, c_acctbal < 0 AS pos, row_number() OVER (PARTITION BY c_mktsegment, c_acctbal < 0 ORDER BY sha256(CAST(c_custkey AS STRING) || ':17')) AS rn FROM customer)
    SELECT p.c_custkey AS positive, n.c_custkey AS negative FROM r p JOIN r n ON p.c_mktsegment = n.c_mktsegment AND p.rn = n.rn AND p.pos AND NOT n.pos""",
)
def _(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("pos"))
    r = splits.hash_positions(c, "c_custkey", 17, ("c_mktsegment", "pos")).select("c_custkey", "c_mktsegment", "pos", F.col("_rn").alias("rn"))
    p, n = r.where("pos").withColumnRenamed("c_custkey", "positive").drop("pos"), r.where("not pos").withColumnRenamed("c_custkey", "negative").drop("pos")
    return p.join(n, ["c_mktsegment", "rn"]).select("positive", "negative")


@query("jn30_jn31_coordinate_join", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders JOIN customer ON c_custkey = o_custkey")
def _(spark, sf_dir):
    o = contracts.require_unique(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey", "o_custkey")
    return o.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "jn32_best_overlap_partner",
    """WITH s AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), k AS (SELECT s, count(*) AS n FROM s GROUP BY 1),
    o AS (SELECT a.s, b.s AS t, count(*) AS c FROM s a JOIN s b ON a.p = b.p AND a.s <> b.s GROUP BY 1, 2),
    j AS (SELECT o.s, o.t, round(c / (x.n + y.n - c), 6) AS jaccard FROM o JOIN k x ON x.s = o.s JOIN k y ON y.s = o.t)
    SELECT s, t AS partner, jaccard FROM j QUALIFY row_number() OVER (PARTITION BY s ORDER BY jaccard DESC, t) = 1""",
)
def _(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    sized = sinks.written(s.join(s.groupBy("s").agg(F.count("*").cast("int").alias("n")), "s"))  # a set's size goes with its rows
    # a part's sets, in lists of some hundreds, go to each of them: pairs are first made where they are counted
    lists = sized.join(sized.groupBy("p").agg(F.count("*").alias("k")), "p").groupBy("p", F.pmod(F.xxhash64("s"), F.ceil(F.col("k") / 512)).alias("_part")).agg(F.collect_list(F.struct("s", "n")).alias("l"))
    lists = lists.select("p", F.transform("l", lambda v: v["s"]).alias("t"), F.transform("l", lambda v: v["n"]).alias("m"))
    met = sized.join(lists, "p").select("s", "n", "t", "m").repartition("s")
    met = met.select("s", "n", F.explode(F.arrays_zip("t", "m")).alias("o")).select("s", "n", "o.t", "o.m").where("s <> t")
    j = met.groupBy("s", "t", "n", "m").agg(F.count("*").alias("c"))
    j = j.select("s", "t", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 6).alias("jaccard"))
    best = j.groupBy("s").agg(F.max(F.struct("jaccard", (-F.col("t")).alias("t"))).alias("b"))
    return best.select("s", (-F.col("b.t")).alias("partner"), F.col("b.jaccard").alias("jaccard"))


# ---- windows ---------------------------------------------------------------------------------------------------


@query("wn1_first_of_order", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, sha256(CAST(o_orderkey AS STRING) || ':17')) = 1")
def _(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), lookups.hash_rank("o_orderkey", seed=17))
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderkey")


@query("wn2_mid_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS mid_rank FROM part")
def _(spark, sf_dir):
    return ordered.mid_ranks(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", "mid_rank")


@query(
    "wn3_weighted_mid_rank",
    """WITH g AS (SELECT l_quantity AS x, sum(CAST(l_linenumber AS BIGINT)) AS w FROM lineitem GROUP BY 1)
    SELECT x, round((sum(w) OVER (ORDER BY x) - w / 2) / sum(w) OVER (), 9) AS fraction FROM g""",
)
def _(spark, sf_dir):
    g = ordered.tie_groups(table(spark, sf_dir, "lineitem"), "l_quantity", w=F.col("l_linenumber").cast("long"))
    return g.select(F.col("l_quantity").alias("x"), F.round((F.col("before_w") + F.col("w") / 2) / F.col("all_w"), 9).alias("fraction"))


@query("wn4_group_transform", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders")
def _(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(o.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey").select("o_orderkey", "n")


@query(
    "wn5_wn6_running",
    "SELECT event_id, row_number() OVER w - 1 AS ordinal, round(sum(value) OVER w, 4) AS running, max(value) OVER w AS reach FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    r = w.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("ordinal"), F.round(F.sum("value").over(r), 4).alias("running"), F.max("value").over(r).alias("reach"))


@query(
    "wn7_rank_then_cut",
    "WITH r AS (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, CAST(greatest(ceil((rn - 1) * 5 / (n - 1)), 1) - 1 AS BIGINT) AS bin FROM r",
)
def _(spark, sf_dir):
    w = Window.partitionBy("c_mktsegment")
    r = table(spark, sf_dir, "customer").select("c_custkey", F.row_number().over(w.orderBy("c_acctbal", "c_custkey")).alias("rn"), F.count("*").over(w).alias("n"))
    return r.select("c_custkey", (F.greatest(F.ceil((F.col("rn") - 1) * 5 / (F.col("n") - 1)), F.lit(1)) - 1).cast("long").alias("bin"))


@query(
    "wn8_quantile_bins",
    "WITH q AS (SELECT quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) AS e FROM part) SELECT p_partkey, CAST((p_retailprice >= e[1])::INT + (p_retailprice >= e[2])::INT + (p_retailprice >= e[3])::INT AS INTEGER) AS right_bin, CAST((p_retailprice > e[1])::INT + (p_retailprice > e[2])::INT + (p_retailprice > e[3])::INT AS INTEGER) AS left_bin FROM part, q",
)
def _(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    q = ordered.quantiles(p, "p_retailprice", [0.25, 0.5, 0.75]).withColumnRenamed("quantiles", "e")
    v = F.col("p_retailprice")
    side = lambda op: sum((op(F.col("e")[i]).cast("int") for i in range(1, 3)), op(F.col("e")[0]).cast("int"))
    return p.crossJoin(F.broadcast(q)).select("p_partkey", side(lambda e: v >= e).alias("right_bin"), side(lambda e: v > e).alias("left_bin"))


@query("wn9_fixed_edges", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 WHEN l_quantity < 40 THEN 2 ELSE 3 END AS right_open, CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 40 THEN 2 ELSE 3 END AS right_closed FROM lineitem")
def _(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(q < 10, 0).when(q < 25, 1).when(q < 40, 2).otherwise(3).alias("right_open"),
        F.when(q <= 10, 0).when(q <= 25, 1).when(q <= 40, 2).otherwise(3).alias("right_closed"),
    )


@query(
    "wn10_autocorrelation",
    """WITH z AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events WHERE value IS NOT NULL)
    SELECT user_id, round(covar_pop(value, p) / nullif(stddev_pop(value) * stddev_pop(p), 0), 6) AS r FROM z WHERE p IS NOT NULL GROUP BY 1""",
)
def _(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    z = table(spark, sf_dir, "events").where("value is not null").select("user_id", "value", F.lag("value").over(w).alias("p")).where("p is not null")
    return z.groupBy("user_id").agg(F.round(F.covar_pop("value", "p") / F.nullif(F.stddev_pop("value") * F.stddev_pop("p"), F.lit(0.0)), 6).alias("r"))


@query("wn11_best_and_tail", "SELECT user_id, arg_min(event_id, (value, event_id)) AS best, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "events").where("value is not null").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("best"), F.count("*").alias("n"))


@query(
    "wn13_top_per_category",
    "SELECT p_brand, p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY (p_size > 25) DESC, p_retailprice DESC, p_partkey) <= 4",
)
def _(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy(F.desc(F.col("p_size") > 25), F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").withColumn("rn", F.row_number().over(w)).where("rn <= 4").select("p_brand", "p_partkey")


@query("wn14_wn15_ordered_names", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC, n_name) AS names FROM nation GROUP BY 1")
def _(spark, sf_dir):
    inner = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n_nationkey")).alias("k"), "n_name"))), lambda x: x["n_name"])
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(inner, ",").alias("names"))


@query(
    "wn12_early_stopping",
    """WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE value IS NOT NULL),
    s AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST('inf' AS DOUBLE) AS ref, 0 AS bad FROM e
      UNION ALL SELECT s.user_id, e.k, CASE WHEN value < ref * 0.95 THEN value ELSE ref END, CASE WHEN value < ref * 0.95 THEN 0 ELSE bad + 1 END FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1 WHERE bad < 5)
    SELECT user_id, max(k) AS steps, round(arg_max(ref, k), 6) AS reference, max(bad) = 5 AS stopped FROM s GROUP BY 1""",
)
def _(spark, sf_dir):
    """Each user's events in order: the reference is reset by an improvement of 5 %, and five events without one stop the scan."""
    told = stopping.early_stopping(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 5, 0.05)
    return told.select("user_id", "steps", F.round("reference", 6).alias("reference"), "stopped")


@query("wn16_masked_selection", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY sha256(CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) || ':17')) <= 10")
def _(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy(lookups.hash_rank("l_orderkey", "l_linenumber", seed=17))
    return table(spark, sf_dir, "lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 10").select("l_suppkey", "l_orderkey", "l_linenumber")


@query("wn17_round_robin", "WITH r AS (SELECT s_suppkey, s_nationkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256(CAST(s_suppkey AS STRING) || ':17')) AS turn FROM supplier) SELECT s_suppkey, turn, s_nationkey AS pool FROM r")
def _(spark, sf_dir):
    w = Window.partitionBy("s_nationkey").orderBy(lookups.hash_rank("s_suppkey", seed=17))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.row_number().over(w).cast("long").alias("turn"), F.col("s_nationkey").alias("pool"))
