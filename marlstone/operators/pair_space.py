"""Samples from spaces of pairs that are never listed.

The pairs of a group are numbered by running counts: how many pairs earlier members have, and where a member's partners start.
Numbers are drawn by hash, and only the drawn pairs are looked up.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import lookups, ordered
from marlstone.operators.bootstrap import drawn
from marlstone.operators.graph import cut

#: Numbers drawn for each one wanted, and on top: each new draw is new with a chance of a half at least, so a shortfall is
#: as good as impossible (under 1e-9); it is an error all the same.
DRAWS, MORE = 4, 64


def places(df: DataFrame, order: str, by: tuple[str, ...], name: str, total: str) -> DataFrame:
    """df (order: a number, unique within by) with the zero-based place of each row within by, and how many there are."""
    return ordered.running(df.withColumn("_one", F.lit(1)), order, ["_one"], by).withColumnsRenamed({"before__one": name, "all__one": total}).drop("_one")


def capped_products(left: DataFrame, right: DataFrame, by: str, left_id: str, right_id: str, most: int, seed: int) -> DataFrame:
    """(by, left_id, right_id): up to `most` pairs of each group, all where there are no more, a uniform sample otherwise.

    Numbers without repetition come from Floyd's method: a fold over `most` steps. Ids are numbers, unique within a group.
    """
    a, b = places(left.select(by, left_id), left_id, (by,), "_i", "_n"), places(right.select(by, right_id), right_id, (by,), "_j", "_m")
    sizes = a.groupBy(by).agg(F.first("_n").alias("_n")).join(b.groupBy(by).agg(F.first("_m").alias("_m")), by).withColumn("_all", F.col("_n").cast("long") * F.col("_m"))
    step = lambda acc, j: F.when(F.array_contains(acc, drawn(j + 1, F.lit(seed), F.col(by), j)), F.array_append(acc, j)).otherwise(F.array_append(acc, drawn(j + 1, F.lit(seed), F.col(by), j)))
    floyd = F.aggregate(F.sequence(F.col("_all") - most, F.col("_all") - 1), F.array().cast("array<bigint>"), step)
    picks = F.when(F.col("_all") > most, floyd).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1))
    chosen = sizes.select(by, "_m", F.explode(picks).alias("_t")).select(by, F.expr("_t div _m").alias("_i"), (F.col("_t") % F.col("_m")).alias("_j"))
    return chosen.join(a.select(by, left_id, "_i"), [by, "_i"]).join(b.select(by, right_id, "_j"), [by, "_j"]).select(by, left_id, right_id)


def drawn_numbers(sizes: DataFrame, by: str, total: str, wanted: int, seed: int) -> DataFrame:
    """(by, number): `wanted` different numbers below total for each row of sizes; all of them where there are no more."""
    few = F.col(total) <= 2 * wanted
    all_ = F.transform(F.sequence(F.lit(0).cast("long"), F.col(total) - 1), lambda t: F.struct(drawn(1 << 40, F.lit(seed), F.lit("order"), F.col(by), t).alias("o"), t.alias("number")))
    some = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(DRAWS * wanted + MORE - 1).cast("long")), lambda t: F.struct(t.alias("o"), drawn(F.col(total), F.lit(seed), F.col(by), t).alias("number")))
    long = sizes.where(F.col(total) > 0).select(by, total, F.explode(F.when(few, all_).otherwise(some)).alias("_s")).select(by, total, "_s.*")
    first = long.groupBy(by, total, "number").agg(F.min("o").alias("o"))
    # a group is a few draws for each wanted pair, whatever the size of its space
    ranked = first.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("o", "number"))).withColumn("_c", F.count("*").over(Window.partitionBy(by)))
    enough = F.when(F.col("_c") >= F.least(F.col(total), F.lit(wanted)), F.col("_r")).otherwise(F.raise_error(F.lit("too few different draws")).cast("int"))
    return ranked.where(enough <= wanted).select(by, "number")


def binned_pairs(points: DataFrame, edges: list[float], wanted: int, seed: int, stretch: float) -> DataFrame:
    """(i, j, bin, distance): up to `wanted` unordered pairs of one chromosome in each distance bin [edge, next edge).

    points: (id, chrom, pos), whole positions, unique numeric ids. i is the lesser id; a last edge of infinity is open.
    stretch is a length of axis that a task sorts. Pairs of a bin are numbered by (id, position, id of the partner).
    """
    p = points.select("id", "chrom", "pos")
    # places along a chromosome by (pos, id): running counts of distinct positions, then ids within one
    at = p.groupBy("chrom", "pos").agg(F.count("*").alias("n"))
    run = ordered.running(at, "pos", ["n"], ("chrom",)).select("chrom", "pos", "before_n", "all_n", "n")
    inside = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy("id")) - 1
    run = cut(run)
    numbered = cut(p.withColumn("_in", inside).join(run, ["chrom", "pos"]).select("chrom", "id", "pos", (F.col("before_n") + F.col("_in")).alias("place"), "all_n"))
    # how many points lie below pos + edge, for all edges at once
    asks = numbered.withColumn("_e", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(e)).alias("e")) for k, e in enumerate(edges) if not math.isinf(e)))))
    asks = asks.select("chrom", "id", "_e.k", F.col("pos").alias("_from"), (F.ceil(F.col("pos") + F.col("_e.e")) - 1).cast(points.schema["pos"].dataType).alias("pos"))
    below = lookups.last_at_or_before(asks, run.select("chrom", "pos", (F.col("before_n") + F.col("n")).alias("below")), "pos", ["below"], ("chrom",), width=stretch)
    reach = below.groupBy("chrom", "id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.coalesce("below", F.lit(0)).alias("v")))).alias("_b"))  # an entry an edge
    end = lambda k: F.col("all_n") if math.isinf(edges[k]) else F.col("_b")[k]
    bins = F.explode(F.array(*(F.struct(F.lit(k).alias("bin"), F.greatest(F.col("place") + 1, F.col("_b")[k]).alias("first"), end(k + 1).alias("last")) for k in range(len(edges) - 1))))
    spans = numbered.join(reach, ["chrom", "id"]).select("chrom", "id", "pos", bins.alias("_s")).select("chrom", "id", "pos", "_s.*", (F.col("_s.last") - F.col("_s.first")).alias("cnt")).where("cnt > 0")
    spans = cut(spans)
    counted = ordered.running(spans, "id", ["cnt"], ("bin",))
    sizes = spans.groupBy("bin").agg(F.sum("cnt").alias("total"))
    most = sizes.agg(F.max("total")).first()[0]
    picks = drawn_numbers(sizes, "bin", "total", wanted, seed).withColumnRenamed("number", "at")
    marks = counted.select("bin", F.col("before_cnt").alias("at"), "chrom", F.col("id").alias("i"), F.col("pos").alias("_pi"), "first")
    hit = lookups.last_at_or_before(picks, marks, "at", ["chrom", "i", "_pi", "first"], ("bin",), width=max(1.0, (most or 1) / ordered.RANGES))
    partner = numbered.select("chrom", F.col("place"), F.col("id").alias("j"), F.col("pos").alias("_pj"))
    pairs = hit.withColumn("place", F.col("first") + F.col("at") - F.col("mark_at")).join(partner, ["chrom", "place"])
    return pairs.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "bin", (F.col("_pj") - F.col("_pi")).alias("distance"))


def crossing_pairs(points: DataFrame, wanted: int, seed: int) -> DataFrame:
    """(i, j): up to `wanted` unordered pairs of points of different chromosomes. points: (id, chrom), unique numeric ids.

    Chromosomes (a few thousand at most: their table is sorted whole) stand in order; a point pairs with all of later ones.
    """
    numbered = places(points.select("id", "chrom"), "id", ("chrom",), "place", "n")
    order = Window.orderBy("chrom")
    c = numbered.groupBy("chrom").agg(F.first("n").cast("long").alias("n")).withColumn("end", F.sum("n").over(order))
    c = c.withColumn("later", F.max("end").over(Window.partitionBy(F.lit(0))) - F.col("end")).withColumn("cnt", F.col("n") * F.col("later"))
    c = c.withColumn("start", F.sum("cnt").over(order) - F.col("cnt")).withColumn("one", F.lit(0))
    sizes = c.groupBy("one").agg(F.sum("cnt").alias("total"))
    picks = drawn_numbers(sizes, "one", "total", wanted, seed).withColumnRenamed("number", "at")
    hit = lookups.last_at_or_before(picks, c.where("cnt > 0").select("one", F.col("start").alias("at"), "chrom", "later", "end"), "at", ["chrom", "later", "end"], ("one",))
    away = F.col("at") - F.col("mark_at")
    hit = hit.select(F.col("chrom").alias("_c"), away.alias("_a"), "later", "end").select("_c", F.expr("_a div later").alias("_p"), (F.col("end") + F.col("_a") % F.col("later")).alias("at")).withColumn("one", F.lit(0))
    # the partner's place among all chromosomes back to its own
    hit = lookups.last_at_or_before(hit, c.select("one", (F.col("end") - F.col("n")).alias("at"), F.col("chrom").alias("_d")), "at", ["_d"], ("one",)).withColumn("_q", F.col("at") - F.col("mark_at"))
    side = lambda name, chrom, place: numbered.select(F.col("id").alias(name), F.col("chrom").alias(chrom), F.col("place").alias(place))
    got = hit.join(side("_i", "_c", "_p"), ["_c", "_p"]).join(side("_j", "_d", "_q"), ["_d", "_q"])
    return got.select(F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"))
