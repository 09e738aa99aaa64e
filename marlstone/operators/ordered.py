"""Running totals, ranks and percent points over whole columns without one task that sees every row.

Rows with equal keys are added up first; the distinct keys are dealt out by ranges whose bounds are quantiles of the
table; totals run inside each range, and what earlier ranges hold comes from one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.sources import sinks

#: Ranges at least, and at most; between them as many as the session has shuffle partitions, which follow the data.
RANGES, MOST_RANGES = 64, 512


def _ranges(df: DataFrame, ranges: int | None) -> int:
    return ranges or max(RANGES, min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _bounds(key: str, ranges: int) -> Column:
    return F.percentile_approx(key, F.array(*(F.lit(i / ranges) for i in range(1, ranges))), 10_000)


def place(bounds: Column, key: Column, most: int) -> Column:
    """How many of the sorted bounds, `most` or fewer, lie below key; found by halving."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(most.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda p, step: F.when(F.get(bounds, p + step - 1) < key, p + step).otherwise(p))


def running(df: DataFrame, key: str, values: list[str], by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """df (one row a key within by) with before_<v>: the sum of v over smaller keys, and all_<v>: over all keys of by."""
    ranges = _ranges(df, ranges)
    bounds = df.agg(_bounds(key, ranges).alias("_bounds"))
    dealt = df.crossJoin(F.broadcast(bounds)).withColumn("_range", place(F.col("_bounds"), F.col(key), ranges)).drop("_bounds")
    sums = dealt.groupBy(*by, "_range").agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sums.select(
        *by,
        "_range",
        *(F.coalesce(F.sum(f"_t_{v}").over(earlier), F.lit(0)).alias(f"_o_{v}") for v in values),
        *(F.sum(f"_t_{v}").over(whole).alias(f"all_{v}") for v in values),
    )
    inside = Window.partitionBy(*by, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    part = dealt.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_w_{v}") for v in values))
    out = part.join(offsets, [*by, "_range"])
    for v in values:
        out = out.withColumn(f"before_{v}", F.col(f"_o_{v}") + F.col(f"_w_{v}"))
    return out.drop("_range", *(f"_o_{v}" for v in values), *(f"_w_{v}" for v in values))


def tie_groups(df: DataFrame, value: str, by: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """A row for each distinct value within by: n rows, the given sums, and their running totals."""
    groups = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in sums.items()))
    return running(groups, value, ["n", *sums], by)


def mid_ranks(df: DataFrame, value: str, name: str = "mid_rank", by: tuple[str, ...] = ()) -> DataFrame:
    """df with the average rank of value; rows without a value have none."""
    ranks = tie_groups(df, value, by).select(*by, value, (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranks, [*by, value], "left")


def ranks_in_sets(df: DataFrame, values: dict[str, str], sets: str, count: int, by: tuple[str, ...] = (), ranges: int | None = None) -> DataFrame:
    """df with the average ranks of its values (value: name of its ranks), one rank for each set that the row lies in.

    sets: an array of numbers below count; a row has one rank for each of them, in that order, among the rows of by and set.
    Rows lacking a value are left out. A row is shuffled once a value, whatever the number of its sets. A value that is a
    bound of the ranges has its count as a whole, so its rows are dealt out freely and no range holds a frequent value.
    by and sets are few: what is broadcast is a row for each range of by, 2 x count numbers. df is read twice; what it is
    dealt into is written.
    """
    ranges = _ranges(df, ranges)
    held = df.where(" and ".join(f"{v} is not null" for v in values)).withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(4096)).cast("int"))
    bounds = held.agg(*(_bounds(v, ranges).alias(f"_bounds_{v}") for v in values))
    out = held.crossJoin(F.broadcast(bounds))  # one row
    for v in values:
        at = F.col(f"_place_{v}")
        out = out.withColumn(f"_place_{v}", place(F.col(f"_bounds_{v}"), F.col(v), ranges))
        out = out.withColumn(f"_range_{v}", 2 * at + F.coalesce((F.get(f"_bounds_{v}", at) == F.col(v)).cast("int"), F.lit(0))).drop(f"_place_{v}", f"_bounds_{v}")
    out = sinks.written(out)  # read for the totals of the ranges and for the ranks
    inside = [F.array_contains(sets, k).cast("int") for k in range(count)]
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = {}
    for v in values:
        sums = out.groupBy(*by, F.col(f"_range_{v}").alias("_range")).agg(*(F.sum(c).alias(f"_n{k}") for k, c in enumerate(inside)))
        before = F.array(*(F.coalesce(F.sum(f"_n{k}").over(earlier), F.lit(0)) for k in range(count)))
        offsets[v] = sums.select(*by, F.col("_range").alias(f"_range_{v}"), before.alias("_before"), F.array(*(f"_n{k}" for k in range(count))).alias("_own"))
    for v, name in values.items():
        tied = F.col(f"_range_{v}") % 2 == 1
        part = out.withColumn("_part", F.when(tied, F.col("_salt")).otherwise(0)).repartition(*by, f"_range_{v}", "_part")
        w = Window.partitionBy(*by, f"_range_{v}", "_part")
        upto, alike = w.orderBy(v).rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*by, f"_range_{v}", "_part", v)
        told = part.select("*", F.array(*(F.sum(c).over(upto) for c in inside)).alias("_upto"), F.array(*(F.sum(c).over(alike) for c in inside)).alias("_alike"))
        got = told.join(F.broadcast(offsets[v]), [*by, f"_range_{v}"])
        of = lambda c, k: F.get(F.col(c), k)
        whole = F.transform(sets, lambda k: of("_before", k) + (of("_own", k) + 1) / 2)
        single = F.transform(sets, lambda k: of("_before", k) + of("_upto", k) - (of("_alike", k) - 1) / 2)
        out = got.withColumn(name, F.when(tied, whole).otherwise(single)).drop("_before", "_own", "_upto", "_alike", "_part", f"_range_{v}")
    return out.drop("_salt")


def auroc(df: DataFrame, score: str, positive: Column, by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by, auroc): the chance that a positive's score is above a negative's, ties as half; null without both classes."""
    w = F.lit(1.0) if weight is None else weight
    g = tie_groups(df, score, by, pos=F.when(positive, w).otherwise(F.lit(0.0)), neg=F.when(positive, F.lit(0.0)).otherwise(w))
    won = F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2))
    return g.groupBy(*by).agg((won / F.nullif(F.first("all_pos") * F.first("all_neg"), F.lit(0.0))).alias("auroc"))


def ks_distance(df: DataFrame, value: str, first: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, ks): the largest gap between the distribution functions of two groups of rows."""
    g = tie_groups(df, value, by, a=F.when(first, 1).otherwise(0), b=F.when(first, 0).otherwise(1))
    at = lambda c: (F.col(f"before_{c}") + F.col(c)) / F.nullif(F.col(f"all_{c}"), F.lit(0))
    return g.groupBy(*by).agg(F.max(F.abs(at("a") - at("b"))).alias("ks"))


def quantiles(df: DataFrame, value: str, points: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, quantiles): exact quantiles with linear interpolation, from the running totals; nulls don't count."""
    g = tie_groups(df, value, by)
    picks = []
    for k, q in enumerate(points):
        at = (F.col("all_n") - 1) * q
        holds = lambda place: F.max(F.when((F.col("before_n") <= place) & (place < F.col("before_n") + F.col("n")), F.col(value)))
        picks += [holds(F.floor(at)).alias(f"_lo{k}"), holds(F.ceil(at)).alias(f"_hi{k}"), F.max(at - F.floor(at)).alias(f"_part{k}")]
    got = g.groupBy(*by).agg(*picks)
    return got.select(*by, F.array(*(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_part{k}") for k in range(len(points)))).alias("quantiles"))
