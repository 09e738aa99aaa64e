"""Overlaps of closed intervals with their rows.

Each interval lies on the level of bins that is just as wide as it is long, so it touches two bins there at most. A pair
meets on the level of its longer interval, which fills half a bin or more: what a bin compares is then of the order of
what it returns, whatever mixture of lengths the tables hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import lookups, ordered


def _level(start: Column, stop: Column) -> Column:
    return F.ceil(F.log2((stop - start + 1).cast("double"))).cast("int")


def _bins(start: Column, stop: Column, level: Column) -> Column:
    width = F.pow(F.lit(2.0), level)
    return F.explode(F.sequence(F.floor(start / width), F.floor(stop / width)))


def overlap_pairs(left: DataFrame, right: DataFrame, by: tuple[str, ...] = (), start: str = "start", stop: str = "stop") -> DataFrame:
    """Every pair of a left and a right interval that share a position; right's columns other than by are called r_*.

    Nulls in keys or ends, and intervals that stop before they start, meet nothing. Ends are whole numbers.
    """
    names = {c: f"r_{c}" for c in right.columns if c not in by}
    a = left.where(F.col(start) <= F.col(stop)).withColumn("_lev", _level(F.col(start), F.col(stop)))
    r0, r1 = f"r_{start}", f"r_{stop}"
    b = right.withColumnsRenamed(names).where(F.col(r0) <= F.col(r1)).withColumn("_r_lev", _level(F.col(r0), F.col(r1)))
    levels = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731 - 64 at most
    la, lb = levels(a, "_lev"), levels(b, "_r_lev")
    if not la or not lb:
        return a.join(b, list(by), "inner").where(F.lit(False)).drop("_lev", "_r_lev") if by else a.crossJoin(b.limit(0)).drop("_lev", "_r_lev")
    up = lambda own, there, least: F.explode(F.filter(F.array(*(F.lit(v) for v in there)), lambda v: v >= F.col(own) + least))

    def met(x: DataFrame, y: DataFrame) -> DataFrame:
        pairs = x.join(y, [*by, "_m", "_bin"])
        overlap = (F.col(start) <= F.col(r1)) & (F.col(r0) <= F.col(stop))
        return pairs.where(overlap & (F.col("_bin") == F.floor(F.greatest(F.col(start), F.col(r0)) / F.pow(F.lit(2.0), F.col("_m"))))).drop("_m", "_bin", "_lev", "_r_lev")

    at = lambda df, s, e: df.withColumn("_bin", _bins(F.col(s), F.col(e), F.col("_m")))
    long_left = met(at(a.withColumn("_m", F.col("_lev")), start, stop), at(b.withColumn("_m", up("_r_lev", la, 0)), r0, r1))
    long_right = met(at(a.withColumn("_m", up("_lev", lb, 1)), start, stop), at(b.withColumn("_m", F.col("_r_lev")), r0, r1))
    return long_left.unionByName(long_right)


def with_overlap_flag(left: DataFrame, right: DataFrame, by: tuple[str, ...], stretch: float, flag: str = "overlaps", start: str = "start", stop: str = "stop") -> DataFrame:
    """left with whether any right interval of its key (type, chromosome) overlaps it; no pair is made.

    Those that start by its end, less those that ended before its start; running counts by position, two as-of joins.
    """
    r = right.where(F.col(start) <= F.col(stop))

    def so_far(end: str, name: str) -> DataFrame:
        g = ordered.running(r.groupBy(*by, F.col(end).alias("_at")).agg(F.count("*").alias("n")), "_at", ["n"], by)
        return g.select(*by, "_at", (F.col("before_n") + F.col("n")).alias(name))

    l = left.withColumn("_at", F.col(stop))  # noqa: E741
    l = lookups.last_at_or_before(l, so_far(start, "_started"), "_at", ["_started"], by, width=stretch).drop("mark_at")  # noqa: E741
    l = lookups.last_at_or_before(l.withColumn("_at", F.col(start) - 1), so_far(stop, "_ended"), "_at", ["_ended"], by, width=stretch)  # noqa: E741
    # a null key meets nothing, and keeps its row
    keyless = left.where(" or ".join(f"{c} is null" for c in by)).withColumn(flag, F.lit(False)) if by else left.limit(0).withColumn(flag, F.lit(False))
    told = l.withColumn(flag, (F.col(start) <= F.col(stop)) & (F.coalesce("_started", F.lit(0)) > F.coalesce("_ended", F.lit(0)))).drop("_at", "mark_at", "_started", "_ended")
    return told.unionByName(keyless)


def expand_blocks(blocks: DataFrame, loci: DataFrame, by: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """A row for each locus inside each block (start, stop): the block's columns, then the locus' as r_*."""
    points = loci.withColumns({"start": F.col(pos), "stop": F.col(pos)})
    return overlap_pairs(blocks, points, by).drop("r_start", "r_stop")
