"""Joins by key under cardinality contracts, and positional joins that Catalyst can hash or sort.

Positional joins get an equality key (a bin of the axis, or an event's place in one ordered union), so none becomes a
nested loop. Bins hold bounded stretches of the axis; a hot chromosome is many bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.contracts import require_present, require_unique


def strict_lookup(ids: DataFrame, axis: DataFrame, key: str) -> DataFrame:
    """ids with the axis' columns; an error for ids that the axis lacks or has twice."""
    return require_present(ids, axis, key).join(require_unique(axis, key), key)


def lenient_lookup(ids: DataFrame, axis: DataFrame, key: str, flag: str = "found") -> DataFrame:
    return ids.join(axis.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _of_width(vector: str, width: int):
    """The vector; an error where it has another width."""
    v = F.col(vector)
    fault = F.raise_error(F.concat(F.lit(f"a vector of width {width} was expected, not "), F.size(v).cast("string")))
    return F.when(v.isNull() | (F.size(v) == width), v).otherwise(fault.cast("array<float>"))


def aligned_gather(axis: DataFrame, store: DataFrame, key: str, vector: str, width: int, fill: bool = False) -> DataFrame:
    """axis with the store's vector of each of its rows and `covered`: false where the store lacks the key or has no vector.

    Without a vector a row holds null, or zeros with fill. Keys stand once in the store; axis rows may repeat, and all stay.
    """
    held = require_unique(store.select(key, vector), key)
    got = axis.join(held.withColumn(vector, _of_width(vector, width)), key, "left").withColumn("covered", F.col(vector).isNotNull())
    return got.withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(0).cast("float"), width))) if fill else got


def strict_gather(ids: DataFrame, store: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """ids (repeats stay) with the store's vectors: an error for a key that the store lacks, or whose vector is null, not
    finite or of another width. Nothing is left out.
    """
    v = F.col(vector)
    sound = F.coalesce(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    fault = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" has no finite vector"))).cast("array<float>")
    got = aligned_gather(ids, store, key, vector, width).drop("covered")
    return got.withColumn(vector, F.when(sound, v).otherwise(fault))


def one_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    return require_unique(left, key).join(require_unique(right, key), key, how)


def paired_outer(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The full outer one-to-one join under a contract: a key that only one side has is an error, named with its side."""
    a, b = require_unique(left, key).withColumn("_l", F.lit(True)), require_unique(right, key).withColumn("_r", F.lit(True))
    both = a.join(b, key, "full")
    side = F.when(F.col("_r").isNull(), F.lit("left")).otherwise(F.lit("right"))
    fault = F.raise_error(F.concat(F.lit(f"{key} "), F.col(key).cast("string"), F.lit(" is only on the "), side)).cast("boolean")
    return both.where(F.when(F.col("_l") & F.col("_r"), F.lit(True)).otherwise(fault)).drop("_l", "_r")


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) for keys with exactly one distinct value."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("_k"), F.min(value).alias(value)).where("_k = 1").drop("_k")


def collapsed(df: DataFrame, key: str, value: str, sep: str = "") -> DataFrame:
    """(key, value): the sorted distinct values of a key, joined."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(value))


def last_at_or_before(points: DataFrame, marks: DataFrame, at: str, payload: list[str], by: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """As-of join: points with the payload of the latest mark at or before them (marks have `at`, payload and by).

    width cuts the axis into stretches; windows stay inside a stretch and one row a stretch carries the rest over.
    """
    both = points.withColumn("_side", F.lit(1)).unionByName(marks.select(*by, at, *payload).withColumn("_side", F.lit(0)), allowMissingColumns=True)
    both = both.withColumn("_b", F.floor(F.col(at).cast("double") / width) if width else F.lit(0))
    mark = F.when(F.col("_side") == 0, F.struct(at, *payload))
    inside = Window.partitionBy(*by, "_b").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last(mark, ignorenulls=True).over(inside)).where("_side = 1")
    # marks alone are sorted for their latest; points only say which stretches there are
    latest = both.where("_side = 0").groupBy(*by, "_b").agg(F.max(F.struct(at, *payload)).alias("_end"))
    ends = both.where("_side = 1").select(*by, "_b").distinct().join(latest, [*by, "_b"], "full")
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_b", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    got = own.drop(*payload).join(carried, [*by, "_b"])
    pick = F.coalesce("_own", "_carried")
    return got.select(*(c for c in points.columns), pick[at].alias("mark_at"), *(pick[p].alias(p) for p in payload))


def overlapping(left: DataFrame, right: DataFrame, bin_size: int, by: tuple[str, ...] = (), start: str = "start", stop: str = "stop") -> DataFrame:
    """Pairs of closed intervals that overlap; right's columns other than by are called r_*.

    Both sides stand once in every bin they touch; a pair counts in the first bin that both touch.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor(F.col(e) / bin_size)))
    names = {c: f"r_{c}" for c in right.columns if c not in by}
    r = right.withColumnsRenamed(names).withColumn("_bin", bins(f"r_{start}", f"r_{stop}"))
    pairs = left.withColumn("_bin", bins(start, stop)).join(r, [*by, "_bin"])
    first = F.floor(F.greatest(start, f"r_{start}") / bin_size)
    return pairs.where((F.col(start) <= F.col(f"r_{stop}")) & (F.col(f"r_{start}") <= F.col(stop)) & (F.col("_bin") == first)).drop("_bin")


def within(left: DataFrame, right: DataFrame, tolerance: int, by: tuple[str, ...] = (), pos: str = "pos") -> DataFrame:
    """Pairs of points at most tolerance apart; right's columns other than by are called r_*."""
    size = tolerance + 1
    names = {c: f"r_{c}" for c in right.columns if c not in by}
    r = right.withColumnsRenamed(names)
    r = r.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"r_{pos}") / size) - 1, F.floor(F.col(f"r_{pos}") / size) + 1)))
    return left.withColumn("_bin", F.floor(F.col(pos) / size)).join(r, [*by, "_bin"]).where(F.abs(F.col(pos) - F.col(f"r_{pos}")) <= tolerance).drop("_bin")


def hash_rank(*parts: Column | str, seed: int) -> Column:
    """A total order that looks random: the hexadecimal sha256 of the parts and the seed."""
    return F.sha2(F.concat_ws(":", *parts, F.lit(seed)).cast("binary"), 256)
