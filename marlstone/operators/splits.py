"""Deterministic splits and samples: order by a hash of id and seed, never by arrival.

Global ranks go through range partitions (operators.ordered), so no task sorts all ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.lookups import hash_rank
from marlstone.operators.ordered import running


def hash_positions(ids: DataFrame, key: str, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """ids (unique within by) with _rn, the zero-based place in hash order within by, and _n, how many there are."""
    h = hash_rank(key, seed=seed)
    # the first 60 bits order the ranges; equal ones (never at these sizes, but defined) are ordered by the whole hash
    keyed = ids.withColumn("_h", F.conv(F.substring(h, 1, 15), 16, 10).cast("long")).withColumn("_full", h)
    groups = running(keyed.groupBy(*by, "_h").agg(F.count("*").alias("n")), "_h", ["n"], by).select(*by, "_h", "before_n", "all_n")
    w = Window.partitionBy(*by, "_h").orderBy("_full")
    return keyed.join(groups, [*by, "_h"]).withColumn("_rn", F.col("before_n") + F.row_number().over(w) - 1).withColumn("_n", F.col("all_n")).drop("_h", "_full", "before_n", "all_n")


def group_split(groups: DataFrame, key: str, seed: int, train: float = 0.8, validation: float = 0.1) -> DataFrame:
    """(key, split): whole groups in train, validation or test."""
    r = hash_positions(groups, key, seed)
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * validation)
    split = F.when(F.col("_rn") < a, "train").when(F.col("_rn") < a + b, "validation").otherwise("test")
    return r.select(key, split.alias("split"))


def held_out(ids: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """(key, held_out): a half-even share of the ids, one at least."""
    r = hash_positions(ids, key, seed)
    return r.select(key, (F.col("_rn") < F.greatest(F.bround(F.col("_n") * share), F.lit(1))).alias("held_out"))


def block_folds(blocks: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """(key, fold): blocks dealt out in hash order."""
    return hash_positions(blocks, key, seed).select(key, (F.col("_rn") % folds).cast("int").alias("fold"))


def stratified(rows: DataFrame, key: str, stratum: str, share: float, seed: int) -> DataFrame:
    """(key, split): a test share of each stratum; what rounding leaves goes to the largest remainders."""
    q = rows.groupBy(stratum).agg((F.count("*") * F.lit(share)).alias("want")).withColumn("base", F.floor("want"))
    extra = q.agg((F.bround(F.sum("want")) - F.sum("base")).cast("long").alias("extra"))
    order = Window.orderBy(F.desc(F.col("want") - F.col("base")), stratum)  # one row a stratum
    quota = q.crossJoin(F.broadcast(extra)).withColumn("quota", F.col("base") + (F.row_number().over(order) <= F.col("extra")).cast("int"))
    r = hash_positions(rows, key, seed, (stratum,))
    return r.join(quota.select(stratum, "quota"), stratum).select(key, F.when(F.col("_rn") < F.col("quota"), "test").otherwise("train").alias("split"))


def leaks(assigned: DataFrame, group: str, split: str) -> DataFrame:
    """(group, splits): groups whose rows lie in more than one split; rows without a group or split don't count."""
    held = assigned.where(F.col(group).isNotNull() & F.col(split).isNotNull())
    return held.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def interleaved(rows: DataFrame, key: str, pool: str, seed: int) -> DataFrame:
    """(key, pool, turn, place): pools in hash order dealt out one row a turn, pools by name within a turn; place counts from 0.

    A turn has a row a pool at most; places come from running counts of the turns."""
    dealt = hash_positions(rows.select(key, pool), key, seed, (pool,)).select(key, pool, F.col("_rn").alias("turn"))
    before = running(dealt.groupBy("turn").agg(F.count("*").alias("n")), "turn", ["n"]).select("turn", "before_n")
    within = F.row_number().over(Window.partitionBy("turn").orderBy(pool)) - 1
    return dealt.withColumn("_w", within).join(before, "turn").select(key, pool, "turn", (F.col("before_n") + F.col("_w")).alias("place"))
