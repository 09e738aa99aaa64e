"""Connected components of a graph too large for the driver: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): each node of edges (a, b) with the least node it can reach.

    A round links every node's larger neighbours, then its smaller ones, to the least of its neighbourhood, until nothing
    changes; the number of rounds is about the logarithm of the longest path. Minima are partial aggregates, written so that
    the joins with them read plain exchanges, which adaptive execution splits where a node has very many edges. Each round
    is written to the shared folder, which cuts the lineage; the round before it is deleted.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")))
        large = scratch.table(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where("a > b").distinct())
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        new = scratch.table(
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        scratch.drop(now, least, large)
        now, after = new, _state(new)
        if after == before:
            break
        before = after
    # every node now hangs on the least one of its component
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
