"""Components of a threshold graph, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the folder that the cluster names; one is set only where none is (tests)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(root or "/tmp/checkpoints")
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each id of nodes reaches over edges (a, b)."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("id", F.col("id").alias("component")).distinct())
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = labels.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(jump, "component").select("id", F.least("component", "up").alias("component")))
        changed = new.join(labels.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count()
        labels = new
        if not changed:
            break
    return labels
