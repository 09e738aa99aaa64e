"""Key and coverage contracts. A broken contract is an error of the job, raised where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(df: DataFrame, counts: DataFrame, bad: Column, message: str) -> DataFrame:
    """df, joined with one row of counts that raises if bad holds."""
    check = counts.select(F.when(bad, F.raise_error(F.lit(message)).cast("int")).otherwise(F.lit(0)).alias("_ok"))
    return df.crossJoin(F.broadcast(check)).where("_ok = 0").drop("_ok")


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df; an error where a key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("n"))
    return _checked(df, twice, F.col("n") > 0, f"duplicate key {', '.join(keys)}")


def require_present(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """df; an error where other lacks one of its keys."""
    absent = df.join(other.select(*keys).distinct(), list(keys), "left_anti").agg(F.count("*").alias("n"))
    return _checked(df, absent, F.col("n") > 0, f"key {', '.join(keys)} not found")


def require_disjoint(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    both = df.select(*keys).intersect(other.select(*keys)).agg(F.count("*").alias("n"))
    return _checked(df, both, F.col("n") > 0, f"keys {', '.join(keys)} overlap")


def require_columns(df: DataFrame, allowed: list[str], wanted: list[str]) -> DataFrame:
    """The wanted columns, if all are on the allow-list."""
    refused = [c for c in wanted if c not in allowed]
    if refused:
        raise ValueError(f"columns not allowed: {refused}")
    return df.select(*wanted)
