"""Resumable materialisation: chunks in side folders, committed by one ledger row each."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources.sinks import manifest

LEDGER = "chunk string, folder string, rows long, content string, inputs string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: a row a chunk (the least folder's, should two writers have committed one chunk)."""
    where = f"{path.rstrip('/')}/ledger"
    rows = spark.read.schema(LEDGER).parquet(where) if _exists(spark, where) else spark.createDataFrame([], LEDGER)
    return rows.groupBy("chunk").agg(F.min_by(F.struct("folder", "rows", "content", "inputs"), "folder").alias("r")).select("chunk", "r.*")


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    """One row in one file: Spark's committer renames it into place whole, or not at all."""
    spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(f"{path.rstrip('/')}/ledger")


def materialise(df: DataFrame, chunk: str, path: str, inputs: str) -> DataFrame:
    """Write df chunk by chunk below path, passing over chunks that are committed; returns the whole table as read back.

    inputs is a fingerprint of whatever df is made from: a ledger of another one is an error, before anything is written. A run
    that ends between a chunk's files and its ledger row leaves a folder that nobody reads, and a rerun writes the chunk
    again: no row is lost or read twice. Chunks (not null) are the unit of loss, a few hundred at most.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    done = {r.chunk: r for r in committed(spark, path).collect()}
    if other := sorted({r.inputs for r in done.values()} - {inputs}):
        raise ValueError(f"{path} was begun from other inputs: {other[0]}")
    wanted = [r[0] for r in df.select(F.col(chunk).cast("string")).distinct().orderBy(chunk).limit(10_001).collect()]
    if len(wanted) > 10_000 or None in wanted:
        raise ValueError("chunks are at most 10,000, and not null")
    for c in wanted:
        if c in done:
            continue
        folder = f"{path}/data/{uuid.uuid4().hex}"
        df.where(F.col(chunk).cast("string") == c).write.option("compression", "zstd").parquet(folder)
        told = manifest(spark.read.schema(df.schema).parquet(folder)).first()
        _commit(spark, path, (c, folder, told.rows, told.fingerprint, inputs))
    return read(spark, path, df.schema)


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The committed chunks of a table, and nothing else that lies in its folder."""
    folders = [r.folder for r in committed(spark, path).select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def verify(spark: SparkSession, path: str, schema) -> list[str]:
    """Chunks whose files no longer hold what their ledger row says."""
    return [r.chunk for r in committed(spark, path).collect() if tuple(manifest(spark.read.schema(schema).parquet(r.folder)).first()) != (r.rows, r.content)]
