"""Writers with guards, resumption and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def guarded(df: DataFrame, path: str, root: str, frozen: tuple[str, ...] = (), partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Write Parquet below root only, never below a frozen folder."""
    clean = path.rstrip("/")
    if ".." in clean.split("/") or not clean.startswith(root.rstrip("/") + "/"):
        raise ValueError(f"{path} is outside {root}")
    if any(clean == f.rstrip("/") or clean.startswith(f.rstrip("/") + "/") for f in frozen):
        raise ValueError(f"{path} is frozen")
    df.write.mode(mode).option("compression", "zstd").partitionBy(*partition_by).parquet(clean)


def resume(df: DataFrame, path: str, key: str) -> DataFrame:
    """Rows of df whose key is not in the Parquet table at path yet (all of them, where there is none)."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        done.schema  # noqa: B018
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return df
    return df.join(done, key, "left_anti")


def manifest(df: DataFrame, *keys: str) -> DataFrame:
    """(rows, fingerprint): an order-free content hash of a table, one row."""
    h = F.xxhash64(*sorted(df.columns))
    return df.agg(F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("total"), F.bit_xor(F.xxhash64(F.lit(1), *sorted(df.columns))).alias("mixed")).select(
        "rows", F.sha2(F.concat_ws(":", "rows", "total", "mixed").cast("binary"), 256).alias("fingerprint")
    )


def verify_or_create(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """A protocol table written once; a later run must bring the same rows."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.parquet(path)
        return spark.read.parquet(path)
    if manifest(old).first() != manifest(df).first():
        raise ValueError(f"{path} holds another protocol")
    return old


def fresh_folder(spark: SparkSession) -> str:
    """A new folder's name below the one that driver and executors share (spark.checkpoint.dir; a local master may do without)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written to a fresh folder and read again: for a table that several branches of a plan read."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_matrix(values: DataFrame, path: str) -> None:
    """A long matrix (chrom, sample, locus, beta), a row for each cell: cells with several probes hold their mean."""
    cells = values.groupBy("chrom", "sample", "locus").agg(F.avg("beta").alias("beta"), F.count("beta").alias("probes"))
    cells.write.option("compression", "zstd").partitionBy("chrom").parquet(path)


def text_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV or TSV parts with a header."""
    df.write.option("header", True).option("sep", sep).csv(path)


def markdown(df: DataFrame, most_rows: int) -> str:
    """A small table as Markdown, rows in order of all columns; more rows than most_rows are an error."""
    rows = df.orderBy(*df.columns).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"over {most_rows} rows are no report")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), "|" + "-|" * len(df.columns), *map(line, rows)])
