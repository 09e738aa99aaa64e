"""Readers of the file formats of measurement, annotation and run tables. Each returns a lazy DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions.coords import nullable_chromosome
from marlstone.operators.contracts import require_unique


def beta_long(spark: SparkSession, path: str, sample: str = "sample_name", locus: str = "cpg_idx", value: str = "beta") -> DataFrame:
    """Measurement matrix in long form; (sample, locus) must be unique, NaN is null."""
    df = spark.read.parquet(path).select(sample, locus, value)
    return require_unique(df, sample, locus).withColumn(value, F.when(~F.isnan(value), F.col(value)))


def wide_to_long(df: DataFrame, key: str, name: str = "sample_name", value: str = "beta") -> DataFrame:
    """One row a key and sample from a table with a column for each sample; missing values go."""
    return df.unpivot(key, [c for c in df.columns if c != key], name, value).where(F.col(value).isNotNull() & ~F.isnan(value))


def embedding_store(spark: SparkSession, path: str, keys: tuple[str, ...] = ("cpg_idx", "vec_id", "id"), vectors: tuple[str, ...] = ("embedding", "embeddings", "X")) -> DataFrame:
    """(id, embedding) whatever the columns are called; all vectors must have one width."""
    df = spark.read.parquet(path)
    key, vector = next(c for c in keys if c in df.columns), next(c for c in vectors if c in df.columns)
    widths = df.agg(F.countDistinct(F.size(vector)).alias("_k"))
    bad = F.when(F.col("_k") > 1, F.raise_error(F.lit("vectors of several widths")).cast("int")).otherwise(F.lit(0))
    return df.crossJoin(F.broadcast(widths.select(bad.alias("_ok")))).where("_ok = 0").select(F.col(key).alias("id"), F.col(vector).alias("embedding"))


def contiguous_runs(df: DataFrame, x: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, first, last, n): gaps and islands of an integer column."""
    w = Window.partitionBy(*by).orderBy(x)
    g = df.select(*by, x).distinct().withColumn("_g", F.col(x) - F.row_number().over(w))
    return g.groupBy(*by, "_g").agg(F.min(x).alias("first"), F.max(x).alias("last"), F.count("*").alias("n")).drop("_g")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated track catalog with its ordinal in order of track_index (a catalog is thousands of rows)."""
    c = spark.read.csv(path, sep="\t", header=True)
    return c.withColumn("track_index", F.col("track_index").cast("int")).withColumn("ordinal", F.row_number().over(Window.orderBy("track_index")) - 1)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """All files of a folder, with the file's stem as the set's name."""
    df = spark.read.parquet(folder)
    return df.withColumn("set", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.parquet)?(?:/part-[^/]*)?$", 1))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, start, end, name) of canonical chromosomes; starts are one-based, ends as they are."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, start long, `end` long, name string, score double, strand string")
    return raw.withColumn("chrom", nullable_chromosome(F.col("chrom"))).where("chrom is not null").withColumn("start", F.col("start") + 1)


def gtf_tss(spark: SparkSession, path: str) -> DataFrame:
    """Distinct transcription start sites (chrom, tss, strand), zero-based."""
    raw = spark.read.csv(path, sep="\t", comment="#", schema="chrom string, source string, feature string, start long, `end` long, score string, strand string, frame string, attributes string")
    tss = F.when(F.col("strand") == "+", F.col("start") - 1).otherwise(F.col("end") - 1)
    return raw.where("feature = 'transcript'").select(nullable_chromosome(F.col("chrom")).alias("chrom"), tss.alias("tss"), "strand").where("chrom is not null").distinct()


def series_matrix_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample, key, value) of the characteristics lines of a series matrix: 'key: value' cells under sample ids."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("c"))
    clean = lambda c: F.btrim(c, F.lit('"'))
    ids = lines.where(F.col("c")[0] == "!Sample_geo_accession").select(F.posexplode(F.slice("c", F.lit(2), F.size("c"))).alias("at", "sample"))
    traits = lines.where(F.col("c")[0].startswith("!Sample_characteristics")).select(F.posexplode(F.slice("c", F.lit(2), F.size("c"))).alias("at", "cell"))
    parts = F.split(clean(F.col("cell")), ":", 2)
    key = F.btrim(F.regexp_replace(F.lower(parts[0]), "[^a-z0-9]+", "_"), F.lit("_"))
    return traits.join(ids, "at").select(clean(F.col("sample")).alias("sample"), key.alias("key"), F.trim(F.get(parts, F.lit(1))).alias("value")).where("key <> ''")


def series_matrix_values(spark: SparkSession, path: str) -> DataFrame:
    """(probe, at, value) of the table between the matrix' begin and end marks."""
    cells = spark.read.text(path).where(~F.col("value").startswith("!") & (F.col("value") != "")).select(F.split("value", "\t").alias("c")).where(F.col("c")[0] != '"ID_REF"')
    return cells.select(F.btrim(F.col("c")[0], F.lit('"')).alias("probe"), F.posexplode(F.slice("c", F.lit(2), F.size("c"))).alias("at", "v")).select("probe", "at", F.col("v").try_cast("double").alias("value"))


def run_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """(path, dataset, representation, seed, view, mask, metric, value) of all summary.json files below folder."""
    schema = "dataset string, representation string, seed long, evaluation map<string, map<string, map<string, double>>>"
    raw = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "summary.json").json(folder)
    views = raw.select(F.col("_metadata.file_path").alias("path"), "dataset", "representation", "seed", F.explode("evaluation").alias("view", "masks"))
    masks = views.select("*", F.explode("masks").alias("mask", "metrics")).drop("masks")
    return masks.select("*", F.explode("metrics").alias("metric", "value")).drop("metrics")


def pat_counts(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, cpg, methylated, covered) from read fragments (chrom, first CpG, pattern of C and T, count)."""
    raw = spark.read.csv(path, sep="\t", schema="chrom string, start long, pattern string, n long")
    calls = raw.select("chrom", "n", F.posexplode(F.split("pattern", "(?!^)")).alias("k", "call"), "start").where("call in ('C', 'T')")
    return calls.groupBy("chrom", (F.col("start") + F.col("k")).alias("cpg")).agg(F.sum(F.when(F.col("call") == "C", F.col("n")).otherwise(0)).alias("methylated"), F.sum("n").alias("covered"))


def fasta_windows(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(chrom, window, gc, cg, n) of a FASTA file, one record a partition row; sequences are read record by record."""
    records = spark.read.option("lineSep", ">").text(path).where("length(value) > 0")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for value in pdf["value"]:
                head, _, body = value.partition("\n")
                s = body.replace("\n", "").upper()
                for at in range(0, len(s), width):
                    w = s[at : at + width]
                    rows.append((head.split()[0], at // width, w.count("G") + w.count("C"), s[at : at + width + 1].count("CG"), len(w) - w.count("N")))
            yield pd.DataFrame(rows, columns=["chrom", "window", "gc", "cg", "n"])

    return records.mapInPandas(count, "chrom string, window long, gc long, cg long, n long")


def associations(spark: SparkSession, path: str, limit: float = 1e-7) -> DataFrame:
    """Significant rows of a latin-1 association table; p that isn't a number is no row."""
    raw = spark.read.csv(path, sep="\t", header=True, encoding="ISO-8859-1")
    return raw.withColumn("p", F.col("p").try_cast("double")).where(F.col("p") < limit)


def row_column_gather(beta: DataFrame, sample, loci: DataFrame) -> DataFrame:
    """(locus, beta) of one sample at the wanted loci; the sample's filter reaches the scan, and the join picks the loci."""
    return beta.where(F.col("sample") == sample).join(loci.select("locus"), "locus").select("locus", "beta")


def sparse_features(features: DataFrame, width) -> DataFrame:
    """features (row, indices, data, dense) with valid: indices strictly ascending and below width, one value each, all finite.

    Bad rows are an error where they are read, not a silent gap."""
    i, d = F.col("indices"), F.col("data")
    ascending = ~F.exists(F.zip_with(F.slice(i, 1, F.greatest(F.size(i) - 1, F.lit(0))), F.slice(i, 2, F.size(i)), lambda a, b: a >= b), lambda x: x)
    inside = ~F.exists(i, lambda x: x < 0) & F.coalesce(F.array_max(i) < width, F.lit(True))
    finite = lambda c: ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.size(i) == F.size(d)) & ascending & inside & finite(d) & finite(F.col("dense"))
    return features.withColumn("valid", F.when(good, True).otherwise(F.raise_error(F.concat(F.lit("bad feature row "), F.col("row").cast("string"))).cast("boolean")))


def restricted(features: DataFrame, allowed: tuple[str, ...], refused: tuple[str, ...] = ("dense",)) -> DataFrame:
    """Only the allowed columns; to allow a refused one is an error, so is a column that isn't there."""
    if bad := set(allowed) & set(refused):
        raise ValueError(f"{sorted(bad)} must not be read here")
    return features.select(*allowed)
