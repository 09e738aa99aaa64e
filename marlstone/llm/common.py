"""Shared helpers: Arrow text chunks, byte-level word hashing, shared tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd base of the polynomial hash modulo 2**64, and the odd multipliers of the finaliser.
BASE = 0x9E3779B97F4A7C15
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: Bytes of text that a task holds as numpy columns at one time; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Rows of an Arrow batch of texts: whole texts are long, and a batch is held by Spark and by Python at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python by BATCH_ROWS rows at most; a smaller setting of the caller's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) with null text as the empty text; other columns are never read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def chunks(batch: pa.RecordBatch, limit: int = CHUNK_BYTES, column: str = "text") -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Consecutive rows of an Arrow batch as (rows, UTF-8 bytes, byte offsets from 0), about limit bytes each."""
    col = batch.column(column)
    if len(col) == 0:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (byte + 1) * BASE**k over i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    x = data.astype(np.uint64)
    x += np.uint64(1)
    x *= powers(len(data))[0]
    np.cumsum(x, out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that don't cross documents, and the row of each."""
    inside = is_word[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    before[full] = False
    after[np.concatenate([full[1:], offsets[-1:]]) - 1 if len(full) else np.zeros(0, np.int64)] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes; the length is mixed in."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = prefix_hash(data)
    return mix((h[ends] - h[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(np.uint64))


#: Lower-cases A-Z, bytewise.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder for one intermediate table, under the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir; only a local master may do without, and then /tmp/checkpoints is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/marlstone-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one operator in the shared folder: each cuts the lineage, and goes when its last reader has run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def table(self, df: DataFrame) -> DataFrame:
        """df written once as Parquet and read again."""
        path = shared_dir(self.spark)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Empty the folders of tables that no later step reads."""
        for t in tables:
            path, _ = self.paths.pop(id(t))
            t.limit(0).coalesce(1).write.mode("overwrite").parquet(path)


def written(df: DataFrame) -> DataFrame:
    """df cut from its lineage, for results that the caller reads later."""
    return Scratch(df.sparkSession).table(df)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mapped(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)
