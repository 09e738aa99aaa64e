"""Embedding rows as whole numbers: one Arrow pass that drops unusable vectors, and sums over all rows by tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import small_batches


def binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Bytes of values cut at ends (in bytes) as an Arrow column."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def matrix(col: pa.Array, kind: str) -> np.ndarray:
    """A column of binaries of one length as a matrix, a row each."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    sizes = pc.binary_length(col).to_numpy(zero_copy_only=False)
    data = np.frombuffer(b"".join(col.to_pylist()), dtype=kind)
    return data.reshape(len(col), int(sizes[0]) // np.dtype(kind).itemsize if len(col) else 0)


def quantised(df: DataFrame, scale: int, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """(vec_id, kept columns, x): x holds floor(scale * component) as 32-bit whole numbers, little-endian.

    A row goes if its vector is null or empty, or holds a null or non-finite component. A component that doesn't fit
    32 bits after scaling is an error. Other columns of df are never read.
    """
    small_batches(df.sparkSession)
    picked = df.select(F.col(id_col).alias("vec_id"), *keep, F.col(vec_col).alias("_v"))
    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(b.schema.get_field_index("_v"))
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            v = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(v))])
            ok = (sizes > 0) & (bad[ends] == bad[ends - sizes])
            q = np.floor(v[np.repeat(ok, sizes)] * scale)
            if len(q) and np.abs(q).max() >= 2**31:
                raise ValueError("a component is beyond 32 bits after scaling")
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(i).filter(mask) for i in range(b.num_columns - 1)] + [binary(q.astype("<i4"), np.cumsum(sizes[ok]) * 4)], [*b.schema.names[:-1], "x"])

    return picked.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in ("vec_id", *keep)) + ", x binary")


def width(x: DataFrame) -> int:
    """Components of each vector; 0 for an empty table; unequal lengths are an error."""
    lo, hi = x.agg(F.min(F.octet_length("x")), F.max(F.octet_length("x"))).first()
    if lo != hi:
        raise ValueError("vectors of unequal length")
    return (hi or 0) // 4


def summed(df: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str, columns: tuple[str, ...] = ("x",)) -> np.ndarray:
    """The sum of part(rows as a matrix) over all batches: one small array a task, over 64 tasks added up on two levels."""
    size = int(np.prod(shape)) * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            if b.num_rows:
                total += part(*(matrix(b.column(i), "<i4" if c == "x" else "u1") for i, c in enumerate(columns)))
        yield pa.RecordBatch.from_arrays([binary(total, np.array([size]))], ["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, kind)
        for b in batches:
            for s in b.column(0).to_pylist():
                total += np.frombuffer(s, kind).reshape(shape)
        yield pa.RecordBatch.from_arrays([binary(total, np.array([size]))], ["s"])

    sums = df.select(*columns).mapInArrow(run, "s binary")
    if (tasks := df.rdd.getNumPartitions()) > 64:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(add, "s binary")
    return np.sum([np.frombuffer(r.s, kind).reshape(shape) for r in sums.collect()] or [np.zeros(shape, kind)], axis=0)
