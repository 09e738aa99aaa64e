"""Embedding whitening by LOBPCG.

The covariance is never formed: each step multiplies it with a block of directions, as sums of centred rows in the tasks,
and a Rayleigh-Ritz problem on iterate, residual and previous direction gives the next iterate on the driver, which
holds d x 3m numbers. Residuals of the returned components are certified by a product made from the rows anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marlstone.llm.common import Scratch
from marlstone.llm.vectors import matrix, quantised, summed, width
from marlstone.operators.eigen import lobpcg

#: Whole numbers a unit of a component, components returned, columns of the iterated block.
SCALE, COMPONENTS, BLOCK = 256, 4, 16
#: Eigenvalues below this share of the trace count as zero: rows have no part in that direction.
ZERO = 1e-13


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable row and component.

    Rows with a null or empty vector, or a null or non-finite component, go; unequal lengths are an error. The
    covariance is over the distinct scaled vectors, divisor n. Repeated rows each have their own results; a null id stays
    null. Components of eigenvalue zero (equal vectors, fewer than five distinct ones) have no rows, so an empty table
    or one of equal vectors gives none. A deviation beyond 64 bits is null. Other columns of df are never read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = scratch.table(quantised(df, scale, id_col, vec_col))
    d = width(rows)
    if not d:
        return spark.createDataFrame([], schema)
    fit = scratch.table(rows.select("x").distinct())
    n = fit.count()
    s = summed(fit, lambda x: x.sum(axis=0, dtype=np.int64), (d,), "i8")
    mean = s / n
    centred = lambda x: x.astype(np.float64) - mean

    def product(b: np.ndarray) -> np.ndarray:
        return summed(fit, lambda x: (c := centred(x)).T @ (c @ b), (d, b.shape[1]), "f8") / n

    trace = float(summed(fit, lambda x: (centred(x) ** 2).sum(), (), "f8")) / n
    if trace <= 0:
        return spark.createDataFrame([], schema)
    values, vectors, _, _ = lobpcg(product, d, min(components, d), BLOCK)
    some = values > ZERO * trace
    values, scaled = values[some], vectors[:, some] / np.sqrt(values[some])
    k = len(values)
    gram = summed(fit, lambda x: (z := centred(x) @ scaled).T @ z, (k, k), "f8") / n
    off = float(np.abs(gram - np.eye(k)).max())
    scratch.drop(fit)
    explained = values / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(1), "<i4").astype(np.int64)
            z = (x - mean) @ scaled
            most = int(n * max(1, np.abs(x).max()) + np.abs(s).max())
            if d * most * most < 2**63:
                away = pa.array(((n * x - s) ** 2).sum(axis=1))
            else:
                exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(r, s)) for r in x]
                away = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            at = pa.array(np.repeat(np.arange(len(x)), k))
            fixed = lambda v, t: pa.array(np.tile(v, len(x)), t)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), fixed(np.arange(1, k + 1), pa.int32()), fixed([n], pa.int64()).take(pa.array(np.zeros(len(x) * k, np.int64))), away.take(at), pa.array(z.ravel()), fixed(explained, pa.float64()), pa.array(np.full(len(x) * k, off))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
