"""Similarity of pairs after the rows' own covariance is taken out: principal axes removed, standardised, whitened.

The width of the vectors is the caller's and small enough for a d x d matrix on the driver; rows and pairs aren't bounded.
Null vectors take no part in a fit and have no transform. Non-finite components are an error of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vectors
from marlstone.operators import probes

RESIDUAL = 1e-6  # least norm of what is left of a vector, against its centred norm


@dataclass
class Spectrum:
    """Mean, falling eigenvalues of the covariance (divisor n), axes as columns, deviation of each component."""

    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    sd: np.ndarray

    def without(self, k: int) -> np.ndarray:
        top = self.axes[:, :k]
        return np.eye(len(self.mean)) - top @ top.T

    def standard(self) -> np.ndarray:
        return np.diag(1 / np.where(self.sd > 0, self.sd, 1.0))

    def white(self, relative: float) -> np.ndarray:
        return self.axes * (self.values + relative * self.values.max()) ** -0.5


def spectrum(df: DataFrame, x: str) -> Spectrum:
    """Two passes: means, then products of centred rows. The largest loading of an axis is positive."""
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).alias("x"))
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no vectors to fit")
    mean = probes.means(rows, "x", first.d)
    centred = F.zip_with("x", F.array(*(F.lit(float(m)) for m in mean)), lambda a, m: a.cast("double") - m)
    s = probes.sums(rows.select(centred.alias("x"), F.array(F.lit(0.0)).alias("y"), F.lit(0).alias("key")), "x", "y", "key")[0]
    cov = s.xx[:-1, :-1] / s.n
    if not np.isfinite(cov).all():
        raise ValueError("vectors hold components that aren't finite")
    values, axes = np.linalg.eigh(cov)
    values, axes = np.maximum(values[::-1], 0), axes[:, ::-1]
    lead = np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(mean))])
    return Spectrum(mean, values, axes * np.where(lead == 0, 1, lead), np.sqrt(np.maximum(np.diag(cov), 0)))


def moved(x: Column | str, mean: np.ndarray, matrix: np.ndarray, least: float = 0.0) -> Column:
    """(x - mean) times the matrix, in Arrow batches; an error where the result's norm is at most `least` of the centred norm."""
    mean, matrix = np.asarray(mean, float), np.asarray(matrix, float)

    def run(pieces: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for piece in pieces:
            z = pc.list_flatten(piece).to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(mean)) - mean
            y = z @ matrix
            if least and (np.linalg.norm(y, axis=1) <= least * np.linalg.norm(z, axis=1)).any():
                raise ValueError("nothing is left of a vector once the axes are removed")
            gone = piece.is_null().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(~gone) * matrix.shape[1]]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(y.ravel()), mask=pa.array(gone))

    return F.arrow_udf(run, "array<double>")(F.col(x) if isinstance(x, str) else x)


def similarities(rows: DataFrame, key: str, x: str, pairs: DataFrame, s: Spectrum, removed: tuple[int, ...] = (0, 1), whiten: float = 1e-6) -> DataFrame:
    """pairs (i, j and more) with a column for each similarity: centred_<k> (the k leading axes removed), standardised, whitened.

    Each vector is transformed once, then looked up for both ends; ends that rows lacks, or has without a vector, leave the
    pair out. Keys of rows are unique.
    """
    forms = {f"centred_{k}": moved(x, s.mean, s.without(k), RESIDUAL) for k in removed}
    forms |= {"standardised": moved(x, s.mean, s.standard()), "whitened": moved(x, s.mean, s.white(whiten))}
    held = rows.where(F.col(x).isNotNull()).select(F.col(key).alias("_id"), F.struct(*(c.alias(n) for n, c in forms.items())).alias("_z"))
    side = lambda c: held.select(F.col("_id").alias(c), F.col("_z").alias(f"_{c}"))
    both = pairs.join(side("i"), "i").join(side("j"), "j")
    return both.select(*pairs.columns, *(vectors.cosine(F.col(f"_i.{n}"), F.col(f"_j.{n}")).alias(n) for n in forms))
