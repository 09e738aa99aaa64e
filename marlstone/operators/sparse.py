"""Estimators over sparse, wide features: products and cross-products in the tasks, no columns x columns matrix anywhere.

A row is (indices, data) of its sparse columns and a short dense array. What comes to the driver has one number, or a
short vector, for each column; tasks send it by blocks of columns, which are added up before they leave the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.eigen import lobpcg
from marlstone.sources.sinks import written

#: Columns of a block that is added up by one task.
COLUMNS = 4_096
#: Sparse entries that a product takes at a time: its work space is these times the columns of the right side.
ENTRIES = 65_536


def _rows(pdf: pd.DataFrame, dense: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the sparse entries, and the dense part."""
    lengths = pdf["i"].map(len).to_numpy()
    row = np.repeat(np.arange(len(pdf)), lengths)
    column = np.concatenate(pdf["i"].to_list()).astype(np.int64) if len(pdf) else np.zeros(0, np.int64)
    value = np.concatenate(pdf["v"].to_list()).astype(np.float64) if len(pdf) else np.zeros(0)
    return row, column, value, np.stack(pdf["z"]).astype(np.float64) if dense else np.zeros((len(pdf), 0))


def _times(row: np.ndarray, column: np.ndarray, value: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    out = np.zeros((n, right.shape[1]))
    for at in range(0, len(row), ENTRIES):
        own = slice(at, at + ENTRIES)
        np.add.at(out, row[own], value[own, None] * right[column[own]])
    return out


def _added(df: DataFrame, part: Callable[[pd.DataFrame], dict], by: str | None = None) -> dict:
    """name -> sum of part(rows)[name] over all rows (name of (group, name) if by is given).

    A task adds up its batches; arrays go on in blocks of COLUMNS rows, and only their sums come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in batches:
            for group, own in pdf.groupby(by) if by else [(0, pdf)]:
                for name, a in part(own.reset_index(drop=True)).items():
                    total[int(group), name] = total.get((int(group), name), 0) + a
        for (group, name), a in total.items():
            a = np.atleast_2d(np.asarray(a, float).T).T
            yield pd.DataFrame([(group, name, at, a.shape[1], a[at : at + COLUMNS].tobytes()) for at in range(0, len(a), COLUMNS)], columns=["g", "name", "at", "w", "s"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf.iloc[:1].copy()
        out["s"] = [np.sum([np.frombuffer(s) for s in pdf.s], axis=0).tobytes()]
        return out

    schema = "g int, name string, at long, w int, s binary"
    out: dict = {}
    for r in sorted(df.mapInPandas(run, schema).groupBy("g", "name", "at").applyInPandas(add, schema).collect(), key=lambda r: r["at"]):
        out.setdefault((r.g, r.name), []).append(np.frombuffer(r.s).reshape(-1, r.w))
    return {(k if by else k[1]): np.concatenate(v) for k, v in out.items()}


def _features(indices: str, data: str | None, dense: str) -> dict[str, Column]:
    """Sparse columns without data count 1 each."""
    ones = F.transform(F.col(indices), lambda _: F.lit(1.0))
    return {"i": F.col(indices).cast("array<bigint>"), "v": F.col(data).cast("array<double>") if data else ones, "z": F.col(dense).cast("array<double>")}


def _slim(df: DataFrame, indices: str, data: str | None, dense: str, *more: Column) -> DataFrame:
    return df.select(*(c.alias(k) for k, c in _features(indices, data, dense).items()), *more)


@dataclass
class Transform:
    """A linear map to `width` columns: sparse columns times track_scale, dense ones standardised and times dense_scale."""

    width: int
    columns: int
    mean: np.ndarray
    std: np.ndarray
    track_scale: float
    dense_scale: float
    components: np.ndarray | None  # k x (columns + dense); None is the identity
    explained: float | None

    def apply(self, df: DataFrame, indices: str, data: str | None, dense: str, name: str = "embedding") -> DataFrame:
        """df with the projected row as array<float>, padded with zeros to width."""
        me = self
        keep = [c for c in df.columns if c != name]
        parts = _features(indices, data, dense)
        slim = df.select(*keep, *(c.alias(f"_{k}") for k, c in parts.items()))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                row, column, value, z = _rows(pdf[["_i", "_v", "_z"]].set_axis(["i", "v", "z"], axis=1), len(me.mean))
                z = (z - me.mean) / me.std * me.dense_scale
                if me.components is None:
                    out = np.zeros((len(pdf), me.columns + z.shape[1]))
                    np.add.at(out, (row, column), value * me.track_scale)
                    out[:, me.columns :] = z
                else:
                    out = _times(row, column, value * me.track_scale, me.components[:, : me.columns].T, len(pdf)) + z @ me.components[:, me.columns :].T
                out = np.pad(out, ((0, 0), (0, me.width - out.shape[1]))).astype(np.float32)
                pdf = pdf[keep].copy()
                pdf[name] = list(out)
                yield pdf

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
        return slim.mapInPandas(run, f"{schema}, {name} array<float>")


def fit_transform_map(df: DataFrame, indices: str, data: str | None, dense: str, columns: int, width: int, balanced: bool = False, seed: int = 17) -> Transform:
    """The map fitted on df's rows (pass the fit rows only): the leading right singular vectors, or the identity where the
    features have no more columns than width. Components' largest loading is positive.

    columns: of the sparse part. Two rows are needed at least. The driver holds (columns + dense) x 3 (width + 8) numbers.
    """
    slim = written(_slim(df, indices, data, dense))  # each product reads it
    p = len(slim.select("z").first().z) if (n := slim.count()) else 0
    if n < 2:
        raise ValueError("two fit rows at least")

    def moments(pdf: pd.DataFrame) -> dict:
        row, column, value, z = _rows(pdf, p)
        if len(column) and (column.min() < 0 or column.max() >= columns):
            raise ValueError("an index lies outside the columns")
        out = {"energy": np.array([[value @ value]]), "sum": np.bincount(column, value, columns)[:, None] if columns else np.zeros((1, 1))}
        return out | ({"z": z.sum(0)[:, None]} if p else {})

    first = _added(slim, moments)
    mean = first["z"][:, 0] / n if p else np.zeros(0)
    var = _added(slim, lambda pdf: {"zz": ((_rows(pdf, p)[3] - mean) ** 2).sum(0)[:, None]})["zz"][:, 0] / n if p else np.zeros(0)
    std = np.sqrt(var)
    std[std < 1e-8] = 1
    energy = float(first["energy"][0, 0])
    scale = 1.0 / max((energy / max(n * columns, 1)) ** 0.5, 1e-8)
    dense_scale = 1.0
    if balanced:
        scale, dense_scale = scale / max(columns, 1) ** 0.5, 1.0 / max(p, 1) ** 0.5
    d = columns + p
    made = lambda c, e: Transform(width, columns, mean, std, scale, dense_scale, c, e)
    if d <= width:
        return made(None, None)
    k = min(width, d, n - 1)

    def product(v: np.ndarray) -> np.ndarray:
        def part(pdf: pd.DataFrame) -> dict:
            row, column, value, z = _rows(pdf, p)
            value, z = value * scale, (z - mean) / std * dense_scale
            y = _times(row, column, value, v[:columns], len(pdf)) + z @ v[columns:]
            out = _times(column, row, value, y, d)
            out[columns:] = z.T @ y
            return {"s": out}

        return _added(slim, part)["s"]

    values, vectors, _, _ = lobpcg(product, d, k, min(d, k + 8), seed, aim=1e-12, certified=1e-8)
    components = vectors.T * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])[:, None]
    centre = np.concatenate([first["sum"][:, 0] / n * scale if columns else np.zeros(0), np.zeros(p)])
    whole = energy * scale**2 / n - float((centre**2).sum()) + float((var / std**2).sum()) * dense_scale**2
    kept = values / n - (components @ centre) ** 2
    return made(components, float(kept.sum() / whole) if whole > 0 else None)


def residual_associations(df: DataFrame, indices: str, data: str | None, dense: str, columns: int, target: str, fold: str) -> np.ndarray:
    """For each sparse column its association with the target, both freed of the dense covariates by the other folds' fit.

    One pass adds up, by fold, the products of columns, covariates and target; the rest is small algebra for each column. Rows
    with a null or non-finite target don't count. Folds (a few integers) come from whole blocks.
    """
    y = F.col(target).cast("double")
    slim = _slim(df, indices, data, dense, y.alias("y"), F.col(fold).cast("int").alias("f")).where(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")) & F.col("f").isNotNull())

    def part(pdf: pd.DataFrame) -> dict:
        row, column, value, z = _rows(pdf, 1)
        z, t = np.column_stack([np.ones(len(pdf)), z]), pdf.y.to_numpy(float)
        both = np.column_stack([z, t])
        return {"cross": _times(column, row, value, both, columns), "small": both.T @ both, "energy": np.bincount(column, value * value, columns)[:, None]}

    sums = _added(slim, part, "f")
    folds = sorted({f for f, _ in sums})
    if len(folds) < 2:
        raise ValueError("two folds at least")
    top, below, left = np.zeros(columns), np.zeros(columns), 0.0
    for f in folds:
        small = sum(sums[g, "small"] for g in folds if g != f)
        cross = sum(sums[g, "cross"] for g in folds if g != f)
        inverse = np.linalg.pinv(small[:-1, :-1] + 1e-6 * np.eye(len(small) - 1))
        b, coef = inverse @ small[:-1, -1], inverse @ cross[:, :-1].T
        own, held = sums[f, "small"], sums[f, "cross"]
        zr = own[:-1, -1] - own[:-1, :-1] @ b
        top += held[:, -1] - held[:, :-1] @ b - coef.T @ zr
        below += sums[f, "energy"][:, 0] + (coef * (own[:-1, :-1] @ coef)).sum(0) - 2 * (coef * held[:, :-1].T).sum(0)
        left += own[-1, -1] - 2 * b @ own[:-1, -1] + b @ own[:-1, :-1] @ b
    return top / np.maximum(np.sqrt(np.maximum(below, 0) * left), 1e-12)
